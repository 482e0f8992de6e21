"""Operators that are truly sequential along a ticker's bars, one Arrow batch of arrays for each ticker.

A ticker's bars are bounded by the number of sessions, so a group is small however many tickers there are. All recursive
indicators are computed in one pass over a group, after the one shuffle by ticker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ewm(x, alpha: float, least: int = 1):
    """Exponential mean seeded with the first valid value; missing where x is, and until ``least`` values are seen."""
    import numpy as np
    import pandas as pd

    valid = pd.Series(x).where(np.isfinite(x))
    return valid.ewm(alpha=alpha, adjust=False, ignore_na=True, min_periods=least).mean().where(valid.notna()).to_numpy()


def wilder(x, n: int):
    """Wilder's mean: seeded with the mean of the first n valid values in a row, then 1/n of each new one."""
    import numpy as np

    good = np.isfinite(x)
    run = np.convolve(good, np.ones(n), "full")[: len(x)] == n if len(x) else good
    out = np.full(len(x), np.nan)
    if run.any():
        k = int(run.argmax())
        rest = np.where(good, x, np.nan)[k:].copy()
        rest[0] = x[k - n + 1 : k + 1].mean()
        out[k:] = ewm(rest, 1 / n)
    return out


def rsi(close, n: int = 14):
    import numpy as np

    change = np.diff(close, prepend=np.nan)
    up, down = wilder(np.maximum(change, 0), n), wilder(np.maximum(-change, 0), n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(up + down > 0, 100 * up / (up + down), np.nan)


def true_range(high, low, close):
    import numpy as np

    before = np.concatenate([[np.nan], close[:-1]])
    return np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))


#: Indicators by name; each from the ones computed before it.
INDICATORS = {
    "rsi_14": lambda p: rsi(p["close"]),
    "macd_line": lambda p: ewm(p["close"], 2 / 13, 12) - ewm(p["close"], 2 / 27, 26),
    "macd_signal": lambda p: ewm(p("macd_line"), 2 / 10, 9),
    "macd_histogram": lambda p: p("macd_line") - p("macd_signal"),
    "macd_histogram_pct_price": lambda p: 100 * p("macd_histogram") / p["close"],
    "macd_bullish_cross_10d": lambda p: crossed(p("macd_line"), p("macd_signal"), 10),
    "atr_14": lambda p: wilder(true_range(p["high"], p["low"], p["close"]), 14),
    "atr_14_pct": lambda p: 100 * p("atr_14") / p["close"],
}


class _Bars(dict):
    """Columns of a ticker's bars; called with a name, the indicator of that name, computed once."""

    def __call__(self, name: str):
        if name not in self:
            self[name] = INDICATORS[name](self)
        return self[name]


def crossed(a, b, n: int):
    """1 where a rose above b within the last n bars, else 0; missing unless both are known on n + 1 bars."""
    import numpy as np

    known = np.isfinite(a) & np.isfinite(b)
    turn = np.zeros(len(a))
    turn[1:] = (a[1:] > b[1:]) & (a[:-1] <= b[:-1])
    many = lambda x, k: np.convolve(x, np.ones(k), "full")[: len(x)]
    return np.where(many(known, n + 1) == n + 1, many(turn, n) > 0, np.nan) if len(a) else turn


def indicators(bars: DataFrame, names: tuple[str, ...] = ("rsi_14", "macd_line", "macd_signal", "macd_histogram", "atr_14")) -> DataFrame:
    """Adds the indicators asked for to cleaned bars (``ticker, bar_no, close, high, low``)."""
    schema = T.StructType([*bars.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def one(pdf):
        pdf = pdf.sort_values("bar_no")
        found = _Bars({k: pdf[k].to_numpy(float) for k in ("close", "high", "low")})
        return pdf.assign(**{n: found(n) for n in names})

    out = bars.groupBy("ticker").applyInPandas(one, schema)
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def latch(entry: Column, exit_: Column, priced: Column, keys: str = "ticker", order: str = "bar_no") -> Column:
    """State of a timing rule: 1 from an entry on, 0 from an exit on (which beats an entry) or a session without price. The last event carries on, so a window does it."""
    event = F.when(~priced, 0).when(exit_, 0).when(entry, 1)
    w = Window.partitionBy(keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(event, True).over(w), F.lit(0))
