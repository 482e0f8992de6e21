"""The technical cross-section at one date: every feature of a ticker from one array of its last bars.

A cross-section needs a ticker's last bars only, and of each feature only its last value. So the bars are gathered once by
ticker (one shuffle; a ticker has one bar for each session, a few thousand at most), ordered and cut to the last ``BARS``, and
each feature is an expression over the arrays: no window keeps a frame for every bar. ``features.price_features`` gives the
same values for all bars of a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.features import YEAR

#: Bars of a ticker that are kept: a year, one before it, and a month for slopes.
BARS = YEAR + 22


def recent(bars: DataFrame, benchmark: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """``ticker, date, n, b`` of the tickers with a valid bar in the last session that any ticker has one in; ``b`` are the ticker's last bars, the latest last.

    Of bars with one date the last by ``order`` counts (the largest close, where no order is given). benchmark: ``date, level``, laid to each bar
    as of its date; a row for each session, so a dimension.
    """
    good = bars.where("close is not null and not isnan(close) and abs(close) < double('infinity')")
    level = F.lit(None).cast("double")
    if benchmark is not None:
        from gristmill.operators.asof import on_dates

        good = good.join(on_dates(good, benchmark, "date", ["level"]), "date", "left")
        level = F.col("level")
    bar = F.struct("date", F.col(order or "close").alias("o"), "close", F.greatest("high", "close").alias("high"), F.least("low", "close").alias("low"), F.col("volume").cast("double").alias("volume"), level.cast("double").alias("level"))
    one = good.groupBy("ticker").agg(F.array_sort(F.collect_list(bar)).alias("b"), F.max("date").alias("date"))
    one = one.withColumn("b", F.expr("filter(b, (x, i) -> i = size(b) - 1 or b[i + 1].date != x.date)"))
    one = one.select("ticker", "date", F.size("b").alias("n"), F.expr(f"slice(b, greatest(1, size(b) - {BARS - 1}), {BARS})").alias("b"))
    return one.join(one.agg(F.max("date").alias("date")), "date", "left_semi").select("ticker", "date", "n", "b")


def _last(field: str, n: int, back: int = 0) -> str:
    """The last n values of a field, ``back`` bars ago, as SQL; NULL unless there are as many bars."""
    return f"if(size({field}) >= {n + back}, slice({field}, size({field}) - {n + back - 1}, {n}), null)"


def _mean(x: str) -> str:
    return f"aggregate({x}, 0D, (a, v) -> a + v, a -> a / size({x}))"


def _at(field: str, back: int) -> str:
    return f"try_element_at({field}, {-1 - back})"


def _growth(now: str, before: str) -> str:
    return f"if({before} > 0, ({now} / {before} - 1) * 100, null)"


def technical_at(bars: DataFrame, benchmark: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """A row for each ticker of the last session: ``ticker, date`` and the price, return, range, volatility and volume features; with a benchmark also strength and beta."""
    rows = recent(bars, benchmark, order)
    fields = {"c": "close", "h": "high", "l": "low", "v": "volume", "m": "level"}
    one = {k: F.expr(f"transform(b, x -> x.{f})") for k, f in fields.items()}
    rows = _once(rows, ["ticker", "date", "n"], one)
    change = {
        "r": F.expr("transform(sequence(1, greatest(1, size(c) - 1)), i -> try_element_at(c, i + 1) / element_at(c, i) - 1)"),
        "g": F.expr("transform(sequence(1, greatest(1, size(c) - 1)), i -> ln(try_element_at(c, i + 1) / element_at(c, i)))"),
        "mr": F.expr("transform(sequence(1, greatest(1, size(m) - 1)), i -> try_element_at(m, i + 1) / element_at(m, i) - 1)"),
        "s": F.expr("aggregate(c, array(0D), (a, x) -> array_append(a, element_at(a, -1) + x))"),  # running sums, for the averages of many bars
    }
    rows = _once(rows, ["ticker", "date", "n", *fields], {k: F.when(F.size("c") > 1, x).otherwise(F.array().cast("array<double>")) if k != "s" else x for k, x in change.items()})
    simple = {
        "price": _at("c", 0),
        **{f"sma_{n}": _mean(_last("c", n)) for n in (20, 50, 200)},
        "sma_200_before": _mean(_last("c", 200, 21)),
        **{f"return_{k}_pct": _growth(_at("c", 0), _at("c", n)) for k, n in (("1m", 21), ("3m", 63), ("6m", 126), ("12m", YEAR))},
        "return_12m_ex_1m_pct": _growth(_at("c", 21), _at("c", YEAR)),
        "high_52w": f"array_max({_last('h', YEAR)})",
        "low_52w": f"array_min({_last('l', YEAR)})",
        "avg_dollar_volume_20d_usd_mn": f"{_mean('zip_with(' + _last('c', 20) + ', ' + _last('v', 20) + ', (x, y) -> x * y)')} / 1e6",
        "average_volume_20d": _mean(_last("v", 20)),
        **{f"volume_{n}": _mean(_last("v", n)) for n in (5, 60, 120)},
        "volume_most": f"array_max({_last('v', 20)})",
        **{k: f"if(size(r) >= 50, aggregate(zip_with(slice(r, size(r) - 49, 50), slice(v, size(v) - 49, 50), (x, y) -> if({sign} * x > 0, y, 0D)), 0D, (a, x) -> a + x), null)" for k, sign in (("up", 1), ("down", -1))},
    }
    rows = _once(rows, ["ticker", "date", "c", "h", "v", "m", "r", "g", "mr", "s"], {k: F.expr(x) for k, x in simple.items()})
    cross = "if(size(c) >= 220, array_max(transform(sequence(size(c) - 19, size(c)), i -> if({now} > {slow} and {before} <= {slow_before}, 1D, 0D))), null)".format(
        now="(s[i] - s[i - 50]) / 50", slow="(s[i] - s[i - 200]) / 200", before="(s[i - 1] - s[i - 51]) / 50", slow_before="(s[i - 1] - s[i - 201]) / 200"
    )
    out = {
        "sma_200_slope_1m_pct": _growth("sma_200", "sma_200_before"),
        **{f"price_vs_sma_{n}_pct": _growth("price", f"sma_{n}") for n in (50, 200)},
        "sma_50_vs_sma_200_pct": _growth("sma_50", "sma_200"),
        "drawdown_from_52w_high_pct": _growth("price", "high_52w"),
        "above_52w_low_pct": _growth("price", "low_52w"),
        "days_since_52w_high": f"cast(array_position(reverse({_last('h', YEAR)}), high_52w) - 1 as double)",
        **{f"volatility_{n}d_pct": _deviation(_last("g", n)) + f" * sqrt({YEAR}) * 100" for n in (20, 60)},
        "rel_volume_5d": "if(volume_60 > 0, volume_5 / volume_60, null)",
        "rel_volume_20d": "if(volume_120 > 0, average_volume_20d / volume_120, null)",
        "max_volume_ratio_20d": "if(volume_120 > 0, volume_most / volume_120, null)",
        "up_down_volume_ratio_50d": "if(down > 0, up / down, null)",
        "golden_cross_20d": cross,
    }
    if benchmark is not None:
        out |= {f"rel_strength_{k}_pp": f"return_{k}_pct - {_growth(_at('m', 0), _at('m', n))}" for k, n in (("3m", 63), ("6m", 126), ("12m", YEAR))}
        out["beta_1y"] = _beta(_last("r", YEAR), _last("mr", YEAR))
    kept = [k for k in simple if k not in ("sma_200_before", "volume_5", "volume_60", "volume_120", "volume_most", "up", "down")]
    return rows.select("ticker", "date", *kept, *(F.expr(x).alias(k) for k, x in out.items()))


def _deviation(x: str) -> str:
    return f"aggregate(array({x}), cast(null as double), (a, g) -> sqrt(aggregate(g, 0D, (b, y) -> b + pow(y - {_mean('g')}, 2)) / (size(g) - 1)))"


def _beta(r: str, m: str) -> str:
    """Covariance over variance; NULL where the benchmark doesn't move or a value is missing."""
    pair = f"array(named_struct('r', {r}, 'm', {m}))"
    mean = f"transform({pair}, p -> named_struct('r', p.r, 'm', p.m, 'a', {_mean('p.r')}, 'b', {_mean('p.m')}))"
    sums = f"transform({mean}, p -> named_struct('cov', aggregate(zip_with(p.r, p.m, (x, y) -> (x - p.a) * (y - p.b)), 0D, (a, x) -> a + x), 'var', aggregate(p.m, 0D, (a, y) -> a + pow(y - p.b, 2)), 'sq', aggregate(p.m, 0D, (a, y) -> a + y * y)))"
    return f"element_at(transform({sums}, p -> if(p.var > 1e-12 * p.sq, p.cov / p.var, null)), 1)"


def _once(rows: DataFrame, kept: list[str], new: dict[str, Column]) -> DataFrame:
    """Adds columns through a generator of one row, or each use of an array would compute it anew."""
    return rows.select(*kept, F.explode(F.array(F.struct(*(x.alias(k) for k, x in new.items())))).alias("__x")).select(*kept, "__x.*")
