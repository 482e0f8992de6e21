"""The sequential simulation, for books that hold names without a price on an execution day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.portfolio import executions, filled, sessions

SCHEMA = "book string, session long, gross double, net double, turnover double"


def simulate_gaps(targets: DataFrame, bars: DataFrame, costs_bps: float = 10.0, lag: int = 1, delisting_return: float = 0.0) -> DataFrame:
    """``book, session, gross, net, turnover`` of targets ``book, signal_date, ticker, weight``.

    A held name without a price on an execution day can't be traded: it keeps its drifted weight, restated after costs. So
    one execution depends on the one before, and each book is folded in order, in a group of its own; books run in
    parallel. A group holds the prices of the names that the book ever targets.
    """
    calendar = sessions(bars)
    when = executions(targets.select("signal_date").distinct(), calendar, lag)
    placed = targets.join(when, "signal_date")  # a row for each rebalance
    latest = placed.groupBy("book", "session").agg(F.max("signal_date").alias("signal_date"))
    placed = placed.join(latest, ["book", "session", "signal_date"]).select("book", "session", F.col("ticker").cast("string").alias("ticker"), "weight")
    grid = filled(bars, calendar).select(F.col("ticker").cast("string").alias("ticker"), "session", "px", "carried", "last_session")
    held = placed.select("book", "ticker").distinct().join(grid, "ticker").select("book", "ticker", "session", F.lit(None).cast("double").alias("weight"), "px", "carried", "last_session")
    rows = held.unionByName(placed.select("book", "ticker", "session", "weight", *(F.lit(None).cast(t).alias(c) for c, t in (("px", "double"), ("carried", "double"), ("last_session", "int")))))
    rows = rows.crossJoin(calendar.agg(F.max("session").alias("end")))  # one row

    def one(pdf):
        return _fold(pdf, costs_bps / 1e4, delisting_return)

    return rows.groupBy("book").applyInPandas(one, SCHEMA)


def _fold(pdf, rate: float, delisting_return: float):
    """A book day by day, as values of its holdings and cash.

    A holding is worth what its price makes of it; one past its last price loses the delisting return once and turns to cash. On
    an execution day what can be sold is, and goals, shares of the wealth that costs leave, are bought. A ruined book stands
    still until its next execution, which begins anew.
    """
    import numpy as np
    import pandas as pd

    is_order = pdf.weight.notna()
    names = np.sort(pdf.ticker[is_order].unique())
    place, end = pd.Series(range(len(names)), names), int(pdf.end.iloc[0])
    quotes = pdf[~is_order]
    price, mark, last = (np.full((end + 1, len(names)), np.nan) for _ in range(3))
    where = quotes.session.to_numpy(int), place[quotes.ticker].to_numpy()
    price[where], mark[where], last[where] = quotes.px, quotes.carried, quotes.last_session
    last = np.nanmax(last, axis=0) if end >= 0 else last
    orders = {int(day): np.bincount(place[g.ticker].to_numpy(), g.weight, len(names)) for day, g in pdf[is_order].groupby("session")}
    begin = min(orders)
    value, cash, alive = np.zeros(len(names)), 1.0, True
    out = []
    for day in range(begin, end + 1):
        before, held = value.sum() + cash, value != 0
        if day > begin and held.any():
            value[held] *= mark[day, held] / mark[day - 1, held]
            gone = held & (day > last)
            cash += (value[gone] * (1 + delisting_return)).sum()
            value[gone] = 0.0
        wealth = value.sum() + cash
        gross = wealth / before - 1 if alive and day > begin else 0.0
        if alive and wealth <= 0:
            gross, alive = -1.0, False
            value, cash = np.zeros(len(names)), 0.0
        net, turnover = gross, None
        if day in orders:
            wealth = wealth if alive else 1.0
            tradable = np.isfinite(price[day])
            goal = np.where(price[day] > 0, orders[day], 0.0)  # not scaled up for names without a price
            held_back = np.where(tradable, 0.0, value)
            traded = np.abs(goal - (value - held_back) / wealth).sum()
            cost, turnover = traded * rate, traded / 2
            net = gross - cost
            # costs are a share of the wealth before the day's gain; what can't be sold keeps its value
            left = wealth * (1 + net) / (1 + gross) if alive and 1 + net > 0 else wealth
            value = goal * left + held_back
            cash, alive = left - value.sum(), True
        out.append((str(pdf.book.iloc[0]), day, gross, net, turnover))
    return pd.DataFrame(out, columns=["book", "session", "gross", "net", "turnover"])
