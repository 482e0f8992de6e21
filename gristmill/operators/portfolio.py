"""Calendars, legs, weights and forward returns, for all signal dates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERIODS = {"weekly": "week", "monthly": "month", "quarterly": "quarter", "annual": "year"}


def sessions(bars: DataFrame) -> DataFrame:
    """``date, session``: the trading days, numbered from 0. A row a day, so one window over them is small."""
    return bars.select("date").distinct().withColumn("session", F.row_number().over(Window.orderBy("date")) - 1)


def rebalance_dates(days: DataFrame, freq: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The last trading day of each week (Monday to Sunday), month, quarter or year of all the days, then cut to the window."""
    if freq == "daily":
        out = days.select("date").distinct()
    elif freq in PERIODS:
        out = days.groupBy(F.date_trunc(PERIODS[freq], "date")).agg(F.max("date").alias("date")).select("date")
    else:
        raise ValueError(f"unknown frequency {freq!r}")
    out = out.where(F.col("date") >= F.lit(start).cast("date")) if start else out
    return out.where(F.col("date") <= F.lit(end).cast("date")) if end else out


def executions(signal_dates: DataFrame, calendar: DataFrame, lag: int = 1) -> DataFrame:
    """``signal_date, session``: the lag-th session after each signal date; for lag 0 the first on or after it. Dates beyond the data are left out.

    The sessions are a dimension table, a row a day; the range join is between days and days.
    """
    near = calendar.select(F.col("date").alias("d"), F.col("session").alias("s"))
    after = F.col("d") >= F.col("signal_date") if lag == 0 else F.col("d") > F.col("signal_date")
    first = signal_dates.join(near, after).groupBy("signal_date").agg(F.min("s").alias("s"))
    found = first.select("signal_date", (F.col("s") + max(lag - 1, 0)).alias("session"))
    return found.join(calendar.select("session"), "session", "left_semi").select("signal_date", "session")


def legs(signals: DataFrame, q: int = 5, top_n: int | None = None, long_short: bool = True, by: str = "signal_date") -> DataFrame:
    """Adds ``leg`` (1 long, -1 short) and ``place`` (1 the most extreme) to the names in a leg. Ties fall by ticker, the earlier is better; a date with fewer names than q has no legs."""
    good = signals.where("signal is not null and not isnan(signal) and abs(signal) < double('infinity')")
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.col("signal").desc(), F.col("ticker").asc()))
    rows = good.withColumn("best", best).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(by))).withColumn("worst", F.col("n") + 1 - F.col("best"))
    if top_n:
        k = F.least(F.lit(top_n), F.floor(F.col("n") / 2) if long_short else F.col("n"))
        long, short = F.col("best") <= k, F.col("worst") <= k
    else:
        bucket = F.floor((F.col("worst") - 1) * q / F.col("n")) + 1
        long, short = (bucket == q) & (F.col("n") >= q), (bucket == 1) & (F.col("n") >= q)
    leg = F.when(long, 1).when(short & F.lit(long_short), -1)
    return rows.withColumn("leg", leg).where("leg is not null").withColumn("place", F.when(F.col("leg") == 1, F.col("best")).otherwise(F.col("worst"))).drop("best", "worst", "n")


def weights(rows: DataFrame, kind: str = "equal", cap: float | None = None, by: str = "signal_date") -> DataFrame:
    """Adds ``weight``: each leg sums to 1 (the short one to -1) before the cap. kind: equal, value (``market_cap``), signal (by place) or inverse_vol (``volatility``); names without a positive measure are left out."""
    leg = Window.partitionBy(by, "leg")
    raw = {"equal": F.lit(1.0), "value": F.col("market_cap") if kind == "value" else None, "signal": F.max("place").over(leg) - F.col("place") + 1.0, "inverse_vol": F.when(F.col("volatility") > 0, 1 / F.col("volatility")) if kind == "inverse_vol" else None}[kind]
    sized = rows.withColumn("__raw", raw.cast("double")).where("__raw > 0 and __raw < double('infinity')")
    out = sized.withColumn("weight", F.col("__raw") / F.sum("__raw").over(leg)).drop("__raw")
    out = capped(out, cap, by, "leg") if cap else out
    return out.withColumn("weight", F.col("weight") * F.col("leg"))


def capped(rows: DataFrame, cap: float, *keys: str) -> DataFrame:
    """Caps ``weight`` within a group and hands the excess to the others in proportion, until none is above.

    The capped names are the k heaviest, for the least k at which the next one, scaled up, stays under the cap: one sort
    and running sums, no iteration. Where the cap binds for all, everyone gets it and the group sums to less than 1.
    """
    group = Window.partitionBy(*keys)
    order = group.orderBy(F.col("weight").desc(), F.col("ticker").asc())
    r = rows.withColumn("__k", F.row_number().over(order) - 1).withColumn("__n", F.count(F.lit(1)).over(group))
    r = r.withColumn("__rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    fits = F.col("weight") / F.col("__rest") * (1 - cap * F.col("__k")) <= cap * (1 + 1e-12)
    r = r.withColumn("__first", F.min(F.when(fits, F.struct(F.col("__k").alias("k"), F.col("__rest").alias("rest")))).over(group))
    scaled = F.col("weight") / F.col("__first.rest") * (1 - cap * F.col("__first.k"))
    w = F.when(cap * F.col("__n") <= 1 + 1e-12, F.lit(cap)).when(F.col("__k") < F.col("__first.k"), F.lit(cap)).otherwise(scaled)
    return r.withColumn("weight", w).drop("__k", "__n", "__rest", "__first")


def filled(bars: DataFrame, calendar: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """``ticker, session, px, carried, following, last_session`` for every session from a ticker's first bar on: its price, the last one known, the next one, and the session of its last price."""
    own = bars.join(calendar, "date").select("ticker", "session", F.col("close").alias("px"))
    first = own.groupBy("ticker").agg(F.min("session").alias("first"), F.max("session").alias("last_session"))
    end = calendar.agg(F.max("session").alias("end"))  # one row
    grid = first.crossJoin(end).select("ticker", F.explode(F.sequence("first", "end")).alias("session"), "last_session")
    w = Window.partitionBy("ticker").orderBy("session")
    back = Window.partitionBy("ticker").orderBy(F.col("session").desc()).rowsBetween(Window.unboundedPreceding, 0)  # a running frame; one that looks ahead is computed anew for each row
    out = grid.join(own, ["ticker", "session"], "left")
    return out.withColumn("carried", F.last("px", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("following", F.last("px", True).over(back))


def forward_returns(bars: DataFrame, signal_dates: DataFrame, lag: int = 1, delisting_return: float = 0.0) -> DataFrame:
    """``signal_date, ticker, forward_return`` from a date's execution to the next date's. A name that is halted on the way out leaves at its next price; one without any later price stays at its last, times one plus the delisting return."""
    calendar = sessions(bars)
    spans = executions(signal_dates, calendar, lag).withColumn("out", F.lead("session").over(Window.orderBy("signal_date"))).where("out > session")
    prices = filled(bars, calendar)
    entry = prices.where("px > 0").join(spans, "session").select("signal_date", "ticker", F.col("px").alias("entry"), "out")
    leaving = prices.select("ticker", F.col("session").alias("out"), "px", "carried", "following", "last_session")
    both = entry.join(leaving, ["ticker", "out"])
    dead = F.col("out") > F.col("last_session")
    price = F.when(dead, F.col("carried") * (1 + delisting_return)).otherwise(F.coalesce("px", "following"))
    return both.select("signal_date", "ticker", (price / F.col("entry") - 1).alias("forward_return"))


def quantile_returns(rows: DataFrame, q: int) -> DataFrame:
    """Of ``signal_date, ticker, signal, forward_return``: the mean return of each bucket by date, dates with fewer than 3 q names skipped."""
    from gristmill.operators.windows import buckets

    good = rows.where("signal is not null and forward_return is not null")
    n = F.count(F.lit(1)).over(Window.partitionBy("signal_date"))
    kept = good.withColumn("n", n).where(F.col("n") >= 3 * q).withColumn("bucket", buckets("signal", q, "signal_date"))
    return kept.groupBy("signal_date", "bucket").agg(F.avg("forward_return").alias("mean_return"), F.count("*").alias("n"))


def information_coefficients(rows: DataFrame, q: int) -> DataFrame:
    """``signal_date, ic``: rank correlation of signal and forward return by date, ties averaged."""
    from gristmill.operators.windows import average_rank

    good = rows.where("signal is not null and forward_return is not null").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("signal_date"))).where(F.col("n") >= 3 * q)
    a, _ = average_rank("signal", "signal_date")
    b, _ = average_rank("forward_return", "signal_date")
    return good.withColumn("a", a).withColumn("b", b).groupBy("signal_date").agg(F.corr("a", "b").alias("ic")).where("ic is not null and not isnan(ic)")


def simulate(targets: DataFrame, bars: DataFrame, costs_bps: float = 10.0, lag: int = 1, delisting_return: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Daily returns and executions of a book where every held name has a price on each execution day.

    Then the book after an execution is its target, so periods depend only on the target before: growth of each position by
    (period, ticker, session), wealth by (period, session), and turnover from a full outer join with the drifted book, all
    in parallel. Returns ``session, gross, net`` and ``session, turnover, traded, cost``. ``simulate_gaps`` is for books with halts.
    """
    calendar = sessions(bars)
    when = executions(targets.select("signal_date").distinct(), calendar, lag).groupBy("session").agg(F.max("signal_date").alias("signal_date"))
    end = calendar.agg(F.max("session").alias("end"))
    spans = when.withColumn("next", F.lead("session").over(Window.orderBy("session"))).crossJoin(end).withColumn("until", F.coalesce("next", "end")).select("signal_date", "session", "until", "next")  # one row beside a row for each rebalance
    prices = filled(bars, calendar)
    book = targets.join(spans, "signal_date").join(prices.where("px > 0").select("ticker", "session", F.col("px").alias("entry")), ["ticker", "session"]).select("ticker", F.col("session").alias("period"), "until", "next", "entry", "weight")
    # every session gets its periods (an execution ends one and begins one), so that positions meet prices on equality
    periods = spans.select(F.col("session").alias("period"), F.explode(F.sequence("session", "until")).alias("session"))
    path = prices.join(periods, "session").join(book, ["ticker", "period"])
    dead = F.col("session") > F.col("last_session")
    path = path.withColumn("growth", F.col("carried") / F.col("entry") * F.when(dead, 1 + delisting_return).otherwise(1.0)).withColumn("dead", dead)
    nav = path.groupBy("period", "until", "next", "session").agg((1 + F.sum(F.col("weight") * (F.col("growth") - 1))).alias("nav"))
    w = Window.partitionBy("period").orderBy("session")
    ruin = F.min(F.when(F.col("nav") <= 0, F.col("session"))).over(Window.partitionBy("period"))
    steps = nav.withColumn("ruin", ruin).withColumn("gross", F.when(F.col("session") == F.col("ruin"), -1.0).when(F.col("session") > F.col("ruin"), 0.0).otherwise(F.col("nav") / F.lag("nav").over(w) - 1))
    gross = steps.where("session > period").select("session", "gross")
    drifted = path.where("session = next and not dead").join(nav.select("period", "session", "nav"), ["period", "session"]).where("nav > 0").select(F.col("next").alias("period"), "ticker", (F.col("weight") * F.col("growth") / F.col("nav")).alias("before"))
    trades = book.select("period", "ticker", "weight").join(drifted, ["period", "ticker"], "full")
    done = trades.groupBy("period").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))).alias("traded"))
    done = spans.select(F.col("session").alias("period")).join(done, "period", "left").select(F.col("period").alias("session"), F.coalesce("traded", F.lit(0.0)).alias("traded"))
    done = done.select("session", (F.col("traded") / 2).alias("turnover"), "traded", (F.col("traded") * costs_bps / 1e4).alias("cost"))
    start = spans.agg(F.min("session").alias("start"))
    days = calendar.crossJoin(start).where("session >= start").select("session", "date")  # one row beside each session
    daily = days.join(gross, "session", "left").join(done.select("session", "cost"), "session", "left")
    g = F.coalesce("gross", F.lit(0.0))
    return daily.select("session", "date", g.alias("gross"), (g - F.coalesce("cost", F.lit(0.0))).alias("net")), done


