"""A strategy as one plan: every rebalance date's cross-section, its legs and weights, the book, cash, benchmark and statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators import metrics
from gristmill.operators import portfolio as p


@dataclass(frozen=True)
class Strategy:
    """How a signal becomes a book."""

    freq: str = "quarterly"
    quantiles: int = 5
    top_n: int | None = None
    long_short: bool = False
    weighting: str = "equal"
    cap: float | None = None
    lag: int = 1
    costs_bps: float = 10.0
    delisting_return: float = 0.0


def targets(strategy: Strategy, signals: DataFrame, bars: DataFrame) -> DataFrame:
    """``signal_date, ticker, weight`` for all rebalance dates at once, from ``ticker, date, signal`` (and what the weighting asks for)."""
    dates = p.rebalance_dates(bars, strategy.freq).withColumnRenamed("date", "signal_date")
    rows = signals.withColumnRenamed("date", "signal_date").join(dates, "signal_date")
    legs = p.legs(rows, strategy.quantiles, strategy.top_n, strategy.long_short)
    return p.weights(legs, strategy.weighting, strategy.cap).select("signal_date", "ticker", "weight")


def portfolio_at(strategy: Strategy, signals: DataFrame, date: str) -> DataFrame:
    """The target of one date, by the same legs and weights."""
    rows = signals.where(F.col("date") == F.lit(date).cast("date")).withColumnRenamed("date", "signal_date")
    return p.weights(p.legs(rows, strategy.quantiles, strategy.top_n, strategy.long_short), strategy.weighting, strategy.cap).select("ticker", "weight")


def leg(targets: DataFrame, side: int) -> DataFrame:
    """One side of the targets as a book of its own: the short one with its weights turned positive."""
    return targets.where(F.col("weight") * side > 0).withColumn("weight", F.abs("weight"))


def cash_credit(executed: DataFrame, days: DataFrame, rf: DataFrame) -> DataFrame:
    """``session, credit``: interest on cash (what the executed weights leave of 1, at least 0), from the day after each execution, at the last rate known (the first where none is yet)."""
    cash = executed.groupBy("session").agg(F.greatest(F.lit(0.0), 1 - F.sum("weight")).alias("cash"))
    order = Window.orderBy("session")  # a row a day
    rows = days.join(cash, "session", "left").join(rf, "date", "left")
    held = F.last("cash", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rate = F.coalesce(F.last("rf", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first("rf", True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    return rows.select("session", (F.coalesce(held, F.lit(0.0)) * F.coalesce(rate, F.lit(0.0))).alias("credit"))


def benchmark_returns(levels: DataFrame, first: DataFrame) -> DataFrame:
    """``date, bench``: simple returns of ``date, level`` from the date in ``first`` (one row) on, that date's own set to zero, as a book is built at its close."""
    ret = levels.select("date", (F.col("level") / F.lag("level").over(Window.orderBy("date")) - 1).alias("bench")).crossJoin(first)
    return ret.where("date >= first and bench is not null").select("date", F.when(F.col("date") == F.col("first"), 0.0).otherwise(F.col("bench")).alias("bench"))


def relative(both: DataFrame, ppy: float) -> DataFrame:
    """``beta, tracking_error_pct, information_ratio`` of ``ret`` against ``bench`` over the dates that have both: one aggregation."""
    good = both.where("ret is not null and bench is not null")
    active = F.stddev_samp(F.col("ret") - F.col("bench"))
    var = F.var_samp("bench")
    return good.agg(
        F.when(var > 1e-24, F.covar_samp("ret", "bench") / var).alias("beta"), (active * math.sqrt(ppy) * 100).alias("tracking_error_pct"),
        F.when(active > 0, F.avg(F.col("ret") - F.col("bench")) / active * math.sqrt(ppy)).alias("information_ratio"),
    )


def backtest(strategy: Strategy, signals: DataFrame, bars: DataFrame, levels: DataFrame, rf: DataFrame) -> DataFrame:
    """``session, date, gross, net, credit, ret, bench``: the daily book of a strategy, with interest on cash, beside the benchmark."""
    goal = targets(strategy, signals, bars)
    daily, _ = p.simulate(goal, bars, strategy.costs_bps, strategy.lag, strategy.delisting_return)
    calendar = p.sessions(bars)
    when = p.executions(goal.select("signal_date").distinct(), calendar, strategy.lag)
    priced = p.filled(bars, calendar).where("px > 0").select("ticker", "session")
    executed = goal.join(when, "signal_date").join(priced, ["ticker", "session"]).select("session", "weight")
    credit = cash_credit(executed, calendar, rf)
    book = daily.join(credit, "session", "left").withColumn("ret", F.col("net") + F.coalesce("credit", F.lit(0.0)))
    first = daily.agg(F.min("date").alias("first"))  # one row
    bench = benchmark_returns(levels, first)
    return book.join(bench, "date", "left").select("session", "date", "gross", "net", "credit", "ret", "bench")


def statistics(daily: DataFrame, ppy: float) -> DataFrame:
    """One row: performance and relation to the benchmark of ``date, ret, bench``."""
    return metrics.performance(daily.select("date", "ret"), ppy).crossJoin(relative(daily, ppy))


def cost_drag_pct(turnover: Column, rebalances_per_year: float, costs_bps: float) -> Column:
    """What trading costs a year, in percent: both sides of each rebalance's turnover."""
    return 2 * turnover * rebalances_per_year * costs_bps / 1e4 * 100


def timing_weights(states: DataFrame, by: str = "date") -> DataFrame:
    """Adds ``weight``: one n-th of the names of a date for each that its rule holds (1 long, -1 short), n counting all that are watched."""
    return states.withColumn("weight", F.col("state") / F.count(F.lit(1)).over(Window.partitionBy(by)))
