"""Windows over a ticker's own bars: n bars back is n rows of that ticker, and a window is complete or missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gristmill.functions.numbers import col

def by() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("bar_no")


def clean(bars: DataFrame, order: str | None = None) -> DataFrame:
    """Valid bars, numbered by ticker: of repeated dates the last row stays, by the column ``order`` that says in which order rows came (a table has none of its own; without it the largest close stays). High and low hold the close. One shuffle by ticker, which all windows after it reuse."""
    w = Window.partitionBy("ticker", "date").orderBy(F.col(order or "close").desc_nulls_last())
    good = bars.where("close is not null and not isnan(close) and abs(close) < double('infinity')")
    once = good.repartition("ticker").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    fixed = once.withColumn("high", F.greatest("high", "close")).withColumn("low", F.least("low", "close"))
    return fixed.withColumn("bar_no", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))


def last(n: int) -> WindowSpec:
    return by().rowsBetween(-(n - 1), 0)


def rolling(kind, x: Column | str, n: int) -> Column:
    """An aggregate of the last n bars; NULL unless all n are there."""
    x = col(x)
    return F.when(F.count(x).over(last(n)) == n, kind(x).over(last(n)))


def lag(x: Column | str, n: int) -> Column:
    return F.lag(col(x), n).over(by())


def average_rank(x: Column | str, *keys: str) -> tuple[Column, Column]:
    """Ranks from 1 on with ties averaged, of the values that aren't NULL in a partition, and how many there are."""
    x = col(x)
    p = Window.partitionBy(*(keys or (F.lit(0),)))
    order = p.orderBy(x.asc_nulls_last())
    ties = F.count(x).over(Window.partitionBy(*(keys or (F.lit(0),)), x))
    return F.when(x.isNotNull(), F.rank().over(order) + (ties - 1) / 2), F.count(x).over(p)


def percentile_rank(x: Column | str, *keys: str, higher: bool = True, missing: float | None = 0.5, alone: float = 1.0) -> Column:
    """0 to 1 over the values of a partition, ties averaged; a single value gets ``alone``, a missing one ``missing``."""
    rank, n = average_rank(x, *keys)
    p = F.when(n == 1, F.lit(alone)).otherwise((rank - 1) / (n - 1))
    p = p if higher else F.when(n == 1, F.lit(alone)).otherwise(1 - (rank - 1) / (n - 1))
    return F.when(col(x).isNotNull(), p).otherwise(F.lit(missing))


def zscore(x: Column | str, *keys: str, limit: float = 3.0) -> Column:
    """Standard score in a partition within ± limit; 0 where there is no spread."""
    x, p = col(x), Window.partitionBy(*(keys or (F.lit(0),)))
    sd = F.stddev_samp(x).over(p)
    z = F.when(sd > 1e-12, (x - F.avg(x).over(p)) / sd).otherwise(0.0)
    return F.when(x.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), z)))


def buckets(x: Column | str, q: int, *keys: str, tie: str = "ticker") -> Column:
    """1 to q by floor(position * q / n) + 1, the position ascending by value and descending by the tie."""
    p = keys or (F.lit(0),)
    place = F.row_number().over(Window.partitionBy(*p).orderBy(col(x).asc(), F.col(tie).desc())) - 1
    return F.floor(place * q / F.count(F.lit(1)).over(Window.partitionBy(*p))).cast("long") + 1
