"""As-of and nearest joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: str, right_on: str, values: list[str], by: list[str] = (), tolerance_days: int | None = None) -> DataFrame:
    """Adds the ``values`` of the last right row at or before each left row (a NULL value of that row stays NULL), of the same ``by``.

    The two sides are laid over each other and the last right row is carried forward in one window: one shuffle by key, no
    comparison of pairs. Without a key the right side should be a dimension (a benchmark, a calendar): the left side's distinct times, a
    dimension too, are then given their values by ``on_dates`` and joined on equality. With several right rows at one time, the largest struct of values counts.
    """
    if not by:
        table = on_dates(left, right.withColumnRenamed(right_on, "__on"), on, values, right_on="__on", tolerance_days=tolerance_days)
        return left.join(table, on, "left").select(*left.columns, *values)
    one = right.groupBy(*by, F.col(right_on).alias("__t")).agg(F.max(F.struct(*values)).alias("__s")).select(*by, "__t", F.lit(0).alias("__side"), F.struct(F.col("__t").alias("__at"), "__s.*").alias("__got"), F.lit(None).cast(left.schema.simpleString()).alias("__row"))
    two = left.select(*by, F.col(on).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(one.schema["__got"].dataType).alias("__got"), F.struct(*left.columns).alias("__row"))
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    filled = one.unionByName(two).withColumn("__got", F.last("__got", True).over(w)).where("__side = 1")
    late = F.lit(True) if tolerance_days is None else F.datediff(F.col(f"__row.{on}"), F.col("__got.__at")) <= tolerance_days
    return filled.select("__row.*", *(F.when(late, F.col(f"__got.{v}")).alias(v) for v in values))


def on_dates(left: DataFrame, right: DataFrame, on: str, values: list[str], right_on: str | None = None, tolerance_days: int | None = None) -> DataFrame:
    """``on`` and ``values``: of each distinct time of the left side, the last right row's at or before it. One window over the times of both, a row each."""
    right_on = right_on or on
    one = right.groupBy(F.col(right_on).alias("__t")).agg(F.max(F.struct(*values)).alias("__v"))
    times = left.select(F.col(on).alias("__t")).distinct().withColumn("__left", F.lit(True))
    both = times.join(one.withColumn("__at", F.col("__t")), "__t", "full")
    w = Window.orderBy("__t").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__v", F.last(F.when(F.col("__at").isNotNull(), F.struct(F.col("__at").alias("at"), F.col("__v").alias("v"))), True).over(w)).where("__left")
    late = F.lit(True) if tolerance_days is None else F.datediff("__t", "__v.at") <= tolerance_days
    return both.select(F.col("__t").alias(on), *(F.when(late, F.col(f"__v.v.{v}")).alias(v) for v in values))


def nearest_within(left: DataFrame, right: DataFrame, on: str, right_on: str, days: int, values: list[str], by: list[str]) -> DataFrame:
    """Adds the ``values`` of the right row nearest in days, within ``days``; the earlier of two as near. The range is met by buckets of ``days`` and the neighbours of each, so the join is on equality."""
    width = max(1, days)
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / width)
    keyed = left.withColumn("__id", F.monotonically_increasing_id())
    spread = keyed.withColumn("__b", F.explode(F.array(*(bucket(F.col(on)) + k for k in (-1, 0, 1)))))
    near = right.select(*by, F.col(right_on).alias("__at"), *values, bucket(F.col(right_on)).alias("__b"))
    pairs = spread.join(near, [*by, "__b"]).where(F.abs(F.datediff(F.col(on), F.col("__at"))) <= days)
    best = pairs.groupBy("__id", *left.columns).agg(F.min(F.struct(F.abs(F.datediff(F.col(on), F.col("__at"))).alias("d"), F.col("__at"), *values)).alias("__n"))
    return best.select(*left.columns, F.col("__n.__at").alias(right_on), *(F.col(f"__n.{v}") for v in values))
