"""Readers of the star schema and the engine inputs that are derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The date that cross-sections are taken at: features count bars known by then.
AS_OF = "2000-12-31"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bars(spark: SparkSession, sf_dir: str, as_of: str | None = None) -> DataFrame:
    """Weekly bars of each supplier's unit prices: ``ticker, date, close, high, low, volume``; as_of: only what was traded by the end of that day. One partial aggregation and one shuffle; only the five columns that it needs are read."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    rows = _known(read(spark, sf_dir, "lineitem"), as_of)
    return rows.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")).agg(
        F.avg(unit).alias("close"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum("l_quantity").alias("volume")
    )


def ordered_means(spark: SparkSession, sf_dir: str, unit: str, **values: Column) -> DataFrame:
    """``ticker, date`` and the mean of each value over a supplier's lines of a week or month, summed line by line in the order of the table (files by name).

    A mean of doubles depends on the order of its sum in the last bit, which decides on which side of a cut point tied names fall.
    So the order must not come from how Spark cuts the input. Missing values count for nothing; a window holds one group at a time.
    """
    w = Window.partitionBy("ticker", "date").orderBy("__file", "__row")
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ticker"), F.to_date(F.date_trunc(unit, "l_shipdate")).alias("date"),
        F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"), *(v.alias(n) for n, v in values.items()),
    )
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    running = lines.select("ticker", "date", *(F.avg(n).over(so_far).alias(n) for n in values), F.lead("__row").over(w).alias("__next"))
    return running.where("__next is null").drop("__next")


def _known(rows: DataFrame, as_of: str | None) -> DataFrame:
    """What a point in time knows; a bound on the column itself, so that it reaches the scan."""
    return rows if as_of is None else rows.where(F.col("l_shipdate") < F.date_add(F.lit(as_of).cast("date"), 1).cast("timestamp"))


def benchmark(spark: SparkSession, sf_dir: str, as_of: str | None = None) -> DataFrame:
    """``date, level``: the mean unit price of all suppliers by week."""
    rows = _known(read(spark, sf_dir, "lineitem"), as_of)
    return rows.groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("level"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ticker, name, gics_sector, country, market_cap``; sector is the region and the cap the account balance in millions."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"), F.col("r_name").alias("gics_sector"), F.col("n_name").alias("country"), (F.col("s_acctbal") * 1e6).alias("market_cap")
    )


def daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``date, ret``: simple returns of revenue by day of order."""
    from pyspark.sql import Window

    by_day = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("v"))
    w = Window.orderBy("date")  # a row a day: a few thousand, whatever the size of orders
    return by_day.withColumn("ret", F.col("v") / F.lag("v").over(w) - 1).where("ret is not null").select("date", "ret")


#: The same inputs in SQL, as common table expressions.
def _bars_sql(known: str) -> str:
    return f"""bars as (select l_suppkey as ticker, cast(date_trunc('week', l_shipdate) as date) as date, avg(l_extendedprice / l_quantity) as close,
 max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low, sum(l_quantity) as volume
 from lineitem {known} group by 1, 2)"""


def _benchmark_sql(known: str) -> str:
    return f"benchmark_series as (select cast(date_trunc('week', l_shipdate) as date) as date, sum(l_extendedprice) / sum(l_quantity) as level from lineitem {known} group by 1)"


KNOWN_SQL = f"where l_shipdate < date '{AS_OF}' + 1"
BARS_SQL, BARS_AS_OF_SQL = _bars_sql(""), _bars_sql(KNOWN_SQL)
BENCHMARK_SQL, BENCHMARK_AS_OF_SQL = _benchmark_sql(""), _benchmark_sql(KNOWN_SQL)
UNIVERSE_SQL = "universe as (select s_suppkey as ticker, s_name as name, r_name as gics_sector, n_name as country, s_acctbal * 1e6 as market_cap from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
DAILY_SQL = "daily as (select * from (select date, v / lag(v) over (order by date) - 1 as ret from (select cast(o_orderdate as date) as date, sum(o_totalprice) as v from orders group by 1)) where ret is not null)"
