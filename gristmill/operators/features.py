"""The technical cross-section: every window feature of the catalog in one pass over a ticker's bars.

All windows share one partitioning and order, so Spark shuffles and sorts the bars once. ``latest`` then keeps the bars of
the evaluation session, the last date on which any ticker has a bar.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.numbers import growth_pct, ratio
from gristmill.operators.windows import clean, last, lag, rolling

YEAR = 252


def price_features(bars: DataFrame) -> DataFrame:
    """Adds averages, returns, ranges, volatility and volume features to cleaned bars."""
    f = bars
    f = f.withColumns({f"sma_{n}": rolling(F.avg, "close", n) for n in (20, 50, 200)})
    f = f.withColumns({f"return_{k}_pct": growth_pct("close", lag("close", n)) for k, n in (("1m", 21), ("3m", 63), ("6m", 126), ("12m", YEAR))})
    f = f.withColumn("return_12m_ex_1m_pct", growth_pct(lag("close", 21), lag("close", YEAR)))
    f = f.withColumn("ret", F.col("close") / lag("close", 1) - 1).withColumn("lret", F.log(F.col("close") / lag("close", 1)))
    f = f.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close", 1)), F.abs(F.col("low") - lag("close", 1))))
    f = f.withColumn("high_52w", rolling(F.max, "high", YEAR)).withColumn("low_52w", rolling(F.min, "low", YEAR))
    f = f.withColumn("avg_dollar_volume_20d_usd_mn", rolling(F.avg, F.col("close") * F.col("volume"), 20) / 1e6)
    f = f.withColumns({f"volatility_{n}d_pct": rolling(F.stddev_samp, "lret", n) * math.sqrt(YEAR) * 100 for n in (20, 60)})
    f = f.withColumn("high_bar", F.max(F.struct("high", "bar_no")).over(last(YEAR)).getField("bar_no"))
    volume = {n: rolling(F.avg, "volume", n) for n in (5, 20, 60, 120)}
    f = f.withColumn("rel_volume_5d", ratio(volume[5], volume[60])).withColumn("rel_volume_20d", ratio(volume[20], volume[120]))
    f = f.withColumn("max_volume_ratio_20d", ratio(rolling(F.max, "volume", 20), volume[120]))
    up, down = (F.sum(F.when(F.col("ret") * s > 0, F.col("volume")).otherwise(0.0)).over(last(50)) for s in (1, -1))
    f = f.withColumn("up_down_volume_ratio_50d", F.when(F.count("ret").over(last(50)) == 50, ratio(up, down)))
    f = f.withColumns(
        {
            "price": F.col("close"),
            "price_vs_sma_50_pct": growth_pct("close", "sma_50"),
            "price_vs_sma_200_pct": growth_pct("close", "sma_200"),
            "sma_50_vs_sma_200_pct": growth_pct("sma_50", "sma_200"),
            "sma_200_slope_1m_pct": growth_pct("sma_200", lag("sma_200", 21)),
            "drawdown_from_52w_high_pct": growth_pct("close", "high_52w"),
            "above_52w_low_pct": growth_pct("close", "low_52w"),
            "days_since_52w_high": F.when(F.col("high_52w").isNotNull(), F.col("bar_no") - F.col("high_bar")).cast("double"),
        }
    )
    return crossed(f, "golden_cross_20d", "sma_50", "sma_200", 20)


def crossed(f: DataFrame, name: str, a: str, b: str, n: int) -> DataFrame:
    """Adds 1.0 if a crossed above b within the last n bars, else 0.0; NULL unless both are known on n + 1 bars."""
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    turn = F.when((F.col(a) > F.col(b)) & (lag(a, 1) <= lag(b, 1)), 1.0).otherwise(0.0)
    f = f.withColumn("__turn", turn).withColumn("__known", known.cast("int"))
    return f.withColumn(name, F.when(F.sum("__known").over(last(n + 1)) == n + 1, F.max("__turn").over(last(n)))).drop("__turn", "__known")


def against_benchmark(f: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Adds strength against the benchmark and beta; the benchmark is taken as of each of the ticker's own bars."""
    from gristmill.operators.asof import asof

    f = asof(f, benchmark.withColumnRenamed("date", "bdate"), "date", "bdate", ["level"])
    f = f.withColumns({f"rel_strength_{k}_pp": F.col(f"return_{k}_pct") - growth_pct("level", lag("level", n)) for k, n in (("3m", 63), ("6m", 126), ("12m", YEAR))})
    f = f.withColumn("bret", F.col("level") / lag("level", 1) - 1)
    both = F.col("ret").isNotNull() & F.col("bret").isNotNull()
    f = f.withColumn("__r", F.when(both, F.col("ret"))).withColumn("__b", F.when(both, F.col("bret")))
    w = last(YEAR)
    spread = F.var_samp("__b").over(w)
    flat = spread * (YEAR - 1) <= 1e-12 * F.sum(F.col("__b") * F.col("__b")).over(w)
    return f.withColumn("beta_1y", F.when((F.count("__r").over(w) == YEAR) & ~flat, F.covar_samp("__r", "__b").over(w) / spread)).drop("__r", "__b")


def latest(f: DataFrame) -> DataFrame:
    """The bars of the evaluation session."""
    return f.join(f.agg(F.max("date").alias("date")), "date", "left_semi")


def technical(bars: DataFrame) -> DataFrame:
    return price_features(clean(bars))

