"""Statistics of return series. A series is ``date, ret`` (and keys): small beside the data it comes from, but every step is still an aggregate or a window by key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENDS = {"W": lambda d: F.date_add(F.date_trunc("week", F.date_add(d, 2)).cast("date"), 4), "M": F.last_day, "Q": lambda d: F.last_day(F.add_months(F.date_trunc("quarter", d).cast("date"), 2)), "Y": lambda d: F.last_day(F.add_months(F.date_trunc("year", d).cast("date"), 11))}


def compound(returns: DataFrame, freq: str) -> DataFrame:
    """``date, ret`` at the calendar end of each period: weeks end on Friday, missing returns are skipped, empty periods dropped."""
    return returns.where("ret is not null").groupBy(ENDS[freq](F.col("date")).alias("date")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))


def periods_per_year(dates: DataFrame) -> DataFrame:
    """``ppy`` by the median days between dates."""
    gaps = dates.select("date").distinct().withColumn("gap", F.datediff("date", F.lag("date").over(Window.orderBy("date"))))
    m = F.median("gap")
    return gaps.agg(F.when(m <= 4, 252.0).when(m <= 10, 52.0).when(m <= 45, 12.0).when(m <= 140, 4.0).otherwise(1.0).alias("ppy"))


def drawdowns(returns: DataFrame) -> DataFrame:
    """Adds ``wealth`` and ``drawdown`` against the running peak, which begins at 1."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    path = returns.withColumn("wealth", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w))
    peak = F.greatest(F.lit(1.0), F.max("wealth").over(w))
    return path.withColumn("drawdown", F.col("wealth") / peak - 1)


def underwater(returns: DataFrame) -> DataFrame:
    """``max_drawdown, longest``: the deepest drawdown and the most periods in a row below a peak (islands between flat periods)."""
    d = drawdowns(returns).withColumn("under", (F.col("drawdown") < -1e-12).cast("int"))
    island = F.sum(1 - F.col("under")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    runs = d.withColumn("island", island).groupBy("island").agg(F.sum("under").alias("n"), F.min("drawdown").alias("m"))
    return runs.agg(F.least(F.min("m"), F.lit(0.0)).alias("max_drawdown"), F.max("n").cast("long").alias("longest"))


def skewness(x: Column) -> Column:
    """Bias-corrected; NULL under 8 values."""
    n = F.count(x)
    return F.when(n >= 8, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x))


def kurtosis(x: Column) -> Column:
    """Excess, bias-corrected; NULL under 8 values."""
    n = F.count(x).cast("double")
    return F.when(n >= 8, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def performance(returns: DataFrame, ppy: float) -> DataFrame:
    """One row of statistics."""
    x, n = F.col("ret"), F.count("ret")
    wealth = F.product(1 + x)
    root = math.sqrt(ppy)
    sd, down = F.stddev_samp(x), F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2)))
    stats = returns.where("ret is not null").agg(
        n.alias("n_periods"), ((wealth - 1) * 100).alias("total_return_pct"), F.when(wealth > 0, (F.pow(wealth, ppy / n) - 1) * 100).otherwise(-100.0).alias("cagr_pct"),
        (sd * root * 100).alias("volatility_pct"), F.when(sd > 0, F.avg(x) / sd * root).alias("sharpe"), F.when(down > 0, F.avg(x) / down * root).alias("sortino"),
        (F.avg((x > 0).cast("double")) * 100).alias("hit_rate_pct"), (F.max(x) * 100).alias("best_period_pct"), (F.min(x) * 100).alias("worst_period_pct"), skewness(x).alias("skew"), kurtosis(x).alias("excess_kurtosis"),
    )
    both = stats.crossJoin(F.broadcast(underwater(returns.where("ret is not null"))))  # one row beside one row
    calmar = F.when(F.col("max_drawdown") < -1e-12, F.col("cagr_pct") / 100 / F.abs("max_drawdown"))
    return both.select(*stats.columns, (F.col("max_drawdown") * 100).alias("max_drawdown_pct"), F.col("longest").alias("max_drawdown_periods"), calmar.alias("calmar"))


def default_lags(n: int) -> int:
    return 0 if n <= 1 else math.floor(4 * (n / 100) ** (2 / 9))


def newey_west(returns: DataFrame, lags: int | None = None) -> DataFrame:
    """``n, mean, t_stat`` of the mean, by the Bartlett kernel. The lagged products are columns of one window, summed in one pass."""
    good = returns.where("ret is not null")
    size = good.agg(F.count("*").alias("n"), F.avg("ret").alias("mean")).first()  # two numbers
    n, mean = size.n, size["mean"]
    if n < 2:
        return returns.sparkSession.createDataFrame([(n, mean, None)], "n long, mean double, t_stat double")
    k = min(default_lags(n) if lags is None else lags, n - 1)
    dev = good.select("date", (F.col("ret") - F.lit(mean)).alias("d"))
    w = Window.orderBy("date")
    products = dev.select(*((F.col("d") * F.lag("d", i).over(w)).alias(f"g{i}") if i else (F.col("d") * F.col("d")).alias("g0") for i in range(k + 1)))
    total = sum((F.sum(f"g{i}") * (2 * (1 - i / (k + 1)) if i else 1) for i in range(k + 1)), F.lit(0.0)) / n
    se = F.sqrt(F.greatest(total, F.lit(0.0)) / (n - 1))
    return products.agg(F.lit(n).cast("long").alias("n"), F.lit(mean).alias("mean"), F.when(se > 1e-12 * max(1.0, abs(mean)), F.lit(mean) / se).alias("t_stat"))


def ols_newey_west(rows: DataFrame, y: str, xs: list[str], lags: int | None = None) -> DataFrame:
    """``term, beta, std_error, t_stat, r2, n`` of a regression with intercept and Newey-West errors.

    Spark sums X'X, X'y and the lagged score products, a few numbers by terms and lags; only the solution of that small
    system is on the driver.
    """
    import numpy as np

    spark, k = rows.sparkSession, len(xs) + 1
    data = rows.select("date", F.col(y).cast("double").alias("y"), F.lit(1.0).alias("x0"), *(F.col(x).cast("double").alias(f"x{i + 1}") for i, x in enumerate(xs))).na.drop()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    m = data.agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.avg("y").alias("ym"), *(F.sum(F.col(f"x{i}") * F.col("y")).alias(f"b{i}") for i in range(k)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i, j in pairs)).first()
    n = m.n
    if n <= k:
        raise ValueError(f"{n} observations are too few for {k} terms")
    xx, xy = np.zeros((k, k)), np.array([m[f"b{i}"] for i in range(k)])
    for i, j in pairs:
        xx[i, j] = xx[j, i] = m[f"a{i}_{j}"]
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    top = min(default_lags(n) if lags is None else lags, n - 1)
    error = F.col("y") - sum((F.col(f"x{i}") * float(beta[i]) for i in range(k)), F.lit(0.0))
    scores = data.withColumn("e", error).select("date", "e", *((F.col(f"x{i}") * F.col("e")).alias(f"s{i}") for i in range(k)))
    w = Window.orderBy("date")
    late = scores.select("e", *(f"s{i}" for i in range(k)), *(F.lag(f"s{i}", lag).over(w).alias(f"l{lag}_{i}") for lag in range(1, top + 1) for i in range(k)))
    sums = late.agg(F.sum(F.col("e") * F.col("e")).alias("sse"), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"g0_{i}_{j}") for i in range(k) for j in range(k)), *(F.sum(F.col(f"s{i}") * F.col(f"l{lag}_{j}")).alias(f"g{lag}_{i}_{j}") for lag in range(1, top + 1) for i in range(k) for j in range(k))).first()
    meat = np.zeros((k, k))
    for lag in range(top + 1):
        g = np.array([[sums[f"g{lag}_{i}_{j}"] for j in range(k)] for i in range(k)])
        meat += g if lag == 0 else (1 - lag / (top + 1)) * (g + g.T)
    cov = inverse @ meat @ inverse * n / (n - k)
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    sst = m.yy - n * m.ym**2
    r2 = 1 - sums.sse / sst if sst > 0 else None
    return spark.createDataFrame([(t, float(b), float(s), float(b / s) if s > 0 else None, r2, n) for t, b, s in zip(["const", *xs], beta, se)], "term string, beta double, std_error double, t_stat double, r2 double, n long")
