"""Statistics of return series and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions.numbers import rounded
from gristmill.operators import asof as a
from gristmill.operators import metrics as m
from gristmill.sources.tables import BARS_SQL, BENCHMARK_SQL, DAILY_SQL, bars, benchmark, daily_revenue, read

DAY = lambda c: F.col(c).cast("string").alias(c)


def compounded(freq):
    def query(spark, sf_dir):
        return m.compound(daily_revenue(spark, sf_dir), freq).select(DAY("date"), rounded("ret").alias("ret"))

    return query


ENDS = {"W": "date_trunc('week', date + 2) + interval 4 day", "M": "last_day(date)", "Q": "last_day(date_trunc('quarter', date) + interval 2 month)", "Y": "last_day(date_trunc('year', date) + interval 11 month)"}


def compounded_sql(freq):
    return f"with {DAILY_SQL} select cast(cast({ENDS[freq]} as date) as varchar) as date, round(product(1 + ret) - 1, 6) as ret from daily group by 1"


def drawdown_curve(spark, sf_dir):
    d = m.drawdowns(m.compound(daily_revenue(spark, sf_dir), "W"))
    return d.select(DAY("date"), rounded("drawdown").alias("drawdown"))


def underwater_run(spark, sf_dir):
    d = m.underwater(m.compound(daily_revenue(spark, sf_dir), "W"))
    return d.select(rounded("max_drawdown").alias("max_drawdown"), "longest")


WEEKLY = f"{DAILY_SQL}, wk as (select cast({ENDS['W']} as date) as date, product(1 + ret) - 1 as ret from daily group by 1), dd as (select date, ret, w / greatest(1, max(w) over (order by date rows between unbounded preceding and current row)) - 1 as drawdown from (select date, ret, product(1 + ret) over (order by date rows between unbounded preceding and current row) as w from wk))"
UNDER = f"{WEEKLY}, fl as (select date, drawdown, (drawdown < -1e-12)::int as u from dd), il as (select *, sum(1 - u) over (order by date rows between unbounded preceding and current row) as i from fl), rn as (select sum(u) as n, min(drawdown) as d from il group by i), uw as (select least(min(d), 0) as max_drawdown, max(n)::bigint as longest from rn)"


def perf_stats(spark, sf_dir):
    s = m.performance(m.compound(daily_revenue(spark, sf_dir), "W"), 52.0)
    return s.select(*(c if c in ("n_periods", "max_drawdown_periods") else rounded(c).alias(c) for c in s.columns))


PERF_SQL = f"""with {UNDER}, st as (select count(ret) as n, product(1 + ret) as w, avg(ret) as mu, stddev_samp(ret) as sd, sqrt(avg(least(ret, 0) ** 2)) as dn, avg((ret > 0)::int) as hit, max(ret) as hi, min(ret) as lo, skewness(ret) as sk, kurtosis(ret) as ku from wk)
select n as n_periods, round((w - 1) * 100, 6) as total_return_pct, round(case when w > 0 then (w ** (52.0 / n) - 1) * 100 else -100 end, 6) as cagr_pct, round(sd * sqrt(52) * 100, 6) as volatility_pct, round(mu / sd * sqrt(52), 6) as sharpe, round(mu / dn * sqrt(52), 6) as sortino,
round(hit * 100, 6) as hit_rate_pct, round(hi * 100, 6) as best_period_pct, round(lo * 100, 6) as worst_period_pct, round(sk, 6) as skew, round(ku, 6) as excess_kurtosis, round(max_drawdown * 100, 6) as max_drawdown_pct, longest as max_drawdown_periods,
round(case when max_drawdown < -1e-12 then (case when w > 0 then w ** (52.0 / n) - 1 else -1 end) / abs(max_drawdown) end, 6) as calmar from st, uw"""


def newey_west(spark, sf_dir):
    r = m.newey_west(daily_revenue(spark, sf_dir), 5)
    return r.select("n", rounded("mean").alias("mean"), rounded("t_stat").alias("t_stat"))


NW_SQL = f"""with {DAILY_SQL}, d as (select date, ret - avg(ret) over () as d from daily), g as (select sum(d * d) as g0, {', '.join(f'sum(d * l{i}) as g{i}' for i in range(1, 6))} from (select d, {', '.join(f'lag(d, {i}) over (order by date) as l{i}' for i in range(1, 6))} from d)),
c as (select count(*) as n, avg(ret) as mu from daily) select n, round(mu, 6) as mean, round(mu / sqrt((g0 + {' + '.join(f'2 * (1 - {i} / 6.0) * g{i}' for i in range(1, 6))}) / n / (n - 1)), 6) as t_stat from c, g"""


def _pairs(spark, sf_dir):
    """Weekly returns of the benchmark and of the mean bar."""
    from pyspark.sql import Window

    w = Window.orderBy("date")
    market = benchmark(spark, sf_dir).withColumn("x", F.col("level") / F.lag("level").over(w) - 1)
    mean = bars(spark, sf_dir).groupBy("date").agg(F.avg("close").alias("v")).withColumn("y", F.col("v") / F.lag("v").over(w) - 1)
    return mean.join(market, "date").select("date", "y", "x")


def ols_hac(spark, sf_dir):
    r = m.ols_newey_west(_pairs(spark, sf_dir), "y", ["x"], 3)
    return r.select("term", rounded("beta").alias("beta"), rounded("t_stat", 5).alias("t_stat"), rounded("r2").alias("r2"), "n")


OLS_SQL = f"""with {BARS_SQL}, {BENCHMARK_SQL}, mk as (select date, level / lag(level) over (order by date) - 1 as x from benchmark_series), mn as (select date, v / lag(v) over (order by date) - 1 as y from (select date, avg(close) as v from bars group by 1)),
pr as (select date, y, x from mn join mk using (date) where x is not null and y is not null), b as (select regr_slope(y, x) as b1, regr_intercept(y, x) as b0, regr_r2(y, x) as r2, count(*) as n, sum(x) as sx, sum(x * x) as sxx from pr),
e as (select date, x, y - b0 - b1 * x as e from pr, b), s as (select e as s0, e * x as s1, {', '.join(f'lag(e, {i}) over (order by date) as l{i}0, lag(e * x, {i}) over (order by date) as l{i}1' for i in (1, 2, 3))} from e),
g as (select sum(s0 * s0) + {' + '.join(f'2 * (1 - {i} / 4.0) * sum(s0 * l{i}0)' for i in (1, 2, 3))} as m00, sum(s0 * s1) + {' + '.join(f'(1 - {i} / 4.0) * (sum(s0 * l{i}1) + sum(s1 * l{i}0))' for i in (1, 2, 3))} as m01, sum(s1 * s1) + {' + '.join(f'2 * (1 - {i} / 4.0) * sum(s1 * l{i}1)' for i in (1, 2, 3))} as m11 from s),
i as (select sxx / (n * sxx - sx * sx) as i00, -sx / (n * sxx - sx * sx) as i01, n / (n * sxx - sx * sx) as i11 from b),
v as (select (i00 * i00 * m00 + 2 * i00 * i01 * m01 + i01 * i01 * m11) * n / (n - 2) as v0, (i01 * i01 * m00 + 2 * i01 * i11 * m01 + i11 * i11 * m11) * n / (n - 2) as v1 from i, g, b)
select 'const' as term, round(b0, 6) as beta, round(b0 / sqrt(v0), 5) as t_stat, round(r2, 6) as r2, n from b, v union all select 'x', round(b1, 6), round(b1 / sqrt(v1), 5), round(r2, 6), n from b, v"""


def asof_benchmark(spark, sf_dir):
    """The benchmark at or before each bar, of every second week only."""
    b = benchmark(spark, sf_dir).where("weekofyear(date) % 2 = 0").withColumnRenamed("date", "bdate")
    return a.asof(bars(spark, sf_dir).select("ticker", "date"), b, "date", "bdate", ["level"]).select("ticker", DAY("date"), rounded("level").alias("level"))


ASOF_SQL = f"with {BARS_SQL}, {BENCHMARK_SQL}, e as (select * from benchmark_series where weekofyear(date) % 2 = 0) select ticker, cast(bars.date as varchar) as date, round(level, 6) as level from bars asof left join e on bars.date >= e.date"


def asof_tolerance(spark, sf_dir):
    """Each order beside the customer's last earlier-or-same-day urgent order, not older than 31 days."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_orderpriority", "o_totalprice")
    urgent = o.where("o_orderpriority = '1-URGENT'").groupBy("k", F.col("date").alias("udate")).agg(F.max("o_totalprice").alias("price"))
    got = a.asof(o.select("k", "date", "o_orderkey"), urgent, "date", "udate", ["price"], ["k"], 31)
    return got.select("o_orderkey", rounded("price").alias("price"))


TOL_SQL = """with o as (select o_custkey as k, cast(o_orderdate as date) as date, o_orderkey, o_orderpriority, o_totalprice from orders), u as (select k, date, max(o_totalprice) as price from o where o_orderpriority = '1-URGENT' group by 1, 2)
select o_orderkey, case when o.date - u.date <= 31 then round(price, 6) end as price from o asof left join u on o.k = u.k and o.date >= u.date"""


def nearest_within(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_orderpriority", "o_totalprice")
    low = o.where("o_orderpriority = '5-LOW'").groupBy("k", F.col("date").alias("ldate")).agg(F.max("o_totalprice").alias("price"))
    got = a.nearest_within(o.select("k", "date", "o_orderkey"), low, "date", "ldate", 10, ["price"], ["k"])
    return got.select("o_orderkey", DAY("ldate"), rounded("price").alias("price"))


NEAR_SQL = """with o as (select o_custkey as k, cast(o_orderdate as date) as date, o_orderkey, o_orderpriority, o_totalprice from orders), l as (select k, date as ldate, max(o_totalprice) as price from o where o_orderpriority = '5-LOW' group by 1, 2),
x as (select o_orderkey, ldate, price, row_number() over (partition by o_orderkey order by abs(o.date - ldate), ldate) as r from o join l on o.k = l.k and abs(o.date - ldate) <= 10) select o_orderkey, cast(ldate as varchar) as ldate, round(price, 6) as price from x where r = 1"""


def interval_compound(spark, sf_dir):
    """Daily returns compounded onto the intervals between benchmark dates, the end included."""
    from pyspark.sql import Window

    ends = benchmark(spark, sf_dir).select(F.col("date").alias("stop")).withColumn("start", F.lag("stop").over(Window.orderBy("stop"))).where("start is not null")
    r = daily_revenue(spark, sf_dir)
    return r.join(ends, (r.date > F.col("start")) & (r.date <= F.col("stop"))).groupBy("stop").agg(F.product(1 + F.col("ret")).alias("g"), F.count("*").alias("n")).select(DAY("stop"), rounded(F.col("g") - 1).alias("ret"), "n")


INTERVAL_SQL = f"with {BENCHMARK_SQL}, {DAILY_SQL}, e as (select date as stop, lag(date) over (order by date) as start from benchmark_series) select cast(stop as varchar) as stop, round(product(1 + ret) - 1, 6) as ret, count(*) as n from daily join e on daily.date > start and daily.date <= stop group by 1"

QUERIES = {
    **{f"compound_{k}": compounded(v) for k, v in {"weekly": "W", "monthly": "M", "quarterly": "Q", "annual": "Y"}.items()},
    "drawdown_curve": drawdown_curve, "underwater_run": underwater_run, "perf_stats": perf_stats, "newey_west": newey_west, "ols_hac": ols_hac,
    "asof_benchmark": asof_benchmark, "asof_tolerance": asof_tolerance, "nearest_within": nearest_within, "interval_compound": interval_compound,
}
SQL = {
    **{f"compound_{k}": compounded_sql(v) for k, v in {"weekly": "W", "monthly": "M", "quarterly": "Q", "annual": "Y"}.items()},
    "drawdown_curve": f"with {WEEKLY} select cast(date as varchar) as date, round(drawdown, 6) as drawdown from dd",
    "underwater_run": f"with {UNDER} select round(max_drawdown, 6) as max_drawdown, longest from uw",
    "perf_stats": PERF_SQL, "newey_west": NW_SQL, "ols_hac": OLS_SQL, "asof_benchmark": ASOF_SQL, "asof_tolerance": TOL_SQL, "nearest_within": NEAR_SQL, "interval_compound": INTERVAL_SQL,
}
