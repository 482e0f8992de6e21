"""Verdicts, scores, ledgers and the sequential simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions.numbers import rounded
from gristmill.operators import book, portfolio
from gristmill.operators import verdicts as v
from gristmill.sources.tables import bars, read
from gristmill.streaming import ledger


def strategy_verdicts(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    t = F.when(F.col("p_partkey") % 6 != 0, F.col("p_size") / 12 - 0.5)
    m = F.when(F.col("p_partkey") % 4 != 0, (F.col("p_partkey") % 11) / 10)
    out = v.verdict(F.col("p_size") / 5, F.col("p_retailprice") / 1500, t, m, m.isNotNull())
    return p.select("p_partkey", out.alias("verdict"))


VERDICT_SQL = """with x as (select p_partkey, p_size / 5 as y, p_retailprice / 1500 as s, case when p_partkey % 6 <> 0 then p_size / 12 - 0.5 end as t, case when p_partkey % 4 <> 0 then (p_partkey % 11) / 10 end as m from part)
select p_partkey, case when y < 3 then 'inconclusive' when s >= 0.8 and coalesce(t >= 3, false) and (m is null or m >= 0.8) then 'robust' when coalesce(t >= 2, false) or (s >= 0.5 and coalesce(m >= 0.6, false)) then 'promising' when coalesce(t < 1 and m < 0.3, false) then 'likely_spurious' else 'weak' end as verdict from x"""


def replication_verdicts(spark, sf_dir):
    """Each customer's run: the base Sharpe ratio against those of its variants."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", (F.col("o_totalprice") / 150000 - 0.7).alias("sharpe"), "o_orderpriority")
    base = o.groupBy("k").agg(F.avg("sharpe").alias("base"))
    kind = {"1-URGENT": "subperiod", "2-HIGH": "published", "3-MEDIUM": "cost", "5-LOW": "perturbed"}
    check = F.lit(None).cast("boolean")
    for name, rule in kind.items():
        check = F.when(F.col("o_orderpriority") == name, v.passed(rule, F.col("sharpe"), F.col("base"))).otherwise(check)
    n = o.join(base, "k").withColumn("ok", check).groupBy("k", "base").agg(F.count("ok").alias("runnable"), F.sum(F.col("ok").cast("long")).alias("passes"))
    t = F.when(F.col("k") % 3 != 0, F.col("base") * 5)
    out = v.replication(F.col("base"), t, F.col("k") % 20 + 1, F.coalesce("passes", F.lit(0)), F.col("runnable"), F.when(F.col("k") % 2 == 0, F.col("base")))
    return n.select("k", out.alias("verdict"))


REPL_SQL = """with o as (select o_custkey as k, o_totalprice / 150000 - 0.7 as s, o_orderpriority as p from orders), b as (select k, avg(s) as base from o group by 1),
c as (select o.k, base, case p when '1-URGENT' then s > 0 and base > 0 when '2-HIGH' then s > 0 and s >= 0.5 * base - 1e-9 when '3-MEDIUM' then s > 0 when '5-LOW' then s > 0 and base > 0 and s >= 0.5 * base - 1e-9 end as ok from o join b using (k)),
n as (select k, base, count(ok) as r, coalesce(sum(ok::int), 0) as p from c group by 1, 2), x as (select *, case when r > 0 then p / r end as sh, case when k % 3 <> 0 then base * 5 end as t, case when k % 2 = 0 then base end as ratio from n)
select k, case when k % 20 + 1 < 3 or r = 0 then 'inconclusive' when base > 0 and coalesce(t >= 2, base >= 0.5) and sh >= 0.75 - 1e-9 and coalesce(ratio >= 0.5, true) then 'replicates' when base > 0 and sh >= 0.5 - 1e-9 then 'partially_replicates' else 'fails_to_replicate' end as verdict from x"""


def idea_scores(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    period = F.concat(F.lit("from "), (1990 + F.col("p_size") % 25).cast("string"), F.when(F.col("p_partkey") % 3 == 0, " to present").otherwise(F.concat(F.lit("-"), (2000 + F.col("p_size") % 20).cast("string"))))
    years = v.sample_years(period, 2026)
    parts = {"testability": F.col("p_partkey") % 3 / 2, "evidence": F.col("p_partkey") % 5 / 4, "credibility": v.credibility(F.col("p_size") / 10, years, F.col("p_partkey") % 7 == 0), "novelty": F.col("p_partkey") % 2 * 1.0, "recency": F.lit(0.5)}
    return p.select("p_partkey", years.cast("long").alias("years"), v.idea_score(parts, F.col("p_partkey") % 10 == 0).alias("score"))


IDEA_SQL = """with x as (select p_partkey as k, p_size, case when p_partkey % 3 = 0 then 2026 - (1990 + p_size % 25) else abs((2000 + p_size % 20) - (1990 + p_size % 25)) end as years from part),
c as (select *, ((case when p_size / 10 >= 3 then 1.0 when p_size / 10 >= 2 then 0.5 else 0 end) + (case when years >= 20 then 1.0 when years >= 10 then 0.5 else 0 end) + (k % 7 = 0)::int) / 3 as cred from x),
t as (select *, 0.35 * (k % 3) / 2 + 0.2 * (k % 5) / 4 + 0.2 * cred + 0.15 * (k % 2) + 0.05 as tot from c) select k as p_partkey, years::bigint as years, round((case when k % 10 = 0 then least(tot, 0.25) else tot end)::double, 4) as score from t"""


def ledger_orders(spark, sf_dir):
    """Accounts by region of the ticker's number, rebalanced to equal weights each quarter."""
    b = bars(spark, sf_dir).withColumn("account", (F.col("ticker") % 4).cast("string"))
    dates = portfolio.rebalance_dates(b, "quarterly")
    days = b.join(dates, "date").select("account", "date", F.col("ticker").cast("string").alias("ticker"), F.lit(0.05).alias("weight"), F.col("close").alias("price"))
    o = ledger.fold(days, 1e6, costs_bps=10.0, min_trade=0.001)
    return o.select("account", F.col("date").cast("string").alias("date"), "ticker", rounded("shares", 4).alias("shares"), rounded("nav", 2).alias("nav"))


def simulate_gaps(spark, sf_dir):
    """Two books over all names, halts and all, rebalanced each quarter."""
    b = bars(spark, sf_dir)
    dates = portfolio.rebalance_dates(b, "quarterly").withColumnRenamed("date", "signal_date")
    on = b.join(dates, b.date == dates.signal_date).withColumn("book", (F.col("ticker") % 2).cast("string"))
    n = on.groupBy("book", "signal_date").agg(F.count("*").alias("n"))
    targets = on.join(n, ["book", "signal_date"]).select("book", "signal_date", "ticker", (1 / F.col("n")).alias("weight"))
    return book.simulate_gaps(targets, b, 25.0, 1, -0.3).select("book", "session", *(rounded(c).alias(c) for c in ("gross", "net", "turnover")))


def verdict_caps(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    names = F.array(*map(F.lit, v.ORDER))
    found = F.element_at(names, (F.col("p_size") % 5 + 1).cast("int"))
    return p.select("p_partkey", v.capped(found, F.col("p_partkey") % 4 == 0, F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 3 == 0)).alias("verdict"))


CAPS_SQL = """with x as (select p_partkey, p_size % 5 as r, p_partkey % 4 = 0 as l, coalesce(case when p_partkey % 5 <> 0 then p_partkey % 3 = 0 end, false) as s from part)
select p_partkey, case least(r, case when l then 0 when s then 3 else 4 end) when 0 then 'inconclusive' when 1 then 'likely_spurious' when 2 then 'weak' when 3 then 'promising' else 'robust' end as verdict from x"""


def cited_metrics(spark, sf_dir):
    """Prices cited with one or two decimals, some of them off, as t statistics."""
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 700 - 1).alias("actual"), (F.col("p_partkey") % 3).alias("d"))
    off = (F.col("p_partkey") % 10) * 0.004 - 0.016
    cited = F.round((F.col("actual") + off) * 100) / 100
    return p.select("p_partkey", v.citation(cited, F.col("d"), F.when(F.col("p_partkey") % 7 != 0, F.col("actual")), "t").alias("status"))


CITED_SQL = """with p as (select p_partkey as k, p_retailprice / 700 - 1 as a, greatest(p_partkey % 3, 1) as d from part), c as (select *, round((a + ((k % 10) * 0.004 - 0.016)) * 100) / 100 as c from p),
x as (select *, abs(c - a) <= 0.01 * greatest(abs(c), abs(a)) or abs(sign(a) * floor(abs(a) * 10 ** d + 0.5) / 10 ** d - c) < 1e-9 as near, round(a, 4) = 0 or sign(c) = sign(a) as sgn, (abs(c) >= 1) = (abs(a) >= 1) and (abs(c) >= 2) = (abs(a) >= 2) and (abs(c) >= 3) = (abs(a) >= 3) as side from c)
select k as p_partkey, case when k % 7 = 0 then 'not_found' when near and sgn and side then 'verified' else 'mismatch' end as status from x"""

QUERIES = {"strategy_verdicts": strategy_verdicts, "replication_verdicts": replication_verdicts, "idea_scores": idea_scores, "ledger_orders": ledger_orders, "simulate_gaps": simulate_gaps, "verdict_caps": verdict_caps, "cited_metrics": cited_metrics}
SQL = {"strategy_verdicts": VERDICT_SQL, "replication_verdicts": REPL_SQL, "idea_scores": IDEA_SQL, "verdict_caps": CAPS_SQL, "cited_metrics": CITED_SQL}
