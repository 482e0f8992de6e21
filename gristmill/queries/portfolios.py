"""Ranks, legs, weights, calendars, forward returns and simulation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions.numbers import rounded
from gristmill.operators import features, windows
from gristmill.operators import portfolio as p
from gristmill.plans import screen as s
from gristmill.queries.screens import BASE, frame, pct
from gristmill.sources.tables import BARS_SQL, bars, read

DAY = lambda c: F.col(c).cast("string").alias(c)


def factor_percentile(spark, sf_dir):
    f = frame(spark, sf_dir)
    return f.select("ticker", rounded(windows.percentile_rank("market_cap_usd_bn")).alias("up"), rounded(windows.percentile_rank("return_6m_pct", higher=False)).alias("down"))


def composite_rank(spark, sf_dir):
    f = frame(spark, sf_dir)
    ranked = s.rank(f, (s.RankFactor("return_6m_pct", True, 2.0), s.RankFactor("volatility_60d_pct", False)), None)
    return ranked.select("ticker", rounded("score", 9).alias("score"))


def composite_zscore(spark, sf_dir):
    """Weighted mean of standard scores over the components that a name has."""
    f = frame(spark, sf_dir).withColumn("a", windows.zscore("return_6m_pct")).withColumn("b", windows.zscore("volatility_60d_pct"))
    have = F.when(F.col("a").isNotNull(), 2.0).otherwise(0.0) + F.when(F.col("b").isNotNull(), 1.0).otherwise(0.0)
    signal = F.when(have > 0, (F.coalesce(F.col("a") * 2, F.lit(0.0)) - F.coalesce("b", F.lit(0.0))) / have)
    return f.select("ticker", rounded(signal).alias("signal"))


def sector_neutral(spark, sf_dir):
    f = frame(spark, sf_dir)
    return f.select("ticker", "gics_sector", rounded(windows.percentile_rank("return_6m_pct", "gics_sector", missing=None, alone=0.5)).alias("signal"))


Z = "greatest(-3.0, least(3.0, case when stddev_samp({x}) over () > 1e-12 then ({x} - avg({x}) over ()) / stddev_samp({x}) over () else 0 end))"
ZSCORE_SQL = f"""{BASE}, z as (select ticker, case when return_6m_pct is not null then {Z.format(x='return_6m_pct')} end as a, case when volatility_60d_pct is not null then {Z.format(x='volatility_60d_pct')} end as b from fr),
h as (select *, (a is not null)::int * 2.0 + (b is not null)::int as have from z) select ticker, case when have > 0 then round((coalesce(2 * a, 0) - coalesce(b, 0)) / have, 6) end as signal from h"""


def quantile_buckets(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ticker"), F.col("p_brand").alias("grp"), F.col("p_retailprice").alias("signal"))
    return rows.select("grp", "ticker", windows.buckets("signal", 4, "grp").alias("bucket"))


def _signals(spark, sf_dir):
    f = frame(spark, sf_dir).withColumn("signal_date", F.col("date"))
    return f.select("signal_date", "ticker", F.col("return_6m_pct").alias("signal"), "market_cap", F.col("volatility_60d_pct").alias("volatility"))


def leg_weights(kind, cap=None, top_n=None):
    def query(spark, sf_dir):
        rows = p.weights(p.legs(_signals(spark, sf_dir), 5, top_n), kind, cap)
        return rows.select("ticker", F.col("leg").cast("long").alias("leg"), rounded("weight").alias("weight"))

    return query


SIGNALS_SQL = f"""{BASE}, sg as (select ticker, return_6m_pct as signal, market_cap, volatility_60d_pct as volatility from fr where return_6m_pct is not null),
rk as (select *, row_number() over (order by signal desc, ticker) as best, count(*) over () as n from sg), rw as (select *, n + 1 - best as worst from rk)"""


def leg_sql(raw: str, cap: float | None = None, top_n: int | None = None) -> str:
    if top_n:
        leg = f"case when best <= least({top_n}, n // 2) then 1 when worst <= least({top_n}, n // 2) then -1 end"
    else:
        leg = "case when (worst - 1) * 5 // n + 1 = 5 and n >= 5 then 1 when (worst - 1) * 5 // n + 1 = 1 and n >= 5 then -1 end"
    out = f"{SIGNALS_SQL}, lg as (select * from (select *, {leg} as leg from rw) where leg is not null), pl as (select *, case when leg = 1 then best else worst end as place from lg), ra as (select *, {raw} as raw from pl), ws as (select *, raw / sum(raw) over (partition by leg) as w from ra where raw > 0)"
    if not cap:
        return f"{out} select ticker, leg::bigint as leg, round(w * leg, 6) as weight from ws"
    return f"""{out}, c1 as (select *, row_number() over (partition by leg order by w desc, ticker) - 1 as k, count(*) over (partition by leg) as m, sum(w) over (partition by leg order by w desc, ticker rows between current row and unbounded following) as rest from ws),
c2 as (select leg, min(k) as k0 from c1 where w / rest * (1 - {cap} * k) <= {cap} * (1 + 1e-12) group by 1), c3 as (select c1.*, k0, max(case when k = k0 then rest end) over (partition by leg) as r0 from c1 left join c2 using (leg))
select ticker, leg::bigint as leg, round(leg * case when {cap} * m <= 1 + 1e-12 then {cap} when k < k0 then {cap} else w / r0 * (1 - {cap} * k0) end, 6) as weight from c3"""


def rebalance_calendar(spark, sf_dir):
    days = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    frames = [p.rebalance_dates(days, f, "1996-02-10", "2000-11-20").select(F.lit(f).alias("freq"), DAY("date")) for f in ("weekly", "monthly", "quarterly", "annual")]
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


CALENDAR_SQL = " union all ".join(
    f"select '{f}' as freq, cast(max(d) as varchar) as date from (select distinct cast(o_orderdate as date) as d from orders) group by date_trunc('{u}', d) having max(d) between date '1996-02-10' and date '2000-11-20'" for f, u in p.PERIODS.items()
)


def execution_sessions(spark, sf_dir):
    b = bars(spark, sf_dir)
    cal = p.sessions(b)
    dates = p.rebalance_dates(b, "monthly").withColumnRenamed("date", "signal_date")
    a, z = p.executions(dates, cal, 1).withColumnRenamed("session", "lag1"), p.executions(dates, cal, 0).withColumnRenamed("session", "lag0")
    return z.join(a, "signal_date").select(DAY("signal_date"), F.col("lag0").cast("long").alias("lag0"), F.col("lag1").cast("long").alias("lag1"))


SESSIONS_SQL = "cal as (select date, row_number() over (order by date) - 1 as session from (select distinct date from bars)), sd as (select max(date) as signal_date from cal group by date_trunc('month', date))"
EXEC_SQL = f"with {BARS_SQL}, {SESSIONS_SQL} select cast(signal_date as varchar) as signal_date, (select min(session) from cal where date >= signal_date) as lag0, (select min(session) from cal where date > signal_date) as lag1 from sd where signal_date < (select max(date) from cal)"

GRID_SQL = f"""{BARS_SQL}, {SESSIONS_SQL}, own as (select ticker, session, close as px from bars join cal using (date)), fst as (select ticker, min(session) as first, max(session) as last_session from own group by 1),
grid as (select fst.ticker, cal.session, last_session, px, last_value(px ignore nulls) over (partition by fst.ticker order by cal.session rows between unbounded preceding and current row) as carried,
 first_value(px ignore nulls) over (partition by fst.ticker order by cal.session rows between current row and unbounded following) as following
 from fst join cal on cal.session >= first left join own on own.ticker = fst.ticker and own.session = cal.session),
ex as (select signal_date, min(session) as session from sd join cal on date > signal_date group by 1), sp as (select * from (select *, lead(session) over (order by signal_date) as until from ex) where until > session)"""
FWD_SQL = f"with {GRID_SQL}, fw as (select sp.signal_date, e.ticker, (case when sp.until > x.last_session then x.carried * 0.7 else coalesce(x.px, x.following) end) / e.px - 1 as forward_return from sp join grid e on e.session = sp.session and e.px > 0 join grid x on x.ticker = e.ticker and x.session = sp.until)"


def _forward(spark, sf_dir):
    b = bars(spark, sf_dir)
    dates = p.rebalance_dates(b, "monthly").withColumnRenamed("date", "signal_date")
    return p.forward_returns(b, dates, 1, -0.3)


def forward_returns(spark, sf_dir):
    return _forward(spark, sf_dir).select(DAY("signal_date"), "ticker", rounded("forward_return").alias("forward_return"))


def _with_signal(spark, sf_dir):
    f = features.technical(bars(spark, sf_dir)).select("ticker", F.col("date").alias("signal_date"), F.col("return_1m_pct").alias("signal"))
    return _forward(spark, sf_dir).join(f, ["ticker", "signal_date"])


def quantile_ic(spark, sf_dir):
    return p.information_coefficients(_with_signal(spark, sf_dir), 3).select(DAY("signal_date"), rounded("ic").alias("ic"))


def quantile_returns(spark, sf_dir):
    r = p.quantile_returns(_with_signal(spark, sf_dir), 3)
    return r.select(DAY("signal_date"), "bucket", rounded("mean_return").alias("mean_return"), "n")


SIGNAL_FWD_SQL = f"{FWD_SQL}, bb as (select *, row_number() over (partition by ticker order by date) as bar_no from bars), rr as (select ticker, date, (close / lag(close, 21) over (partition by ticker order by bar_no) - 1) * 100 as signal from bb), sf as (select fw.*, signal, count(*) over (partition by signal_date) as n from fw join rr on rr.ticker = fw.ticker and rr.date = fw.signal_date where signal is not null and forward_return is not null), sk as (select * from sf where n >= 9)"
RANK = "rank() over (partition by signal_date order by {x}) + (count(*) over (partition by signal_date, {x}) - 1) / 2.0"
IC_SQL = f"{SIGNAL_FWD_SQL} select cast(signal_date as varchar) as signal_date, round(corr(a, b), 6) as ic from (select signal_date, {RANK.format(x='signal')} as a, {RANK.format(x='forward_return')} as b from sk) group by 1 having corr(a, b) is not null and not isnan(corr(a, b))"
QR_SQL = f"{SIGNAL_FWD_SQL}, qb as (select *, (row_number() over (partition by signal_date order by signal, ticker desc) - 1) * 3 // n + 1 as bucket from sk) select cast(signal_date as varchar) as signal_date, bucket, round(avg(forward_return), 6) as mean_return, count(*) as n from qb group by 1, 2"


def _targets(spark, sf_dir):
    """Equal weights of the names that trade on the execution day, quarter by quarter."""
    b = bars(spark, sf_dir)
    cal = p.sessions(b)
    dates = p.rebalance_dates(b, "quarterly").withColumnRenamed("date", "signal_date")
    ex = p.executions(dates, cal, 1)
    # names that trade on every execution session, so that none is stuck
    on = b.join(cal, "date").join(ex, "session")
    n = ex.count()  # a few dozen quarters
    ever = on.groupBy("ticker").agg(F.count("*").alias("k")).where(F.col("k") >= int(0.6 * n)).select("ticker")
    rows = on.join(ever, "ticker")
    w = 1 / F.count(F.lit(1)).over(Window.partitionBy("signal_date"))
    return b, rows.select("signal_date", "ticker", w.alias("weight"))


def simulate_book(spark, sf_dir):
    b, targets = _targets(spark, sf_dir)
    daily, _ = p.simulate(targets, b, 25.0)
    return daily.select(F.col("session").cast("long").alias("session"), rounded("gross").alias("gross"), rounded("net").alias("net"))


def turnover_costs(spark, sf_dir):
    b, targets = _targets(spark, sf_dir)
    _, done = p.simulate(targets, b, 25.0)
    return done.select(F.col("session").cast("long").alias("session"), rounded("turnover").alias("turnover"), rounded("traded").alias("traded"), rounded("cost").alias("cost"))


BOOK_SQL = f"""{GRID_SQL.replace("date_trunc('month', date)", "date_trunc('quarter', date)")},
onx as (select ex.signal_date, ex.session, own.ticker from ex join own using (session)), ev as (select ticker from onx group by 1 having count(*) >= (select floor(0.6 * count(*)) from ex)),
tg as (select onx.*, 1.0 / count(*) over (partition by signal_date) as weight from onx join ev using (ticker)),
sn as (select signal_date, session, lead(session) over (order by session) as nxt, (select max(session) from cal) as fin from ex),
bk as (select tg.ticker, tg.session as period, coalesce(nxt, fin) as until, nxt, weight, g.px as entry from tg join sn using (signal_date) join grid g on g.ticker = tg.ticker and g.session = tg.session),
pa as (select bk.*, g.session, g.carried / entry as growth, g.session > g.last_session as dead from bk join grid g on g.ticker = bk.ticker and g.session between period and until),
nv as (select period, until, nxt, session, 1 + sum(weight * (growth - 1)) as nav from pa group by all),
gr as (select period, session, nav / lag(nav) over (partition by period order by session) - 1 as gross from nv),
dr as (select pa.nxt as period, ticker, weight * growth / nav as before from pa join nv using (period, session) where pa.session = pa.nxt and not dead),
td as (select coalesce(bk.period, dr.period) as session, sum(abs(coalesce(weight, 0) - coalesce(before, 0))) as traded from bk full join dr on bk.period = dr.period and bk.ticker = dr.ticker group by 1)"""
SIM_SQL = f"with {BOOK_SQL} select cal.session, round(coalesce(gross, 0), 6) as gross, round(coalesce(gross, 0) - coalesce(traded * 25 / 1e4, 0), 6) as net from cal left join (select * from gr where session > period) gr on gr.session = cal.session left join td on td.session = cal.session where cal.session >= (select min(session) from ex)"
TURN_SQL = f"with {BOOK_SQL} select session, round(traded / 2, 6) as turnover, round(traded, 6) as traded, round(traded * 25 / 1e4, 6) as cost from td"

QUERIES = {
    "factor_percentile": factor_percentile,
    "composite_rank": composite_rank,
    "composite_zscore": composite_zscore,
    "sector_neutral": sector_neutral,
    "quantile_buckets": quantile_buckets,
    "leg_weights_equal": leg_weights("equal"),
    "leg_weights_value": leg_weights("value"),
    "leg_weights_signal": leg_weights("signal"),
    "leg_weights_invvol": leg_weights("inverse_vol"),
    "capped_weights": leg_weights("value", 0.12),
    "top_n_legs": leg_weights("equal", None, 7),
    "rebalance_calendar": rebalance_calendar,
    "execution_sessions": execution_sessions,
    "forward_returns": forward_returns,
    "quantile_ic": quantile_ic,
    "quantile_returns": quantile_returns,
    "simulate_book": simulate_book,
    "turnover_costs": turnover_costs,
}
SQL = {
    "factor_percentile": f"{BASE}, m as (select *, case when market_cap > 0 then market_cap / 1e9 end as mc from fr) select ticker, round({pct('mc')}, 6) as up, round({pct('return_6m_pct', False)}, 6) as down from m",
    "composite_rank": f"{BASE} select ticker, round(round({pct('return_6m_pct')} * (2.0 / 3) + {pct('volatility_60d_pct', False)} * (1.0 / 3), 12), 9) as score from fr",
    "composite_zscore": ZSCORE_SQL,
    "sector_neutral": f"{BASE} select ticker, gics_sector, case when return_6m_pct is not null then round(case when count(return_6m_pct) over (partition by gics_sector) = 1 then 0.5 else {pct('return_6m_pct', by='gics_sector')} end, 6) end as signal from fr",
    "quantile_buckets": "select p_brand as grp, p_partkey as ticker, (row_number() over (partition by p_brand order by p_retailprice, p_partkey desc) - 1) * 4 // count(*) over (partition by p_brand) + 1 as bucket from part",
    "leg_weights_equal": leg_sql("1.0"),
    "leg_weights_value": leg_sql("market_cap"),
    "leg_weights_signal": leg_sql("max(place) over (partition by leg) - place + 1"),
    "leg_weights_invvol": leg_sql("case when volatility > 0 then 1 / volatility end"),
    "capped_weights": leg_sql("market_cap", 0.12),
    "top_n_legs": leg_sql("1.0", None, 7),
    "rebalance_calendar": CALENDAR_SQL,
    "execution_sessions": EXEC_SQL,
    "forward_returns": f"{FWD_SQL} select cast(signal_date as varchar) as signal_date, ticker, round(forward_return, 6) as forward_return from fw",
    "quantile_ic": IC_SQL,
    "quantile_returns": QR_SQL,
    "simulate_book": SIM_SQL,
    "turnover_costs": TURN_SQL,
}
