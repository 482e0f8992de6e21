"""Screens and features over weekly bars of suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions.numbers import rounded
from gristmill.operators import features, windows
from gristmill.operators.cross_section import technical_at
from gristmill.plans import screen as s
from gristmill.plans.catalog import CATALOG
from gristmill.sources.tables import AS_OF, BARS_AS_OF_SQL, BARS_SQL, BENCHMARK_AS_OF_SQL, UNIVERSE_SQL, bars, benchmark, read, universe

NUMBERED = "b as (select *, row_number() over (partition by ticker order by date) as bar_no from bars)"
LAST = "where date = (select max(date) from bars)"


def w(n: int) -> str:
    return f"over (partition by ticker order by bar_no rows between {n - 1} preceding and current row)"


def full(agg: str, x: str, n: int) -> str:
    return f"case when count({x}) {w(n)} = {n} then {agg}({x}) {w(n)} end"


def lagged(x: str, n: int) -> str:
    return f"lag({x}, {n}) over (partition by ticker order by bar_no)"


ALL_FEATURES_SQL = f"""{BARS_SQL}, {NUMBERED},
f1 as (select *, {', '.join(f'{full("avg", "close", n)} as sma_{n}' for n in (20, 50, 200))},
 {', '.join(f'(close / {lagged("close", n)} - 1) * 100 as return_{k}_pct' for k, n in (('1m', 21), ('3m', 63), ('6m', 126), ('12m', 252)))},
 ({lagged('close', 21)} / {lagged('close', 252)} - 1) * 100 as return_12m_ex_1m_pct,
 close / {lagged('close', 1)} - 1 as ret, ln(close / {lagged('close', 1)}) as lret,
 greatest(high - low, abs(high - {lagged('close', 1)}), abs(low - {lagged('close', 1)})) as tr,
 {full('max', 'high', 252)} as high_52w, {full('min', 'low', 252)} as low_52w, close * volume as dv from b),
f2 as (select *, {full('avg', 'dv', 20)} / 1e6 as avg_dollar_volume_20d_usd_mn,
 {full('stddev_samp', 'lret', 20)} * sqrt(252) * 100 as volatility_20d_pct, {full('stddev_samp', 'lret', 60)} * sqrt(252) * 100 as volatility_60d_pct,
 {full('avg', 'volume', 5)} / {full('avg', 'volume', 60)} as rel_volume_5d, {full('avg', 'volume', 20)} / {full('avg', 'volume', 120)} as rel_volume_20d,
 {full('max', 'volume', 20)} / {full('avg', 'volume', 120)} as max_volume_ratio_20d,
 case when count(ret) {w(50)} = 50 and sum(case when ret < 0 then volume else 0 end) {w(50)} > 0 then sum(case when ret > 0 then volume else 0 end) {w(50)} / sum(case when ret < 0 then volume else 0 end) {w(50)} end as up_down_volume_ratio_50d,
 (close / sma_50 - 1) * 100 as price_vs_sma_50_pct, (close / sma_200 - 1) * 100 as price_vs_sma_200_pct, (sma_50 / sma_200 - 1) * 100 as sma_50_vs_sma_200_pct,
 (sma_200 / {lagged('sma_200', 21)} - 1) * 100 as sma_200_slope_1m_pct, (close / high_52w - 1) * 100 as drawdown_from_52w_high_pct, (close / low_52w - 1) * 100 as above_52w_low_pct,
 case when high_52w is not null then bar_no - max(case when high = high_52w then bar_no end) {w(252)} end as since0,
 case when sma_50 > sma_200 and {lagged('sma_50', 1)} <= {lagged('sma_200', 1)} then 1.0::double else 0.0::double end as turn, (sma_50 is not null and sma_200 is not null)::int as known from f1),
f as (select *, case when sum(known) {w(21)} = 21 then max(turn) {w(20)} end as golden_cross_20d from f2)"""

FEATURES_SQL = ALL_FEATURES_SQL.replace(BARS_SQL, BARS_AS_OF_SQL)

NAMES = "price sma_20 sma_50 sma_200 return_1m_pct return_3m_pct return_6m_pct return_12m_pct return_12m_ex_1m_pct high_52w low_52w avg_dollar_volume_20d_usd_mn volatility_20d_pct volatility_60d_pct rel_volume_5d rel_volume_20d max_volume_ratio_20d up_down_volume_ratio_50d price_vs_sma_50_pct price_vs_sma_200_pct sma_50_vs_sma_200_pct sma_200_slope_1m_pct drawdown_from_52w_high_pct above_52w_low_pct golden_cross_20d".split()


def frame(spark, sf_dir):
    """The last session's features beside the universe."""
    f = technical_at(bars(spark, sf_dir, AS_OF))
    return f.join(universe(spark, sf_dir), "ticker", "left").withColumn("market_cap_usd_bn", F.when(F.col("market_cap") > 0, F.col("market_cap") / 1e9))


def chosen(*names):
    def query(spark, sf_dir):
        f = technical_at(bars(spark, sf_dir, AS_OF))
        return f.select("ticker", F.col("date").cast("string").alias("date"), *(rounded(n).alias(n) for n in names))

    return query


def chosen_sql(*names):
    return f"with {FEATURES_SQL} select ticker, cast(date as varchar) as date, {', '.join(f'round({"close" if n == "price" else n}, 6) as {n}' for n in names)} from f {LAST}"


FAMILIES = {
    "sma_family": ("price", "sma_20", "sma_50", "sma_200", "price_vs_sma_50_pct", "price_vs_sma_200_pct", "sma_50_vs_sma_200_pct", "sma_200_slope_1m_pct"),
    "returns_family": ("return_1m_pct", "return_3m_pct", "return_6m_pct", "return_12m_pct", "return_12m_ex_1m_pct"),
    "range_52w": ("high_52w", "low_52w", "drawdown_from_52w_high_pct", "above_52w_low_pct"),
    "realized_vol": ("volatility_20d_pct", "volatility_60d_pct"),
    "volume_ratios": ("avg_dollar_volume_20d_usd_mn", "rel_volume_5d", "rel_volume_20d", "max_volume_ratio_20d", "up_down_volume_ratio_50d"),
    "cross_flag": ("golden_cross_20d",),
}

SCREEN = s.Screen(
    "pullback",
    (s.Condition("drawdown_from_52w_high_pct", "<=", -5.0), s.Condition("volatility_20d_pct", "between", 1.0, 5000.0), s.Condition("gics_sector", "not_in", values=("Africa",)), s.Condition("sma_20", ">", other_feature="sma_50", multiplier=0.8)),
    (s.RankFactor("return_6m_pct"), s.RankFactor("volatility_60d_pct", False, 0.5), s.RankFactor("return_6m_pct", True, 0.5)),
    ((s.Condition("price_vs_sma_200_pct", ">", 0.0), s.Condition("return_1m_pct", ">", 0.0)),),
    s.Universe(min_price=100.0, exclude_sectors=("MIDDLE EAST ",)),
)
BASE = f"with {FEATURES_SQL}, {UNIVERSE_SQL}, fr as (select f.*, name, gics_sector, country, market_cap from f left join universe using (ticker) {LAST.replace('date =', 'f.date =')})"
STEPS = [
    ("price >= 100", "coalesce(close >= 100, false)", "close is null"),
    ("gics_sector not in [MIDDLE EAST ]", "coalesce(lower(trim(gics_sector)) <> 'middle east', false)", "gics_sector is null"),
    ("drawdown_from_52w_high_pct <= -5", "coalesce(drawdown_from_52w_high_pct <= -5, false)", "drawdown_from_52w_high_pct is null"),
    ("volatility_20d_pct between 1 and 5000", "coalesce(volatility_20d_pct between 1 and 5000, false)", "volatility_20d_pct is null"),
    ("gics_sector not in [Africa]", "coalesce(lower(trim(gics_sector)) <> 'africa', false)", "gics_sector is null"),
    ("sma_20 > 0.8 x sma_50", "coalesce(sma_20 > 0.8 * sma_50, false)", "sma_20 is null or sma_50 is null"),
    ("any of: price_vs_sma_200_pct > 0 | return_1m_pct > 0", "coalesce(price_vs_sma_200_pct > 0, false) or coalesce(return_1m_pct > 0, false)", "(price_vs_sma_200_pct is null or return_1m_pct is null) and not (coalesce(price_vs_sma_200_pct > 0, false) or coalesce(return_1m_pct > 0, false))"),
]


def screen_topn(spark, sf_dir):
    """The flagship: features, universe, conditions, ranking, top ten."""
    return s.run(SCREEN, frame(spark, sf_dir), CATALOG).select("ticker", "name", "gics_sector", rounded("price").alias("price"), rounded("return_6m_pct").alias("return_6m_pct"), rounded("score", 9).alias("score"))


def screen_funnel(spark, sf_dir):
    return s.funnel(SCREEN, frame(spark, sf_dir), CATALOG)


def pct(x: str, up: bool = True, by: str = "") -> str:
    """The percentile in SQL, ties averaged."""
    p = f"partition by {by}" if by else ""
    r = f"((rank() over ({p} order by {x} asc nulls last)) + (count({x}) over (partition by {by + ', ' if by else ''}{x}) - 1) / 2.0 - 1)"
    n = f"count({x}) over ({p})"
    body = f"{r} / nullif({n} - 1, 0)"
    return f"case when {x} is null then 0.5 when {n} = 1 then 1.0 else {body if up else f'1 - {body}'} end"


TOPN_SQL = f"""{BASE}, sv as (select * from fr where {' and '.join(f'({ok})' for _, ok, _ in STEPS)}),
sc as (select *, round({pct('return_6m_pct')} * 0.75 + {pct('volatility_60d_pct', False)} * 0.25, 12) as score from sv)
select ticker, name, gics_sector, round(close, 6) as price, round(return_6m_pct, 6) as return_6m_pct, round(score, 9) as score from sc order by sc.score desc, ticker limit 10"""


def _funnel_sql() -> str:
    rows, before = [], "true"
    for k, (name, ok, lacks) in enumerate(STEPS):
        rows.append(f"select {k}::int as step, '{name}' as label, count(*) filter (where {ok}) as passed_alone, count(*) filter (where {before} and ({ok})) as remaining, count(*) filter (where {before} and ({lacks}) and not ({ok})) as missing_data from fr")
        before = f"{before} and ({ok})"
    return f"{BASE} {' union all '.join(rows)}"


def predicate_matrix(spark, sf_dir):
    """Every operator against parts, whether it passes and lacks data."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ticker"), F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("price"), F.when(F.col("p_size") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p_size").cast("double")).alias("sma_20"), F.when(F.col("p_size") % 11 != 0, F.concat(F.lit(" "), F.upper("p_brand"))).alias("exchange"))
    brand = "Brand#1"
    tests = {"gt": s.Condition("price", ">", 1000.0), "ge_other": s.Condition("price", ">=", other_feature="sma_20", multiplier=40.0), "lt": s.Condition("sma_20", "<", 25.0), "le": s.Condition("sma_20", "<=", 25.0), "eq": s.Condition("sma_20", "==", 25.0001), "ne": s.Condition("sma_20", "!=", 24.0), "btw": s.Condition("price", "between", 950.0, 1100.0), "isin": s.Condition("exchange", "in", values=(brand, "brand#23")), "notin": s.Condition("exchange", "not_in", values=(brand, "BRAND#23 "))}
    cols = [c for k, t in tests.items() for ok, lacks in [t.columns(CATALOG)] for c in (ok.alias(f"{k}_ok"), lacks.alias(f"{k}_missing"))]
    return p.select("ticker", *cols)


PREDICATE_SQL = """with p as (select p_partkey as ticker, case when p_size % 7 <> 0 then p_retailprice end as price, case when p_size % 5 <> 0 then p_size::double end as s20, case when p_size % 11 <> 0 then lower(trim(p_brand)) end as ex from part)
select ticker, coalesce(price > 1000, false) as gt_ok, price is null as gt_missing, coalesce(price >= 40 * s20, false) as ge_other_ok, price is null or s20 is null as ge_other_missing,
coalesce(s20 < 25, false) as lt_ok, s20 is null as lt_missing, coalesce(s20 <= 25, false) as le_ok, s20 is null as le_missing,
coalesce(abs(s20 - 25.0001) <= 1e-8 + 1e-5 * 25.0001, false) as eq_ok, s20 is null as eq_missing, coalesce(not (abs(s20 - 24) <= 1e-8 + 1e-5 * 24), false) as ne_ok, s20 is null as ne_missing,
coalesce(price between 950 and 1100, false) as btw_ok, price is null as btw_missing, coalesce(ex in ('brand#1', 'brand#23'), false) as isin_ok, ex is null as isin_missing,
coalesce(ex not in ('brand#1', 'brand#23'), false) as notin_ok, ex is null as notin_missing from p"""


def universe_suspended_leg(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), F.lit(None).cast("double").alias("price"), F.col("c_mktsegment").alias("gics_sector"), F.col("c_acctbal").alias("return_1m_pct"))
    screen = s.Screen("suspended", (s.Condition("return_1m_pct", ">", 0.0),), (s.RankFactor("return_1m_pct"),), universe=s.Universe(min_price=5.0, exclude_sectors=("machinery",)))
    return s.funnel(screen, c, CATALOG)


SUSPENDED_SQL = """select 0::int as step, 'price >= 5 - NOT EVALUATED (no data from the provider for any name)' as label, count(*) as passed_alone, count(*) as remaining, 0::bigint as missing_data from customer
union all select 1, 'gics_sector not in [machinery]', count(*) filter (where lower(c_mktsegment) <> 'machinery'), count(*) filter (where lower(c_mktsegment) <> 'machinery'), count(*) filter (where c_mktsegment is null) from customer
union all select 2, 'return_1m_pct > 0', count(*) filter (where c_acctbal > 0), count(*) filter (where lower(c_mktsegment) <> 'machinery' and c_acctbal > 0), count(*) filter (where lower(c_mktsegment) <> 'machinery' and c_acctbal is null) from customer"""


def bars_weekly(spark, sf_dir):
    b = windows.clean(bars(spark, sf_dir))
    return b.select("ticker", F.col("date").cast("string").alias("date"), *(rounded(c).alias(c) for c in ("close", "high", "low", "volume")), F.col("bar_no").cast("long").alias("bar_no"))


def days_since_high(spark, sf_dir):
    return technical_at(bars(spark, sf_dir, AS_OF)).select("ticker", "days_since_52w_high")


SINCE_SQL = f"""with {BARS_AS_OF_SQL}, {NUMBERED}, l as (select * from b {LAST}),
x as (select l.ticker, l.bar_no, b.bar_no as k, b.high, count(*) over (partition by l.ticker) as n from l join b on b.ticker = l.ticker and b.bar_no between l.bar_no - 251 and l.bar_no),
t as (select ticker, bar_no, k, n, row_number() over (partition by ticker order by high desc, k desc) as r from x)
select ticker, case when n = 252 then (bar_no - k)::double end as days_since_52w_high from t where r = 1"""


def true_range(spark, sf_dir):
    f = features.technical(bars(spark, sf_dir))
    return f.select("ticker", F.col("date").cast("string").alias("date"), rounded("tr").alias("tr"))


def benchmark_strength(spark, sf_dir):
    f = technical_at(bars(spark, sf_dir, AS_OF), benchmark(spark, sf_dir, AS_OF))
    return f.select("ticker", *(rounded(c).alias(c) for c in ("rel_strength_3m_pp", "rel_strength_6m_pp", "rel_strength_12m_pp", "beta_1y")))


STRENGTH_SQL = f"""with {FEATURES_SQL}, {BENCHMARK_AS_OF_SQL}, g as (select f.*, level from f asof left join benchmark_series bs on f.date >= bs.date),
h as (select *, level / {lagged('level', 1)} - 1 as bret, {', '.join(f'return_{k}_pct - (level / {lagged("level", n)} - 1) * 100 as rel_strength_{k}_pp' for k, n in (('3m', 63), ('6m', 126), ('12m', 252)))} from g),
i as (select *, case when count(case when ret is not null then bret end) {w(252)} = 252 then covar_samp(ret, bret) {w(252)} / var_samp(case when ret is not null then bret end) {w(252)} end as beta_1y from h)
select ticker, round(rel_strength_3m_pp, 6) as rel_strength_3m_pp, round(rel_strength_6m_pp, 6) as rel_strength_6m_pp, round(rel_strength_12m_pp, 6) as rel_strength_12m_pp, round(beta_1y, 6) as beta_1y from i {LAST}"""


def xs_percentile(spark, sf_dir):
    f = technical_at(bars(spark, sf_dir, AS_OF))
    p = windows.percentile_rank("return_6m_pct", missing=None, alone=0.5) * 100
    return f.select("ticker", rounded(p).alias("return_6m_percentile"))


def coverage(spark, sf_dir):
    """The share of names that have each feature."""
    f = frame(spark, sf_dir)
    names = [n for n in NAMES if n != "price"]
    one = f.agg(*(F.avg(F.col(n).isNotNull().cast("double")).alias(n) for n in names))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), rounded(n).alias("share")) for n in names))))


def sector_medians(spark, sf_dir):
    f = frame(spark, sf_dir)
    return f.groupBy("gics_sector").agg(*(rounded(F.median(n)).alias(n) for n in ("return_6m_pct", "volatility_60d_pct")), F.count("*").alias("n"))


def average_volume(spark, sf_dir):
    return technical_at(bars(spark, sf_dir, AS_OF)).select("ticker", rounded("average_volume_20d").alias("average_volume_20d"))


QUERIES = {
    "screen_topn": screen_topn,
    "screen_funnel": screen_funnel,
    "predicate_matrix": predicate_matrix,
    "universe_suspended_leg": universe_suspended_leg,
    "bars_weekly": bars_weekly,
    **{k: chosen(*v) for k, v in FAMILIES.items()},
    "days_since_high": days_since_high,
    "true_range": true_range,
    "benchmark_strength": benchmark_strength,
    "xs_percentile": xs_percentile,
    "feature_coverage": coverage,
    "sector_medians": sector_medians,
    "average_volume": average_volume,
}
SQL = {
    "average_volume": f"with {FEATURES_SQL}, g as (select *, {full('avg', 'volume', 20)} as av from f) select ticker, round(av, 6) as average_volume_20d from g {LAST}",
    "screen_topn": TOPN_SQL,
    "screen_funnel": _funnel_sql(),
    "predicate_matrix": PREDICATE_SQL,
    "universe_suspended_leg": SUSPENDED_SQL,
    "bars_weekly": f"with {BARS_SQL}, {NUMBERED} select ticker, cast(date as varchar) as date, round(close, 6) as close, round(greatest(high, close), 6) as high, round(least(low, close), 6) as low, round(volume, 6) as volume, bar_no from b",
    **{k: chosen_sql(*v) for k, v in FAMILIES.items()},
    "days_since_high": SINCE_SQL,
    "true_range": f"with {ALL_FEATURES_SQL} select ticker, cast(date as varchar) as date, round(tr, 6) as tr from f",
    "benchmark_strength": STRENGTH_SQL,
    "xs_percentile": f"with {FEATURES_SQL}, l as (select * from f {LAST}) select ticker, case when return_6m_pct is not null then round(case when count(return_6m_pct) over () = 1 then 50.0 else 100 * ({pct('return_6m_pct')}) end, 6) end as return_6m_percentile from l",
    "feature_coverage": f"with {FEATURES_SQL}, l as (select * from f {LAST}) " + " union all ".join(f"select '{n}' as feature, round(avg(({n} is not null)::int), 6) as share from l" for n in NAMES if n != "price"),
    "sector_medians": f"{BASE} select gics_sector, round(median(return_6m_pct), 6) as return_6m_pct, round(median(volatility_60d_pct), 6) as volatility_60d_pct, count(*) as n from fr group by 1",
}
