"""Factor models, whole backtests and regressions on factors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions.numbers import quotient, rounded
from gristmill.operators import backtest as bt
from gristmill.operators import factors as fa
from gristmill.operators import features
from gristmill.operators import metrics as m
from gristmill.operators import pit
from gristmill.queries import portfolios, returns, sequences
from gristmill.sources.tables import BENCHMARK_SQL, bars, benchmark, ordered_means, read

DAY = lambda c: F.col(c).cast("string").alias(c)

#: Characteristics of the models: kind, column, and SQL over a supplier's month of lineitem.
CHARS = {"bm": ("char", "avg(l_discount)"), "op": ("op", "avg(l_quantity)"), "inv": ("inv", "avg(l_tax)")}


def _panel(spark, sf_dir):
    c = sequences._chars(spark, sf_dir)
    more = ordered_means(spark, sf_dir, "month", op=F.col("l_quantity"), inv=F.col("l_tax")).withColumnRenamed("date", "month")
    w = Window.partitionBy("ticker").orderBy("month")
    momentum = quotient(F.lag("carried", 1).over(w), F.lag("carried", 12).over(w)) - 1
    return c.withColumn("mom", momentum).join(more, ["ticker", "month"], "left")


def _model(*kinds):
    columns = {k: CHARS[k][0] if k in CHARS else "mom" for k in kinds}
    names = ["mkt", "smb", *({"bm": "hml", "op": "rmw", "inv": "cma", "mom": "mom"}[k] for k in kinds)]

    def query(spark, sf_dir):
        f = fa.factor_returns(_panel(spark, sf_dir), columns, "exchange", 8, 3)
        return f.select(DAY("month"), *(rounded(n).alias(n) for n in names))

    return query


def _sorts_sql(kind: str) -> str:
    """Portfolios of one characteristic: cut points, places, returns."""
    k, low, mid, high = kind, *fa.LABELS[kind]
    char, monthly = CHARS[kind][0] if kind in CHARS else "mom", kind == "mom"
    base = "select * exclude (size, pc), lag(size) over w as size, lag(mom) over w as pc, month as formation from (select *, mom as pc from cx) window w as (partition by ticker order by month)" if monthly else f"select *, {char} as pc, year(month) as formation from cx where month(month) = 6"
    cut = lambda x, q, on: f"quantile_cont({x}, {q}) filter (where {on})"
    points = ", ".join(f"{cut(x, q, on)} as {n}{p}" for p, on in (("n", "gics_sector = 'AMERICA'"), ("a", "true")) for n, x, q in (("s", "size", 0.5), ("l", "pc", 0.3), ("h", "pc", 0.7)))
    pick = lambda n: f"case when k >= 8 then {n}n else {n}a end"
    join = "so.ticker = cx.ticker and so.formation = cx.month" if monthly else "so.ticker = cx.ticker and so.formation = year(cx.month) - (month(cx.month) <= 6)::int"
    port = lambda s, c: f"max(case when port = '{s}/{c}' and n >= 3 then ret end)"
    labels = (low, mid, high)
    return f"""f_{k} as ({base}), j_{k} as (select * from f_{k} where size > 0 and pc is not null), p_{k} as (select formation, count(*) filter (where gics_sector = 'AMERICA') as k, {points} from j_{k} group by 1),
so_{k} as (select ticker, formation, (case when size <= {pick('s')} then 'S' else 'B' end) || '/' || (case when pc <= {pick('l')} then '{low}' when pc <= {pick('h')} then '{mid}' else '{high}' end) as port from j_{k} join p_{k} using (formation)),
v_{k} as (select month, port, sum(prior_me * ret) / sum(prior_me) as ret, count(*) as n from cx join so_{k} so on {join} where ret is not null and prior_me > 0 group by 1, 2),
x_{k} as (select month, ({' + '.join(port('S', c) for c in labels)}) / 3 - ({' + '.join(port('B', c) for c in labels)}) / 3 as smb, ({port('S', high)} + {port('B', high)}) / 2 - ({port('S', low)} + {port('B', low)}) / 2 as spread from v_{k} group by 1)"""


def _model_sql(*kinds: str) -> str:
    base = sequences.CHARS_SQL.split(",\njn as")[0]
    more = ", ".join(f"{x} as {n}" for k, (n, x) in CHARS.items() if k != "bm")
    extra = f"mo as (select l_suppkey as ticker, cast(date_trunc('month', l_shipdate) as date) as month, {more} from lineitem group by 1, 2), cx as (select ch.*, op, inv, lag(carried, 1) over w / lag(carried, 12) over w - 1 as mom from ch left join mo using (ticker, month) window w as (partition by ticker order by month))"
    annual = [k for k in kinds if k != "mom"]
    smb = " + ".join(f"x_{k}.smb" for k in annual)
    name = {"bm": "hml", "op": "rmw", "inv": "cma", "mom": "mom"}
    spreads = ", ".join(f"round({'-' if k == 'inv' else ''}x_{k}.spread, 6) as {name[k]}" for k in kinds)
    joins = " ".join(f"left join x_{k} using (month)" for k in kinds)
    return f"with {base}, {extra}, {', '.join(map(_sorts_sql, kinds))}, mk as (select month, sum(prior_me * ret) / sum(prior_me) as ret, count(*) as n from cx where ret is not null and prior_me > 0 group by 1) select cast(month as varchar) as month, round(case when n >= 3 then ret end, 6) as mkt, round(({smb}) / {len(annual)}, 6) as smb, {spreads} from mk {joins}"


RF = 0.0005


def factor_regression(spark, sf_dir):
    """Weekly excess returns of the mean bar on the market: alpha a year in percent, betas and their t."""
    rows = returns._pairs(spark, sf_dir).withColumn("y", F.col("y") - RF)
    r = m.ols_newey_west(rows, "y", ["x"], 3)
    annual = F.when(F.col("term") == "const", F.col("beta") * 52 * 100)
    return r.select("term", rounded("beta").alias("beta"), rounded(annual).alias("alpha_annual_pct"), rounded("t_stat", 5).alias("t_stat"), rounded("r2").alias("r2"), "n")


REGRESSION_SQL = returns.OLS_SQL.replace("over (order by date) - 1 as y", f"over (order by date) - 1 - {RF} as y").replace("round(b0, 6) as beta,", "round(b0, 6) as beta, round(b0 * 5200, 6) as alpha_annual_pct,").replace("select 'x', round(b1, 6),", "select 'x', round(b1, 6), null,")

PLAN = bt.Strategy("quarterly", 5, costs_bps=25.0)


def _backtest(spark, sf_dir):
    b = bars(spark, sf_dir)
    signals = features.technical(b).select("ticker", "date", F.col("return_1m_pct").alias("signal"))
    levels = benchmark(spark, sf_dir)
    rf = levels.where("weekofyear(date) % 2 = 0").select("date", (F.month("date") / 1e5).alias("rf"))  # every second week: the last rate known holds
    return bt.backtest(PLAN, signals, b, levels, rf)


def strategy_backtest(spark, sf_dir):
    """The fifth of names with the highest return of a month, equally weighted, each quarter: the daily book."""
    return _backtest(spark, sf_dir).select(F.col("session").cast("long").alias("session"), *(rounded(c).alias(c) for c in ("gross", "net", "credit", "ret", "bench")))


def strategy_statistics(spark, sf_dir):
    s = bt.statistics(_backtest(spark, sf_dir), 52.0)
    return s.select("n_periods", *(rounded(c).alias(c) for c in ("total_return_pct", "volatility_pct", "sharpe", "beta", "tracking_error_pct", "information_ratio")))


def strategy_targets(spark, sf_dir):
    b = bars(spark, sf_dir)
    signals = features.technical(b).select("ticker", "date", F.col("return_1m_pct").alias("signal"))
    return bt.targets(bt.Strategy("quarterly", 5, long_short=True), signals, b).select(DAY("signal_date"), "ticker", rounded("weight").alias("weight"))


_SIGNALS = "bb as (select *, row_number() over (partition by ticker order by date) as bar_no from bars), rr as (select ticker, date, (close / lag(close, 21) over (partition by ticker order by bar_no) - 1) * 100 as signal from bb)"
_LEGS = f"""{_SIGNALS}, sg as (select signal_date, ticker, signal, row_number() over (partition by signal_date order by signal desc, ticker) as best, count(*) over (partition by signal_date) as n from rr join sd on rr.date = sd.signal_date where signal is not null),
lg as (select *, case when n >= 5 and (n - best) * 5 // n + 1 = 5 then 1 when n >= 5 and (n - best) * 5 // n + 1 = 1 then -1 end as leg from sg)"""
_BOOK = portfolios.BOOK_SQL.split("\nonx as")[0]
_TAIL = portfolios.BOOK_SQL[portfolios.BOOK_SQL.index("sn as (select") :].replace("from ex)", "from e2)").replace("g.session = tg.session)", "g.session = tg.session where g.px > 0)")
BACKTEST = f"""{_BOOK} {_LEGS}, tg as (select lg.signal_date, ex.session, ticker, 1.0 / count(*) over (partition by lg.signal_date) as weight from lg join ex using (signal_date) where leg = 1), e2 as (select distinct signal_date, session from tg), {_TAIL},
st as (select min(session) as first, min(date) as fd from cal where session >= (select min(session) from e2)), ca as (select period as session, greatest(0, 1 - sum(weight)) as cash from bk group by 1),
{BENCHMARK_SQL}, rf as (select date, month(date) / 1e5 as rf from benchmark_series where weekofyear(date) % 2 = 0),
cr as (select session, coalesce(last_value(cash ignore nulls) over (order by session rows between unbounded preceding and 1 preceding), 0) * coalesce(last_value(rf ignore nulls) over (order by session rows between unbounded preceding and current row), first_value(rf ignore nulls) over (order by session rows between current row and unbounded following), 0) as credit from cal left join ca using (session) left join rf using (date)),
be as (select date, case when date = fd then 0 else level / prev - 1 end as bench from (select date, level, lag(level) over (order by date) as prev from benchmark_series), st where date >= fd and prev is not null),
dy as (select cal.session, cal.date, coalesce(gross, 0) as gross, coalesce(gross, 0) - coalesce(traded * 25 / 1e4, 0) as net, coalesce(credit, 0) as credit, bench from cal join st on cal.session >= first left join (select * from gr where session > period) gr on gr.session = cal.session left join td on td.session = cal.session left join cr on cr.session = cal.session left join be on be.date = cal.date)"""
BACKTEST_SQL = f"with {BACKTEST} select session, round(gross, 6) as gross, round(net, 6) as net, round(credit, 6) as credit, round(net + credit, 6) as ret, round(bench, 6) as bench from dy"
STATISTICS_SQL = f"""with {BACKTEST}, r as (select net + credit as ret, bench from dy) select count(*) as n_periods, round((product(1 + ret) - 1) * 100, 6) as total_return_pct, round(stddev_samp(ret) * sqrt(52) * 100, 6) as volatility_pct, round(avg(ret) / stddev_samp(ret) * sqrt(52), 6) as sharpe,
round(covar_samp(ret, bench) / var_samp(bench), 6) as beta, round(stddev_samp(ret - bench) * sqrt(52) * 100, 6) as tracking_error_pct, round(avg(ret - bench) / stddev_samp(ret - bench) * sqrt(52), 6) as information_ratio from r"""
TARGETS_SQL = f"with {portfolios.GRID_SQL.replace(chr(39) + 'month' + chr(39) + ', date', chr(39) + 'quarter' + chr(39) + ', date')}, {_LEGS} select cast(signal_date as varchar) as signal_date, ticker, round(leg * 1.0 / count(*) over (partition by signal_date, leg), 6) as weight from lg where leg is not null"


def market_cap_pit(spark, sf_dir):
    """Caps at a date: the last price within ten days times the shares of the latest filing (a customer's orders stand for filings)."""
    shares = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 100 + 1).alias("ticker"), F.to_date("o_orderdate").alias("end"), F.date_add(F.to_date("o_orderdate"), 45).alias("filed"), (F.col("o_totalprice") + F.col("o_orderkey") / 1e9).alias("shares"))
    return pit.market_cap(bars(spark, sf_dir), shares, "1999-06-30").select("ticker", rounded(F.col("cap") / 1e6, 4).alias("cap_mn"))


CAP_SQL = f"""with {portfolios.BARS_SQL}, c as (select ticker, max_by(close, date) as close from bars where date between date '1999-06-30' - 10 and date '1999-06-30' and close > 0 group by 1),
s as (select o_custkey % 100 + 1 as ticker, arg_max(o_totalprice + o_orderkey / 1e9, (cast(o_orderdate as date) + 45, cast(o_orderdate as date), o_totalprice + o_orderkey / 1e9)) as shares, count(*) from orders where cast(o_orderdate as date) + 45 <= date '1999-06-30' group by 1)
select ticker, round(close * shares / 1e6, 4) as cap_mn from c join s using (ticker)"""


def anchored_caps(spark, sf_dir):
    """Caps at month ends: that of the last June or December, moved by the price."""
    from gristmill.operators.portfolio import rebalance_dates

    b = bars(spark, sf_dir)
    u = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker"), (F.abs("s_acctbal") + 1).alias("shares"))
    years = b.select(F.year("date").alias("y")).distinct()
    anchors = years.select(F.explode(F.array(F.make_date("y", F.lit(6), F.lit(30)), F.make_date("y", F.lit(12), F.lit(31)))).alias("anchor"))
    caps = u.crossJoin(anchors).select("ticker", "anchor", (F.col("shares") * (F.month("anchor") + 1)).alias("cap"))  # two rows a year beside each name
    return pit.anchored_cap(caps, b, rebalance_dates(b, "monthly")).select("ticker", DAY("date"), rounded("cap", 4).alias("cap"))


ANCHOR_SQL = f"""with {portfolios.BARS_SQL}, d as (select max(date) as date from (select distinct date from bars) group by date_trunc('month', date)), y as (select distinct year(date) as y from bars), a as (select make_date(y, 6, 30) as anchor from y union all select make_date(y, 12, 31) from y),
c as (select s_suppkey as ticker, anchor, (abs(s_acctbal) + 1) * (month(anchor) + 1) as cap from supplier, a), p as (select c.ticker, anchor, cap, bars.close as ap from c asof join bars on c.ticker = bars.ticker and c.anchor >= bars.date where anchor - bars.date <= 10),
q as (select ticker, date, close, case when month(date) > 6 then make_date(year(date), 6, 30) else make_date(year(date) - 1, 12, 31) end as anchor from bars join d using (date)) select ticker, cast(date as varchar) as date, round(cap * close / ap, 4) as cap from q join p using (ticker, anchor) where ap > 0"""


def ntm_estimates(spark, sf_dir):
    """Estimates of two fiscal years blended by what is left of the first."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("a"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") * 1.1).alias("b"), F.when(F.col("c_custkey") % 3 != 0, F.date_add(F.lit("2000-01-01").cast("date"), (F.col("c_custkey") % 500).cast("int"))).alias("next"), F.when(F.col("c_custkey") % 2 == 0, F.lit("1999-09-30").cast("date")).alias("last"))
    w = pit.ntm_weight(F.lit("2000-03-01").cast("date"), F.col("next"), F.col("last"))
    return c.select("c_custkey", rounded(w).alias("weight"), rounded(pit.ntm_blend(F.col("a"), F.col("b"), w)).alias("estimate"))


NTM_SQL = """with c as (select c_custkey, case when c_custkey % 5 <> 0 then c_acctbal end as a, case when c_custkey % 7 <> 0 then c_acctbal * 1.1 end as b, coalesce(case when c_custkey % 3 <> 0 then date '2000-01-01' + (c_custkey % 500)::int end, case when c_custkey % 2 = 0 then date '1999-09-30' + 365 end) as e from customer),
w as (select *, coalesce(greatest(0, least(1, (e - date '2000-03-01') / 365.25)), 0.5) as w from c) select c_custkey, round(w, 6) as weight, round(coalesce(w * a + (1 - w) * b, case when w >= 0.5 then a end, case when w <= 0.5 then b end), 6) as estimate from w"""


def option_expiries(spark, sf_dir):
    """The expiry of each customer's orders seen as a chain, as of a date."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("expiry"))
    return pit.expiry(o, "o_custkey", F.lit("1998-01-01").cast("date")).select("o_custkey", DAY("expiry"))


EXPIRY_SQL = """with o as (select o_custkey, cast(o_orderdate as date) as e, cast(o_orderdate as date) - date '1998-01-01' as d from orders), w as (select o_custkey, arg_min(e, (abs(d - 30), d)) as e from o where d between 20 and 45 group by 1), l as (select o_custkey, min(e) as e from o where d >= 7 group by 1)
select k.o_custkey, cast(coalesce(w.e, l.e) as varchar) as expiry from (select distinct o_custkey from o) k left join w using (o_custkey) left join l using (o_custkey)"""

QUERIES = {
    "ff3_factors": _model("bm"), "ff5_factors": _model("bm", "op", "inv"), "carhart4_factors": _model("bm", "mom"), "factor_regression": factor_regression, "strategy_backtest": strategy_backtest, "strategy_statistics": strategy_statistics, "strategy_targets": strategy_targets,
    "market_cap_pit": market_cap_pit, "anchored_caps": anchored_caps, "ntm_estimates": ntm_estimates, "option_expiries": option_expiries,
}
SQL = {
    "ff3_factors": _model_sql("bm"), "ff5_factors": _model_sql("bm", "op", "inv"), "carhart4_factors": _model_sql("bm", "mom"), "factor_regression": REGRESSION_SQL, "strategy_backtest": BACKTEST_SQL, "strategy_statistics": STATISTICS_SQL, "strategy_targets": TARGETS_SQL,
    "market_cap_pit": CAP_SQL, "anchored_caps": ANCHOR_SQL, "ntm_estimates": NTM_SQL, "option_expiries": EXPIRY_SQL,
}
