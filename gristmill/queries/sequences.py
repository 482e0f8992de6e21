"""Recursive indicators, timing rules and factor portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions.numbers import quotient, rounded
from gristmill.operators import factors as fa
from gristmill.operators import recursive, windows
from gristmill.operators.features import latest
from gristmill.queries.screens import NUMBERED
from gristmill.sources.tables import AS_OF, BARS_AS_OF_SQL, BARS_SQL, UNIVERSE_SQL, bars, ordered_means, read, universe

DAY = lambda c: F.col(c).cast("string").alias(c)


def _indicators(spark, sf_dir, names, as_of=None):
    return recursive.indicators(windows.clean(bars(spark, sf_dir, as_of)), names)


def indicator(*names):
    def query(spark, sf_dir):
        return latest(_indicators(spark, sf_dir, names, AS_OF)).select("ticker", *(rounded(n).alias(n) for n in names))

    return query


def ema_series(spark, sf_dir):
    return _indicators(spark, sf_dir, ("macd_line", "macd_signal")).select("ticker", F.col("bar_no").cast("long").alias("bar_no"), rounded("macd_line").alias("macd_line"), rounded("macd_signal").alias("macd_signal"))


END = "where b.date = (select max(date) from bars)"
EMA_SQL = f"""with recursive {BARS_SQL}, {NUMBERED}, e as (select ticker, bar_no, close as f, close as s from b where bar_no = 1 union all select b.ticker, b.bar_no, f + 2 / 13.0::double * (close - f), s + 2 / 27.0::double * (close - s) from e join b on b.ticker = e.ticker and b.bar_no = e.bar_no + 1),
l as (select ticker, bar_no, f - s as line from e where bar_no >= 26), g as (select ticker, bar_no, line, line as sig from l where bar_no = 26 union all select l.ticker, l.bar_no, l.line, sig + 0.2::double * (l.line - sig) from g join l on l.ticker = g.ticker and l.bar_no = g.bar_no + 1)"""
RSI_SQL = f"""with recursive {BARS_AS_OF_SQL}, {NUMBERED}, d as (select ticker, bar_no, date, greatest(close - lag(close) over w, 0) as u, greatest(lag(close) over w - close, 0) as v from b window w as (partition by ticker order by bar_no)),
r as (select ticker, 15::bigint as bar_no, avg(u) as u, avg(v) as v from d where bar_no between 2 and 15 group by ticker having count(*) = 14 union all select d.ticker, d.bar_no, (r.u * 13 + d.u) / 14, (r.v * 13 + d.v) / 14 from r join d on d.ticker = r.ticker and d.bar_no = r.bar_no + 1)
select b.ticker, case when u + v > 0 then round(100 * u / (u + v), 6) end as rsi_14 from b left join r using (ticker, bar_no) {END}"""
ATR_SQL = f"""with recursive {BARS_AS_OF_SQL}, {NUMBERED}, t as (select ticker, bar_no, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr from b window w as (partition by ticker order by bar_no)),
r as (select ticker, 14::bigint as bar_no, avg(tr) as a from t where bar_no <= 14 group by ticker having count(*) = 14 union all select t.ticker, t.bar_no, (a * 13 + tr) / 14 from r join t on t.ticker = r.ticker and t.bar_no = r.bar_no + 1)
select b.ticker, round(a, 6) as atr_14, round(100 * a / close, 6) as atr_14_pct from b left join r using (ticker, bar_no) {END}"""


def timing_latch(spark, sf_dir):
    """Each user's events: a purchase opens, an error closes; the state after every event."""
    e = read(spark, sf_dir, "events").select(F.col("user_id"), "event_id", "ts", "event_type")
    e = e.withColumn("seq", F.struct("ts", "event_id"))
    state = recursive.latch(F.col("event_type") == "purchase", F.col("event_type") == "error", F.col("event_type").isNotNull(), "user_id", "seq")
    return e.select("event_id", state.cast("long").alias("state"))


LATCH_SQL = "select event_id, coalesce(last_value(case when event_type = 'error' then 0 when event_type = 'purchase' then 1 end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 0)::bigint as state from events"


def _chars(spark, sf_dir):
    """Monthly returns, caps (balance times price) and a characteristic (the mean discount of the month)."""
    disc = ordered_means(spark, sf_dir, "month", char=F.col("l_discount")).withColumnRenamed("date", "month")
    weekly = ordered_means(spark, sf_dir, "week", close=quotient("l_extendedprice", "l_quantity"))
    u = universe(spark, sf_dir).select("ticker", "country", "gics_sector", "market_cap")
    m = fa.monthly_panel(weekly).join(u, "ticker").join(disc, ["ticker", "month"], "left")
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy("month")
    m = m.withColumn("size", F.when(F.col("market_cap") > 0, F.col("market_cap") * F.col("carried")))
    return m.withColumn("ret", quotient("carried", F.lag("carried").over(w)) - 1).withColumn("prior_me", F.lag("size").over(w)).withColumn("exchange", F.when(F.col("gics_sector") == "AMERICA", "NYSE").otherwise("OTHER"))


def _held(spark, sf_dir):
    c = _chars(spark, sf_dir)
    june = c.where("month(month) = 6").withColumn("formation", F.year("month"))
    sorted_ = fa.sort_two_by_three(june, exchange="exchange", least=8).select("ticker", "formation", "port")
    return c.withColumn("formation", fa.formation_year("month")).join(sorted_, ["ticker", "formation"])


def factors_2x3(spark, sf_dir):
    c = _chars(spark, sf_dir).where("month(month) = 6").withColumn("formation", F.year("month").cast("long"))
    return fa.sort_two_by_three(c, exchange="exchange", least=8).select("ticker", "formation", "port")


def vw_portfolios(spark, sf_dir):
    return fa.value_weighted(_held(spark, sf_dir), "month", "port").select(DAY("month"), "port", rounded("ret").alias("ret"), "n")


def smb_hml(spark, sf_dir):
    v = fa.value_weighted(_held(spark, sf_dir), "month", "port")
    return fa.spreads(v, "month", least=3).select(DAY("month"), rounded("smb").alias("smb"), rounded("spread").alias("hml"))


CHARS_SQL = f"""{BARS_SQL}, {UNIVERSE_SQL}, ow as (select ticker, cast(date_trunc('month', date) as date) as month, max_by(close, date) as close from bars group by 1, 2),
gd as (select ticker, cast(unnest(generate_series(min(month), max(month), interval 1 month)) as date) as month from ow group by 1), cr as (select gd.ticker, gd.month, last_value(close ignore nulls) over (partition by gd.ticker order by gd.month rows between unbounded preceding and current row) as carried from gd left join ow on ow.ticker = gd.ticker and ow.month = gd.month),
di as (select l_suppkey as ticker, cast(date_trunc('month', l_shipdate) as date) as month, avg(l_discount) as char from lineitem group by 1, 2),
c0 as (select cr.ticker, cr.month, carried, char, gics_sector, case when market_cap > 0 then market_cap * carried end as size from cr join universe using (ticker) left join di on di.ticker = cr.ticker and di.month = cr.month),
ch as (select *, carried / lag(carried) over (partition by ticker order by month) - 1 as ret, lag(size) over (partition by ticker order by month) as prior_me from c0),
jn as (select *, year(month) as formation from ch where month(month) = 6 and size > 0 and char is not null), pt as (select formation, count(*) filter (where gics_sector = 'AMERICA') as k, quantile_cont(size, 0.5) filter (where gics_sector = 'AMERICA') as ms, quantile_cont(char, 0.3) filter (where gics_sector = 'AMERICA') as ml, quantile_cont(char, 0.7) filter (where gics_sector = 'AMERICA') as mh, quantile_cont(size, 0.5) as s, quantile_cont(char, 0.3) as l, quantile_cont(char, 0.7) as h from jn group by 1),
so as (select ticker, formation, (case when size <= (case when k >= 8 then ms else s end) then 'S' else 'B' end) || '/' || (case when char <= (case when k >= 8 then ml else l end) then 'L' when char <= (case when k >= 8 then mh else h end) then 'M' else 'H' end) as port from jn join pt using (formation)),
vw as (select month, port, sum(prior_me * ret) / sum(prior_me) as ret, count(*) as n from ch join so on so.ticker = ch.ticker and so.formation = year(month) - (month(month) <= 6)::int where ret is not null and prior_me > 0 group by 1, 2)"""
PORT = lambda p: f"max(case when port = '{p}' and n >= 3 then ret end)"
SMB_SQL = f"with {CHARS_SQL} select cast(month as varchar) as month, round(({' + '.join(PORT(f'S/{c}') for c in 'LMH')}) / 3 - ({' + '.join(PORT(f'B/{c}') for c in 'LMH')}) / 3, 6) as smb, round(({PORT('S/H')} + {PORT('B/H')}) / 2 - ({PORT('S/L')} + {PORT('B/L')}) / 2, 6) as hml from vw group by 1"

QUERIES = {
    "rsi_last": indicator("rsi_14"), "macd_last": indicator("macd_line", "macd_signal", "macd_histogram"), "atr_last": indicator("atr_14", "atr_14_pct"), "macd_features": indicator("macd_histogram_pct_price", "macd_bullish_cross_10d"), "ema_series": ema_series, "timing_latch": timing_latch,
    "factors_2x3": factors_2x3, "vw_portfolios": vw_portfolios, "smb_hml": smb_hml,
}
SQL = {
    "rsi_last": RSI_SQL, "atr_last": ATR_SQL, "timing_latch": LATCH_SQL,
    "macd_last": f"{EMA_SQL.replace(BARS_SQL, BARS_AS_OF_SQL)} select b.ticker, round(line, 6) as macd_line, case when g.bar_no >= 34 then round(sig, 6) end as macd_signal, case when g.bar_no >= 34 then round(line - sig, 6) end as macd_histogram from b left join g using (ticker, bar_no) {END}",
    "macd_features": f"""{EMA_SQL.replace(BARS_SQL, BARS_AS_OF_SQL)}, h as (select ticker, bar_no, line, case when bar_no >= 34 then sig end as sig from g), t as (select *, (line > sig and lag(line) over w <= lag(sig) over w)::int as turn from h window w as (partition by ticker order by bar_no)),
x as (select *, case when count(sig) over (partition by ticker order by bar_no rows between 10 preceding and current row) = 11 then max(coalesce(turn, 0)) over (partition by ticker order by bar_no rows between 9 preceding and current row) end as crossed from t)
select b.ticker, round(100 * (line - sig) / close, 6) as macd_histogram_pct_price, crossed::double as macd_bullish_cross_10d from b left join x using (ticker, bar_no) {END}""",
    "ema_series": f"{EMA_SQL} select b.ticker, b.bar_no, round(line, 6) as macd_line, case when g.bar_no >= 34 then round(sig, 6) end as macd_signal from b left join g using (ticker, bar_no)",
    "factors_2x3": f"with {CHARS_SQL} select ticker, formation, port from so",
    "vw_portfolios": f"with {CHARS_SQL} select cast(month as varchar) as month, port, round(ret, 6) as ret, n from vw",
    "smb_hml": SMB_SQL,
}
