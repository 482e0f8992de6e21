"""Dates, names, files and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import dates, strings
from gristmill.functions.numbers import rounded
from gristmill.operators import pit
from gristmill.sinks import stores
from gristmill.sources import files
from gristmill.sources.tables import DAILY_SQL, daily_revenue, read

DAY = lambda c: F.col(c).cast("string").alias(c)


def business_days(spark, sf_dir):
    """Each order's day rolled, moved and counted in business days."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    n = (F.col("o_orderkey") % 23 - 11).cast("int")
    moved = dates.add_business_days(F.col("d"), n)
    return o.select("o_orderkey", dates.roll(F.col("d")).cast("string").alias("back"), dates.roll(F.col("d"), True).cast("string").alias("on"), moved.cast("string").alias("moved"), dates.business_days(F.lit("1996-02-29").cast("date"), F.col("d")).cast("long").alias("counted"))


_WEEKDAYS = "wd as (select cast(unnest(generate_series(date '1994-01-01', date '2003-12-31', interval 1 day)) as date) as d), bd as (select d, row_number() over (order by d) as k from wd where isodow(d) < 6)"
BUSINESS_SQL = f"""with {_WEEKDAYS}, cum as (select wd.d, sum((isodow(wd.d) < 6)::int) over (order by wd.d rows between unbounded preceding and 1 preceding) as n from wd), o as (select o_orderkey, cast(o_orderdate as date) as d from orders), a as (select o.*, b.d as back, b.k from o asof join bd b on o.d >= b.d), f as (select a.*, b.d as fwd from a asof join bd b on a.d <= b.d)
select o_orderkey, cast(back as varchar) as back, cast(fwd as varchar) as "on", cast(m.d as varchar) as moved, (case when f.d < date '1996-02-29' then nx.n - (select n from cum where d = date '1996-03-01') else cum.n - (select n from cum where d = date '1996-02-29') end)::bigint as counted from f join bd m on m.k = f.k + o_orderkey % 23 - 11 join cum on cum.d = f.d join cum nx on nx.d = f.d + 1"""


def names_and_ids(spark, sf_dir):
    """Tickers, directory names, identifiers and cells from the names of parts."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    t = F.concat(F.lit(" "), F.lower(F.substring("p_type", 1, 4)), F.element_at(F.array(*map(F.lit, (".b", ".l", "/a", ".to", ""))), (F.col("p_partkey") % 5 + 1).cast("int")))
    return p.select("p_partkey", strings.ticker(t).alias("ticker"), strings.slug(F.concat_ws(" | ", "p_name", "p_brand")).alias("slug"), strings.short_id(F.col("p_brand"), F.col("p_type")).alias("id"), strings.cell(F.concat_ws(" |\n<", "p_name", "p_brand")).alias("cell"))


NAMES_SQL = r"""with p as (select p_partkey, p_name, p_brand, p_type, upper(substr(p_type, 1, 4)) as r, p_partkey % 5 as k, regexp_replace(regexp_replace(regexp_replace(lower(concat_ws(' | ', p_name, p_brand)), '[^a-z0-9_-]+', '-', 'g'), '-{2,}', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') as s from part)
select p_partkey, r || case k when 0 then case when regexp_matches(r, '^\pL{1,5}$') then '-B' else '.B' end when 1 then '.L' when 2 then '-A' when 3 then '.TO' else '' end as ticker,
case when length(s) > 64 then regexp_replace(substr(s, 1, 55), '^[-_]+|[-_]+$', '', 'g') || '-' || substr(sha1(concat_ws(' | ', p_name, p_brand)), 1, 8) else s end as slug, substr(sha256(p_brand || chr(31) || p_type), 1, 12) as id, replace(replace(regexp_replace(concat_ws(' |' || chr(10) || '<', p_name, p_brand), '\s+', ' ', 'g'), '<', '&lt;'), '|', '\|') as cell from p"""


def factor_file(spark, sf_dir):
    """A factor file written from monthly revenue, with preamble, missing values and an annual section, read back."""
    m = daily_revenue(spark, sf_dir).groupBy(F.date_format("date", "yyyyMM").alias("k")).agg(F.avg("ret").alias("a"), F.count("*").alias("n"))
    line = F.concat_ws(",", "k", F.when(F.col("k").endswith("07"), " -99.99").otherwise(F.format_string("%10.4f", F.col("a"))), F.col("n").cast("string"))
    text = m.agg(F.concat(F.lit("Made from orders.\r\n\r\n,Mkt-RF,N\r\n"), F.concat_ws("\r\n", F.array_sort(F.collect_list(line))), F.lit("\r\n\r\n Annual Factors\r\n,Mkt-RF,N\r\n1996,1.0,2\r\n199701,5,6\r\nCopyright\r\n")).alias("text"))
    return files.factor_table(text.withColumn("path", F.lit("made"))).select(DAY("date"), "name", rounded("value", 8).alias("value"))


FILE_SQL = f"""with {DAILY_SQL}, m as (select last_day(date) as d, avg(ret) as a, count(*) as n from daily group by 1)
select cast(cast(d as date) as varchar) as date, 'Mkt-RF' as name, case when month(d) <> 7 then round(round(a, 4) / 100, 8) end as value from m union all select cast(cast(d as date) as varchar), 'N', round(n / 100, 8) from m"""


def inbox_merge(spark, sf_dir):
    """Early events as an inbox, late ones as arrivals, errors as tombstones."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.col("ts").alias("seen"), "event_type", "value")
    half = F.lit("2024-01-15").cast("timestamp")
    early = e.where(F.col("seen") < half).groupBy("id").agg(F.max("seen").alias("seen"), F.max_by("value", F.struct("seen", "value")).alias("value"), F.min("event_type").alias("status"))
    late = e.where(F.col("seen") >= half).groupBy("id").agg(F.max("seen").alias("seen"), F.max_by("value", F.struct("seen", "value")).alias("value"))
    dead = e.where("event_type = 'error' and value > 480").select("id")
    return stores.merged(early, late, dead).select("id", rounded("value").alias("value"), "status")


INBOX_SQL = """with e as (select user_id::varchar as id, ts as seen, event_type, value from events), a as (select id, max(seen) as seen, arg_max(value, (seen, value)) as value, min(event_type) as status from e where seen < timestamp '2024-01-15' group by 1), l as (select id, max(seen) as seen, arg_max(value, (seen, value)) as value from e where seen >= timestamp '2024-01-15' group by 1)
select coalesce(l.id, a.id) as id, round(coalesce(l.value, a.value), 6) as value, coalesce(a.status, 'new') as status from a full join l on a.id = l.id where coalesce(l.id, a.id) not in (select id from e where event_type = 'error' and value > 480)"""


def thinned_series(spark, sf_dir):
    return stores.thinned(daily_revenue(spark, sf_dir), "date", "ret", 200).select(DAY("date"), rounded("ret").alias("ret"))


THIN_SQL = f"""with {DAILY_SQL}, r as (select *, row_number() over (order by date) - 1 as i, count(*) over () as n from daily), p as (select *, case when i > 0 and i < n - 1 then floor((i - 1) * 99 / (n - 2)) end as part from r),
x as (select *, arg_min(i, (ret, i)) over (partition by part) as lo, arg_max(i, (ret, -i)) over (partition by part) as hi from p) select cast(date as varchar) as date, round(ret, 6) as ret from x where n <= 200 or part is null or i = lo or i = hi"""


def fiscal_labels(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.last_day("o_orderdate").alias("end"), (F.col("o_custkey") % 12 + 1).cast("int").alias("month")).distinct()
    return o.select(DAY("end"), "month", pit.fiscal_label(F.col("end"), F.col("month")).alias("label"))


FISCAL_SQL = """with o as (select distinct last_day(o_orderdate) as e, (o_custkey % 12 + 1)::int as m from orders), x as (select *, cast(e as date) - 15 as d from o) select cast(cast(e as date) as varchar) as "end", m as month, 'Q' || (((month(d) - m - 1 + 24) % 12 + 1 + 2) // 3) || ' FY' || (year(d) + (month(d) > m)::int) as label from x"""


def debt_waterfall(spark, sf_dir):
    """Total debt from what an order's lines tell, some of it missing."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*(F.sum(F.when(F.col("l_linenumber") == k, F.col("l_quantity"))).alias(f"x{k}") for k in range(1, 8)))
    x = lambda k, n: F.when(F.col("l_suppkey") % n != 0, F.col(f"x{k}"))
    debt = pit.total_debt(F.when(F.col("l_suppkey") % 4 == 0, F.col("x1")), x(2, 3), x(3, 2), x(4, 5), [(F.when(F.col("l_suppkey") % 3 == 0, F.col("x5")), x(6, 7))], [x(7, 2)])
    return li.select("l_suppkey", rounded(debt).alias("debt"))


DEBT_SQL = """with a as (select l_suppkey as k, sum(l_quantity) filter (where l_linenumber = 1) as x1, sum(l_quantity) filter (where l_linenumber = 2) as x2, sum(l_quantity) filter (where l_linenumber = 3) as x3, sum(l_quantity) filter (where l_linenumber = 4) as x4, sum(l_quantity) filter (where l_linenumber = 5) as x5, sum(l_quantity) filter (where l_linenumber = 6) as x6, sum(l_quantity) filter (where l_linenumber = 7) as x7 from lineitem group by 1),
b as (select k, case when k % 4 = 0 then x1 end as ltd, case when k % 3 <> 0 then x2 end as cm, case when k % 2 <> 0 then x3 end as st, case when k % 5 <> 0 then x4 end as dc, case when k % 3 = 0 then x5 end as nc, case when k % 7 <> 0 then x6 end as cu, case when k % 2 <> 0 then x7 end as ot from a)
select k as l_suppkey, round(case when ltd is not null then ltd + coalesce(st, case when dc >= cm then dc - cm end, 0) when nc is not null then nc + case when dc is not null then greatest(dc, coalesce(cu, 0) + coalesce(st, 0)) else coalesce(cu, 0) + coalesce(st, 0) end when coalesce(dc, st, ot) is not null then coalesce(ot, 0) + coalesce(dc, st, 0) end, 6) as debt from b"""

QUERIES = {"business_days": business_days, "names_and_ids": names_and_ids, "factor_file": factor_file, "inbox_merge": inbox_merge, "thinned_series": thinned_series, "fiscal_labels": fiscal_labels, "debt_waterfall": debt_waterfall}
SQL = {"business_days": BUSINESS_SQL, "names_and_ids": NAMES_SQL, "factor_file": FILE_SQL, "inbox_merge": INBOX_SQL, "thinned_series": THIN_SQL, "fiscal_labels": FISCAL_SQL, "debt_waterfall": DEBT_SQL}
