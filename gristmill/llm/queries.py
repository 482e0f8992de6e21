"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm import quality_rules as q

    entries = q.ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~q.passes(q.BASE)).alias("base_failed"), q.passes(q.CURRENT).alias("kept"), "n_lines", "failed_bits")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm import quality_classifier

    return quality_classifier.classify(read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm import html_extract

    return html_extract.main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm import mixing

    return mixing.amounts(read(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm import url_filter

    pages = read(spark, sf_dir, "pages")
    return url_filter.judge(pages.select("page_id", "url"), url_filter.page_labels(pages))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm import langid

    return langid.identify(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm import simhash

    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    from gristmill.llm import packing

    return packing.pack(read(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm import substring

    return substring.digests(read(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm import iblt

    return iblt.fingerprints(read(spark, sf_dir, "documents"))


OP1_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
x as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos, len(ws) as n from w),
g as (select doc_id, pos, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o || ' ' || lead(word, 3) over o || ' ' || lead(word, 4) over o as gram
      from x window o as (partition by doc_id order by pos)),
r as (select doc_id, pos, count(*) over (partition by doc_id, gram) as c from g where gram is not null),
rep as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(pos, pos + 5)) as p from r where c > 1) group by 1),
l as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
ln as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
m as (select w.doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
             coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines
      from w left join rep using (doc_id) left join ln using (doc_id)),
b as (select *, (case when n_words < 10 then 1 else 0 end + case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end + case when 10 * n_symbols > n_words then 4 else 0 end
      + case when 10 * n_dup_lines > 4 * n_lines then 8 else 0 end + case when word_chars > 10 * n_words then 16 else 0 end + case when 10 * word_chars < 25 * n_words then 32 else 0 end)::bigint as failed_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 as base_failed, failed_bits = 0 as kept, n_lines, failed_bits from b
"""

OP9_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, ws, unnest(range(1, len(ws) - 48)) as p from w where len(ws) >= 50),
g as (select doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) as h from s),
m as (select h, min(doc_id) as least from g group by 1),
c as (select distinct doc_id, unnest(range(p, p + 50)) as pos from g join m using (h) where doc_id > least),
x as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
k as (select x.doc_id, count(c.pos) as n_removed, coalesce(string_agg(case when c.pos is null then word end, ' ' order by x.pos), '') as kept from x left join c using (doc_id, pos) group by 1)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality_rules": op1_quality_rules, "op2_quality_classifier": op2_quality_classifier, "op3_html_extraction": op3_html_extraction, "op4_mixing": op4_mixing, "op5_url_filter": op5_url_filter, "op6_language_id": op6_language_id, "op7_simhash": op7_simhash, "op8_packing": op8_packing, "op9_substring_dedup": op9_substring_dedup, "op10_fingerprints": op10_fingerprints}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op9_substring_dedup": OP9_SQL}
