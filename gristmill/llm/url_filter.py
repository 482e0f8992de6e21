"""URL filters: given rules first, then association rules mined from labels.

A URL gives tokens: scheme, host labels, top domain, path parts, extension, keys of the query. Spark's FP-growth mines
combinations of tokens from labelled URLs; those that predict a bad label with enough confidence and support are kept,
except where a smaller combination predicts as well. A URL matches a mined rule if it has all its tokens, which an
inverted index from tokens to rules finds: each rule stands under the rarest of its tokens only, and a URL that has this token
is asked for the others. No URL is compared with every rule, and a token that most URLs have leads to none unless it is a rule alone.

Tokens that always occur together in the labelled URLs are one item while mining (k of them would make 2 to the k sets); a rule
with such an item then stands once for each of them. Labels are about the pages themselves: ``page_labels`` puts measures of the quality rules to the
text of a page, markup taken out, in SQL.

Everything is DataFrame and SQL expressions, and MLlib in the JVM. Each distinct URL is matched once. Null URLs, or URLs
without ``://``, have an empty host and path, fit no rule and are allowed. An empty table gives an empty result; without
labels nothing is mined. Repeated rows get equal verdicts. Of rules of equal length the later in order holds; of mined rules the
most confident gives the confidence, whichever it is. A very long URL is one set of tokens in one task. Only the id, the url and
the html are read, so other columns' names don't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import WORD, cut

BAD = "=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Holds for a host and its subdomains, for paths that begin with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules in force.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(rules: tuple[Rule, ...], value) -> Column:
    """``value(rule)`` of the longest rule that fits ``host`` and ``path``, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def tokens(url: str = "url") -> Column:
    """The distinct tokens of a URL, with ``host`` and ``path`` columns at hand; null and empty ones are left out."""
    labels = "transform(filter(split(host, '[.]'), x -> x != ''), x -> concat('host=', x))"
    folders = "transform(filter(split(path, '/'), x -> x != ''), x -> concat('path=', lower(x)))"
    keys = f"transform(regexp_extract_all({url}, '[?&]([^=&#]*)', 1), x -> concat('key=', x))"
    single = (
        f"array(concat('scheme=', lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))),"
        " concat('top=', element_at(split(host, '[.]'), -1)), concat('site=', regexp_extract(host, '([^.]+[.][^.]+)$', 1)),"
        " if(path rlike '[.][A-Za-z0-9]+$', concat('type=', lower(regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1))), ''),"
        f" if(instr({url}, '#') > 0, 'fragment', ''))"
    )
    return F.expr(f"filter(array_distinct(concat({single}, {labels}, {folders}, {keys})), x -> x is not null and x not in ('', 'scheme=', 'top=', 'site=', 'key='))")


def page_labels(pages: DataFrame) -> DataFrame:
    """``url, bad`` of pages (url, html): bad where the visible text has too few words, too many symbols or words of an odd length."""
    visible = F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), r"(?is)<(script|style|nav|footer|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    rows = pages.select(F.col("url").cast("string").alias("url"), visible.alias("t"))
    rows = rows.select(
        "url",
        F.regexp_count("t", F.lit(WORD)).alias("words"),
        F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).alias("chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).alias("symbols"),
    )
    return rows.select("url", F.expr("words < 10 or 10 * symbols > words or chars > 10 * words or 10 * chars < 25 * words").alias("bad"))


def mine(labelled: DataFrame, support: float = 0.002, least: int = 5, confidence: float = 0.6) -> DataFrame:
    """``items, confidence, support`` of the rules that ``labelled`` (url, bad) gives. support: a share of the rows, of ``least`` rows at least."""
    from pyspark.ml.fpm import FPGrowth

    rows = labelled.where("url is not null and bad is not null").select(F.monotonically_increasing_id().alias("row"), "url", "bad").withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rows = cut(rows.select("row", "bad", tokens().alias("items")))
    n = rows.count()
    none = labelled.sparkSession.createDataFrame([], "items array<string>, confidence double, support double")
    if not n:
        return none
    most = max(support, least / n)
    # tokens of the same rows are one item, named by the first of them
    each = rows.select("row", F.explode("items").alias("item"))
    seen = each.groupBy("item").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.hash("row").cast("long")).alias("s")).where(F.col("n") >= most * n)
    together = seen.groupBy("n", "x", "s").agg(F.array_sort(F.collect_set("item")).alias("all")).select("all", F.col("all")[0].alias("first")).where("size(all) > 1")
    kept = together.collect()  # tokens above the support: fewer than the rows' tokens over the support
    others = {t: r["first"] for r in kept for t in r["all"]}
    items = F.col("items")
    if others:
        table = F.create_map(*(F.lit(x) for pair in sorted(others.items()) for x in pair))
        items = F.array_distinct(F.transform("items", lambda t: F.coalesce(F.try_element_at(table, t), t)))
    sets = rows.select(F.concat(items, F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, most), minConfidence=confidence).fit(sets)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(F.col("antecedent").alias("items"), "confidence", "support")
    if others:
        full = F.create_map(*(x for r in sorted(kept, key=lambda r: r["first"]) for x in (F.lit(r["first"]), F.array(*map(F.lit, r["all"])))))
        any_of = lambda t: F.coalesce(F.try_element_at(full, t), F.array(t))
        each_of = lambda sets, t: F.flatten(F.transform(sets, lambda s: F.transform(any_of(t), lambda x: F.array_append(s, x))))
        found = found.withColumn("items", F.explode(F.aggregate("items", F.array(F.array().cast("array<string>")), each_of)))
    return prune(found.withColumn("items", F.array_sort("items")).where(F.size("items") > 0))


def prune(rules: DataFrame) -> DataFrame:
    """Leaves out rules that contain a smaller one of no less confidence. Subsets meet by a join on one token and a count, as URLs do."""
    rules = rules.withColumn("id", F.xxhash64("items"))
    small = rules.select(F.col("id").alias("sid"), F.size("items").alias("n"), F.col("confidence").alias("sc"), F.explode("items").alias("item"))
    large = rules.select("id", F.size("items").alias("m"), "confidence", F.explode("items").alias("item"))
    inside = large.join(small, "item").where("n < m and sc >= confidence").groupBy("id", "sid", "n").agg(F.count("*").alias("k")).where("k = n")
    return rules.join(inside.select("id").distinct(), "id", "left_anti").drop("id")


#: Rules up to this number go to every task; more meet the tokens by a shuffle, spread over so many parts.
SMALL, SPREAD = 50_000, 32


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``url`` of ``urls`` that match a mined rule, and the most confident rule's ``confidence``."""
    rules = cut(rules.select(F.xxhash64("items").alias("id"), "items", "confidence"))
    each = urls.where("url is not null").select("url").distinct().withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    words = each.select("url", tokens().alias("has"))
    asked = rules.select("id", "items", "confidence", F.explode("items").alias("item"))
    few = rules.count() <= SMALL
    known = asked.select("item").distinct()
    often = words.select(F.explode("has").alias("item")).join(F.broadcast(known) if few else known, "item", "left_semi").groupBy("item").agg(F.count("*").alias("n"))
    index = asked.join(often, "item", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "item")).alias("rare"), F.first("items").alias("items"), F.first("confidence").alias("confidence"))
    index = index.select("items", "confidence", F.col("rare.item").alias("item"))
    rows = words.select("url", "has", F.explode("has").alias("item"))
    if few:
        met = rows.join(F.broadcast(index), "item")
    else:  # a token of a third of all URLs goes to as many tasks as there are parts
        met = rows.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(SPREAD))).join(index.withColumn("part", F.explode(F.expr(f"sequence(0L, {SPREAD - 1}L)"))), ["item", "part"])
    return met.where(F.size(F.array_except("items", "has")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[Rule, ...] = RULES, **more) -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence`` of each page; the last is that of the mined rule that matches, if any."""
    found = matched(pages, mine(labelled, **more))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.join(found, "url", "left").withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    verdict = F.coalesce(ruled(rules, lambda r: r.verdict), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", ruled(rules, lambda r: r.name).alias("rule"), verdict.alias("verdict"), "confidence")
