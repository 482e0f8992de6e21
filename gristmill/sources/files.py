"""Text files of other makers as rows: factor tables, lists of tickers, feeds. Each takes ``path, text`` of whole files, which are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions.strings import ticker

#: What stands for missing in factor tables.
MISSING = (-99.99, -999.0)


def whole_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, text`` of files in UTF-8, UTF-16 (by its mark) or else Latin-1."""
    raw = spark.read.format("binaryFile").load(paths).select("path", "content")
    head, body = F.hex(F.substring("content", 1, 3)), F.col("content")
    wide = F.startswith(head, F.lit("FFFE")) | F.startswith(head, F.lit("FEFF"))
    utf8 = F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).otherwise(F.decode(body, "ISO-8859-1"))
    return raw.select("path", F.regexp_replace(F.when(wide, F.decode(body, "UTF-16")).otherwise(utf8), "^﻿", "").alias("text"))


def lines(texts: DataFrame) -> DataFrame:
    return texts.select("path", F.posexplode(F.split(F.regexp_replace("text", "^﻿", ""), "\r\n|\r|\n")).alias("no", "line"))


def factor_table(texts: DataFrame) -> DataFrame:
    """``path, date, name, value`` of the first section of a factor file: rows of YYYYMM (month ends) or YYYYMMDD under the last header before them; percent become fractions, and what stands for missing NULL."""
    rows = lines(texts).withColumn("f", F.transform(F.split("line", ","), lambda x: F.trim(x))).withColumn("key", F.col("f")[0])
    rows = rows.withColumn("kind", F.when(F.rlike("key", F.lit("^([0-9]{6}|[0-9]{8})$")), F.length("key")))
    order = Window.partitionBy("path").orderBy("no")
    named = (F.col("key") == "") & (F.size("f") > 1) & F.exists(F.slice("f", 2, 99), lambda x: x != "")
    rows = rows.withColumn("header", F.last(F.when(named, F.filter(F.slice("f", 2, 99), lambda x: x != "")), True).over(order))
    data = rows.where("kind is not null and header is not null")
    first = data.groupBy("path").agg(F.min(F.struct("no", "kind")).alias("first"))
    data = data.join(first, "path").withColumn("run", F.col("no") - F.row_number().over(Window.partitionBy("path", "kind").orderBy("no")))
    run = F.first("run").over(Window.partitionBy("path").orderBy("no"))
    data = data.where("kind = first.kind").withColumn("start", run).where("run = start")
    day = F.when(F.col("kind") == 6, F.last_day(F.to_date(F.concat("key", F.lit("01")), "yyyyMMdd"))).otherwise(F.to_date("key", "yyyyMMdd"))
    each = data.select("path", day.alias("date"), F.posexplode("header").alias("k", "name"), "f")
    value = F.expr("try_cast(try_element_at(f, k + 2) as double)")
    return each.select("path", "date", "name", F.when(value.isin(*MISSING), None).otherwise(value / 100).alias("value"))


def tickers(texts: DataFrame) -> DataFrame:
    """``path, ticker, place`` of a list: one on a line, or a column called ticker or symbol of a table; comments and repeats left out, in order."""
    rows = lines(texts).where("trim(line) != '' and not startswith(trim(line), '#')")
    first = F.first("line").over(Window.partitionBy("path").orderBy("no"))
    rows = rows.withColumn("first", first)
    mark = F.when(F.contains("first", F.lit("\t")), "\t").when(F.contains("first", F.lit(",")), ",").when(F.contains("first", F.lit(";")), ";")
    split = lambda x: F.transform(F.split(x, F.concat(F.lit("["), F.col("mark"), F.lit("]"))), lambda y: F.regexp_replace(F.trim(y), '^"|"$', ""))
    rows = rows.withColumn("mark", mark)
    names = F.transform(split(F.col("first")), lambda x: F.lower(x))
    at = F.coalesce(F.nullif(F.array_position(names, "ticker"), F.lit(0)), F.nullif(F.array_position(names, "symbol"), F.lit(0)))
    value = F.when(F.col("mark").isNull(), F.split(F.trim("line"), r"\s+")[0]).otherwise(F.try_element_at(split(F.col("line")), at.cast("int")))
    found = rows.where("mark is null or line != first").select("path", "no", ticker(value).alias("ticker")).where("ticker is not null and ticker != ''")
    once = found.groupBy("path", "ticker").agg(F.min("no").alias("no"))
    return once.select("path", "ticker", F.row_number().over(Window.partitionBy("path").orderBy("no")).alias("place"))


def entries(texts: DataFrame) -> DataFrame:
    """``path, title, link, published, summary`` of the entries of Atom and items of RSS feeds. Texts that declare entities are refused: they give no row."""
    ok = texts.where("not lower(text) rlike '<!(doctype|entity)'")
    one = ok.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<(?:entry|item)[ >].*?</(?:entry|item)>"), F.lit(0))).alias("e"))

    def field(*names: str):
        plain = [F.regexp_extract("e", rf"(?s)<{n}(?: [^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{n}>", 1) for n in names]
        return F.coalesce(*(F.nullif(p, F.lit("")) for p in plain))

    line = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    link = F.coalesce(field("link"), F.nullif(F.regexp_extract("e", r"<link[^>]*href=[\"']([^\"']+)", 1), F.lit("")), field("id"))
    return one.select("path", line(field("title")).alias("title"), line(link).alias("link"), line(field("published", "pubDate", "updated")).alias("published"), line(field("summary", "description", "content")).alias("summary"))
