"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages the driver of the pipeline writes the result and reads it again; ``run`` cuts the lineage by a checkpoint instead.

All stages take empty tables (and give empty ones) and any further columns, whatever their names; these are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import mixing, packing, quality_rules, similar, substring
from gristmill.llm.common import cut, read, spread, text_size

TOKENIZER = "byte_bpe_50k.json"


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` anew, after texts have changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule of the current policy rejects go: also null and empty texts, which have too few words. Repeated rows are judged alike; a null doc_id doesn't matter; a very long text is measured whole by one task."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 of their shingles of five words), the document with the smallest doc_id stays.

    Rows without a doc_id can't be named and stay. Null and blank texts are one group. Of repeated rows (same id and text) one stays.
    A very long text is hashed whole by one task.
    """
    return similar.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that a document with a smaller doc_id has are taken out of the texts.

    A document that loses all its words goes; null and short texts stay as they are. A null doc_id counts as larger than all others.
    Rows of equal id don't count as copies of each other. A very long text is held whole by one task.
    """
    return _counted(substring.remove_repeats(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents and pieces of documents as the target weights of the sources draw them, in the order of shards.

    Texts without words are never drawn. A null source is a source of its own. Repeated rows are drawn each for itself. A very long
    text is cut into blocks like any other.
    """
    drawn = mixing.draws(docs)
    order = drawn.columns[-3:]  # shard, position and start, under names that docs doesn't have
    n = spread(spark, text_size(docs))
    return _counted(drawn.repartition(n, order[0]).sortWithinPartitions(*order[:2], "doc_id", order[2]).select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048: a row for each piece. Null text has the end token only; a null doc_id and repeated rows are packed like any other; a very long text is encoded whole by one task and cut."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("substring_dedup", repeated_passages), ("mixing", mix), ("packing", pack)]

#: Hash draws, fingerprints and token ids are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
