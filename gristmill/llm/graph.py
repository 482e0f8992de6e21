"""Connected components by star contraction: distributed, with a checkpoint each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every end of an edge; label is the smallest node of its component.

    A round links every larger neighbour of a node to its smallest neighbour (large star), then every smaller one
    (small star); rounds end when the edges no longer change. Each is a minimum by key, which Spark combines before the
    shuffle, and a join with one row a key on one side. Self loops and null ends are ignored; repeated edges don't matter.
    """
    big, small = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    now = cut(edges.where(f"{a} is not null and {b} is not null and {a} != {b}").select(big.alias("u"), small.alias("v")).distinct())
    before = _digest(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # the node's own tie to its minimum comes from the larger end, so that no edge is lost
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        now = cut(near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _digest(now)
        if after == before:
            break
        before = after
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("label"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
    return row.n, row.x, row.s
