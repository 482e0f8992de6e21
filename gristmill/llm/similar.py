"""SimHash near-duplicates at a similarity of 0.8, for the pipeline.

The method is that of ``simhash``, over shingles of five words: fingerprints, the grid over their segments' popcounts, the range of three bits, star
contraction. Each component of fingerprints so found is a cell. An exact check follows it (one phrase repeated often rules a fingerprint).
Texts that share 0.8 of their shingles differ in up to a quarter of the bits, though, which no grid over 64 bits can look up. So that
none of these is lost, further cells come from samples of the shingles: of each of ``CELLS`` orders by hash, the two smallest
shingles make a cell (at 0.8 two texts share one of eight cells but for three cases in 10,000). A fingerprint's distance rules out no pair.
Within a cell of either kind, pairs whose sizes and rarest shingles allow the similarity, and that
would connect more of the cell's members, are verified on the shingles themselves, all of them, by their 64-bit hashes. A cell hands on no more pairs than it has members; cells of one are dropped
before anything travels, as are all but one of the cells that have the same members, and only texts in other cells are read again for their hashes. Large cells are dealt out as pairs of blocks, of
``cell`` texts and about ``HASHES`` hashes each.

Texts with the same shingles (their sorted 64-bit hashes agree, by a hash over all of them) are one class from the start, so groups of
copies count once. Null and blank texts are one class too. A null doc_id names nothing; such rows join no group by name. An empty
table gives an empty result. A very long text is hashed by one task, eight bytes a shingle. Only doc_id and text are read, so other
columns' names don't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import cut, parts, released, text_bytes
from gristmill.llm.graph import components
from gristmill.llm.simhash import CHUNK, SEED, links, majority

SHINGLE = 5
SIMILARITY = 0.8
CELLS = 8
#: Texts in a block of a cell.
CELL = 512
#: Hashes of shingles in a block of a cell: 8 MB, and some ten times that while its pairs are sought.
HASHES = 1 << 20
SCHEMA = "doc_id long, h long, size long, fp long, cells array<long>"


def sketch(text: bytes, shingle: int = SHINGLE):
    """Cells, sorted distinct hashes and fingerprint of a text's shingles (A-Z lower-cased)."""
    import numpy as np
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return [0], b"", 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, stops = (ends - size)[:n].tolist(), ends[-n:].tolist()
    raw = b"".join([xxh64_digest(line[i:j], SEED) for i, j in zip(starts, stops)])
    hashes = np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))
    cells = []
    for k in range(CELLS):
        mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        two = np.sort(np.partition(mixed, 1)[:2] if len(mixed) > 2 else mixed)
        cells.append(int.from_bytes(xxh64_digest(two.tobytes(), k), "little", signed=True))
    return cells, hashes.tobytes(), majority(raw[k : k + 8 * CHUNK] for k in range(0, len(raw), 8 * CHUNK))


def _sketches(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    for batch in batches:
        h, size, fp, cells = [], [], [], []
        for text in text_bytes(batch.column(1)):
            found = sketch(text)
            h.append(xxh64_intdigest(found[1], 1))
            size.append(len(found[1]) // 8)
            fp.append(found[2])
            cells.append(found[0])
        columns = [batch.column(0), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (h, size, fp)), pa.array(cells, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "size", "fp", "cells"])


def _hashes(batches: Iterator) -> Iterator:
    """Of rows with ``h`` and ``text``: the hashes of the texts that have this ``h``."""
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    for batch in batches:
        h, hashes = [], []
        for want, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
            found = sketch(text)[1]
            if xxh64_intdigest(found, 1) == want & (1 << 64) - 1:
                h.append(want)
                hashes.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(hashes, pa.binary())], names=["h", "hashes"])


def verified_pairs(hashes: list[bytes], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Positions of verified pairs that connect the members of a cell, by rising size of the smaller text.

    Nothing is estimated. Texts that share ``similarity`` of their shingles differ in size by that factor at most, and of all orders
    of shingles, here rare ones first, they share one of the first ``size - need + 1``, where ``need`` is the least that they have in common.
    """
    import numpy as np

    order = sorted(range(len(hashes)), key=lambda k: len(hashes[k]))
    size = np.array([len(hashes[k]) // 8 for k in order], np.int64)
    ends = np.cumsum(size)
    starts, owner = ends - size, np.repeat(np.arange(len(order)), size)
    _, token, count = np.unique(np.frombuffer(b"".join(hashes[k] for k in order), np.uint64), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    token = rank[token]
    token = token[np.lexsort((token, owner))]
    need = np.ceil(similarity * size - 1e-9).astype(np.int64)
    head = np.arange(len(token)) - np.repeat(starts, size) <= np.repeat(size - need, size)
    early, whose = token[head], owner[head]
    by = np.argsort(early, kind="stable")
    holders, place = whose[by], np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    stop = np.searchsorted(early[by], early, "right")
    first = np.searchsorted(whose, np.arange(len(order) + 1))
    label, mark, out = np.arange(len(order)), np.zeros(len(count), bool), []
    for x in range(len(order) - 1):
        if not size[x] or (label[x + 1 :] == label[x]).all():
            continue
        met = np.zeros(len(order), bool)
        for k in range(first[x], first[x + 1]):
            met[holders[place[k] + 1 : stop[k]]] = True
        met &= (label != label[x]) & (similarity * size <= size[x] + 1e-9)
        left = np.nonzero(met)[0]
        mark[token[starts[x] : ends[x]]] = True
        while len(left):
            some, left = left[:256], left[256:]
            both = np.add.reduceat(mark[np.concatenate([token[starts[y] : ends[y]] for y in some])], np.cumsum(size[some]) - size[some], dtype=np.int64)
            for y in some[both >= similarity * (size[x] + size[some] - both)].tolist():
                if label[y] != label[x]:
                    label[label == label[y]] = label[x]
                    out.append((order[x], order[y]))
            left = left[label[left] != label[x]]  # pairs that would connect nothing more
        mark[token[starts[x] : ends[x]]] = False
    return out


def _pairs(similarity: float, batches: Iterator) -> Iterator:
    """Of rows in the order of cell and sub: the pairs of every cell."""
    from itertools import groupby

    import pyarrow as pa

    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("cell", "sub", "h", "hashes"))))
    a, b = [], []
    for _, group in groupby(rows, key=lambda r: r[:2]):
        members = list(group)
        if len(members) > 1:
            for p, q in verified_pairs([m[3] for m in members], similarity):
                a.append(members[p][2])
                b.append(members[q][2])
        del members
        if len(a) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    released()


def groups(docs: DataFrame, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """``doc_id, component_id`` for each document; the component is the smallest doc_id that verified links reach. Blank texts are one class."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole = cut(narrow.mapInArrow(_sketches, SCHEMA))
    least = whole.groupBy("h").agg(F.min("doc_id").alias("least"))
    found = whole.select("h", "size", "fp").distinct()
    near = components(links(cut(found.select("fp").distinct()))).withColumnRenamed("node", "fp")
    alone = F.coalesce("label", "fp")  # texts may share a fingerprint that is near no other
    near = cut(found.join(near, "fp", "left").select("h", "size", F.xxhash64(F.lit("fp"), alone).alias("cell")))
    rows = whole.select("h", "size", F.explode("cells").alias("cell")).unionByName(near).distinct()
    # of cells with the same members one is enough: near copies share several, and mostly with each other only
    alike = rows.groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("h")).alias("x"), F.sum(F.hash("h").cast("long")).alias("s")).where("n > 1")
    full = alike.groupBy("n", "size", "x", "s").agg(F.min("cell").alias("cell")).select("cell", F.ceil(F.greatest(F.col("n") / cell, F.col("size") / HASHES)).cast("int").alias("r"))
    block = "cast(pmod(xxhash64(h), r) as int)"
    sub = f"explode(if(r = 1, array(0), transform(sequence(0, r - 1), j -> least(j, {block}) * r + greatest(j, {block}))))"
    dealt = rows.join(full, "cell").select("cell", "h", F.expr(sub).alias("sub"))
    chosen = least.join(dealt.select("h").distinct(), "h").select("h", F.col("least").alias("doc_id"))
    texts = narrow.join(chosen, "doc_id").select("h", "text").mapInArrow(_hashes, "h long, hashes binary").dropDuplicates(["h"])
    members = dealt.join(texts, "h").repartition(parts(docs.sparkSession), "cell", "sub").sortWithinPartitions("cell", "sub")
    label = components(members.mapInArrow(lambda x: _pairs(similarity, x), "a long, b long"))
    joined = cut(least.join(label.select(F.col("node").alias("h"), "label"), "h", "left").withColumn("label", F.coalesce("label", "h")))
    by = joined.join(joined.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("h", "component_id")
    return whole.select("doc_id", "h").join(by, "h").select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id, with its own columns. Rows without a doc_id can't be named and stay; of repeated rows (same id and text) one stays."""
    named = docs.where("doc_id is not null")
    first = groups(named, similarity).where("doc_id = component_id").select("doc_id").distinct()
    w = Window.partitionBy("doc_id", "__h").orderBy(F.lit(0))
    kept = named.withColumn("__h", F.xxhash64("text")).join(first, "doc_id", "left_semi").withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))
