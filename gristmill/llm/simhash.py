"""SimHash near-duplicates through a popcount embedding.

A fingerprint of 64 bits is cut into 32 segments of two bits, and a segment is embedded as its bit count (0, 1 or 2). The
Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints, so fingerprints within three
bits are within Manhattan distance three. Then one of the two halves of the embedding (16 segments each) differs by at
most one: equal, or one step in one segment. The grid has a cell for each half and each of its vectors; a fingerprint
stands in its two home cells and looks into the cells one step above (the step below is the other's step above), which
finds every pair within the range. In a cell the Manhattan bound is checked first and the Hamming distance after it.

Only distinct fingerprints enter the grid. A cell hands on no more edges than it has members: a forest that spans the
links found in it. Cells with more than ``CELL`` members, or as many that look in, are dealt out as pairs of blocks, so that no
task holds one whole. A very long text is hashed in chunks by one task. Equal fingerprints are one node; which of two documents
comes first doesn't matter, as a component is named by its smallest doc_id. Only doc_id and text are read, so other columns' names don't clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import cut, parts, text_bytes
from gristmill.llm.graph import components

SEED = 42
BITS = 3
CELL = 4096
#: Shingles that are hashed at once.
CHUNK = 1 << 14
EVEN = 0x5555555555555555


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the shingles of a text, A-Z lower-cased, repeats counted; 0 without words."""
    import numpy as np
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - 1 - np.fromiter(map(len, words), np.int64, len(words)))[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    return majority(b"".join([xxh64_digest(line[i:j], SEED) for i, j in zip(starts[k : k + CHUNK], stops[k : k + CHUNK])]) for k in range(0, n, CHUNK))


def majority(chunks: Iterable[bytes]) -> int:
    """The fingerprint of hashes of eight bytes, repeats counted: the bits that are set in over half of them."""
    import numpy as np

    count, n = np.zeros(64, np.int64), 0
    for raw in chunks:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def _fingerprints(shingle: int, batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        seen: dict[bytes, int] = {}
        found = []
        for t in text_bytes(batch.column(1)):
            f = seen.get(t)
            if f is None:
                f = seen[t] = fingerprint(t, shingle)
            found.append(f)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long."""
    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return narrow.mapInArrow(lambda b: _fingerprints(shingle, b), "doc_id long, fp long")


def embed(fp: Column) -> Column:
    """The bit counts of the 32 segments, each in unary in two bits: 00, 01, 11. Then the Manhattan distance is the number of differing bits."""
    even = F.lit(EVEN)
    above = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(above).bitwiseAND(even).bitwiseOR(F.shiftleft(fp.bitwiseAND(above).bitwiseAND(even), 1))


def grid(fps: DataFrame) -> DataFrame:
    """``cell, home, fp``: the two home cells of each fingerprint, and the cells one step above them."""
    t = F.col("t")
    half = lambda k: F.shiftrightunsigned(t, 32 * k).bitwiseAND(F.lit((1 << 32) - 1))

    def cells(k: int) -> Column:
        h = half(k)
        field = lambda i: F.expr(f"(shiftrightunsigned(t, cast({32 * k} + 2 * {i} as int)) & 3L)")
        steps = [F.when(field(i) == 0, h + (1 << (2 * i))).when(field(i) == 1, h + (2 << (2 * i))) for i in range(16)]
        return F.array(*(F.struct(F.when(c.isNotNull(), c + (k << 32)).alias("cell"), F.lit(home).alias("home")) for c, home in [(h, True), *((s, False) for s in steps)]))

    rows = fps.select("fp", embed(F.col("fp")).alias("t")).select("fp", F.explode(F.concat(cells(0), cells(1))).alias("c"))
    return rows.select("c.cell", "c.home", "fp").where("cell is not null")


def _deal(rows: DataFrame, cell: int) -> DataFrame:
    """Adds ``sub``: what stands in a cell and what looks in are cut into blocks of ``cell`` each; pairs of home blocks, and of a home block and a block that looks in, are dealt out, so no task holds a cell whole."""
    size = lambda on: F.greatest(F.lit(1), F.ceil(F.sum(F.when(on, 1).otherwise(0)) / cell)).cast("int")
    hot = rows.groupBy("cell").agg(F.count("*").alias("n"), size(F.col("home")).alias("r"), size(~F.col("home")).alias("q")).where("r > 1 or q > 1").select("cell", "r", "q")
    dealt = rows.join(hot, "cell", "left")
    block, look = "cast(pmod(xxhash64(fp), r) as int)", "cast(pmod(xxhash64(fp, 7), q) as int)"
    pairs = f"transform(sequence(0, r - 1), j -> least(j, {block}) * r + greatest(j, {block}))"
    seen = f"transform(sequence(0, q - 1), j -> r * r + {block} * q + j)"
    looks = f"transform(sequence(0, r - 1), j -> r * r + j * q + {look})"
    return dealt.withColumn("sub", F.expr(f"explode(case when r is null then array(0) when home then concat({pairs}, {seen}) else {looks} end)")).drop("r", "q")


def _unary(x):
    import numpy as np

    even, one = np.uint64(EVEN), np.uint64(1)
    return ((x | (x >> one)) & even) | (((x & (x >> one)) & even) << one)


def spanning(fp, home, bits: int = BITS) -> list[tuple[int, int]]:
    """Positions of linked members of a cell, only as many as connect them."""
    import numpy as np

    root = list(range(len(fp)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, t, at = [], _unary(fp), np.flatnonzero(home)
    for k in range(0, len(at), 256):
        rows = at[k : k + 256]
        near = np.bitwise_count(t[rows, None] ^ t[None, :]) <= bits
        i, j = np.nonzero(near)
        i = rows[i]
        ok = (np.bitwise_count(fp[i] ^ fp[j]) <= bits) & (i != j)
        for x, y in zip(i[ok].tolist(), j[ok].tolist()):
            p, q = find(x), find(y)
            if p != q:
                root[p] = q
                out.append((x, y))
    return out


def _links(bits: int, batches: Iterator) -> Iterator:
    """Of rows in the order of cell and sub: the edges of every cell."""
    import numpy as np
    import pyarrow as pa

    held = None

    def edges(cell, sub, home, fp):
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(sub) != 0)) + 1
        bounds = np.concatenate([[0], cuts, [len(cell)]])
        a, b = [], []
        for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
            i, j = bounds[k], bounds[k + 1]
            if not home[i:j].any():
                continue
            x = fp[i:j]
            for p, q in spanning(x, home[i:j], bits):
                a.append(x[p])
                b.append(x[q])
        return pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], names=["a", "b"])

    for batch in batches:
        now = [batch.column("cell").to_numpy(), batch.column("sub").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy().view(np.uint64)]
        if not len(now[0]):
            continue
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        last = np.flatnonzero((now[0] == now[0][-1]) & (now[1] == now[1][-1]))[0]
        if last:
            yield edges(*(x[:last] for x in now))
        held = [x[last:] for x in now]
    if held is not None:
        yield edges(*held)


def links(fps: DataFrame, bits: int = BITS, cell: int = CELL) -> DataFrame:
    """Edges ``a, b`` that connect the distinct fingerprints ``fp`` within three bits of each other."""
    if bits > 3:
        raise ValueError("the grid finds links of three bits at most")
    rows = _deal(grid(fps), cell).repartition(parts(fps.sparkSession), "cell", "sub").sortWithinPartitions("cell", "sub")
    return rows.mapInArrow(lambda b: _links(bits, b), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = BITS, doc_id: str = "doc_id", text: str = "text", cell: int = CELL) -> DataFrame:
    """``doc_id, fp, component_id`` for each document; the component is the smallest doc_id that links reach.

    Null or blank texts have fingerprint 0 and link like any other. Repeated rows stay. A null doc_id joins its component
    without naming it; a component of null ids only has a null id. An empty table gives an empty result.
    """
    whole = cut(fingerprints(docs, shingle, doc_id, text))
    distinct = cut(whole.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(links(distinct.select("fp"), bits, cell))
    joined = distinct.join(label.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    joined = cut(joined)
    whose = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = joined.join(whose, "label").select("fp", "component_id")
    return whole.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, bits: int = BITS) -> DataFrame:
    """One document of each component stays, that with the smallest doc_id, with its own columns.

    Rows without a doc_id can't be named and stay. Of repeated rows (same id and text) one stays.
    """
    named = docs.where("doc_id is not null")
    groups = near_duplicates(named, shingle, bits).where("doc_id = component_id").select("doc_id").distinct()
    w = Window.partitionBy("doc_id", "__h").orderBy(F.lit(0))
    kept = named.withColumn("__h", F.xxhash64("text")).join(groups, "doc_id", "left_semi").withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))
