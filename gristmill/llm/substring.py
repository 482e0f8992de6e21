"""Removal of long word sequences that an earlier document has.

Fixed-block anchors. Every document is cut into non-overlapping blocks of 25 words, the reference blocks; any window of 50
words holds a whole one. All rolling windows of 25 words probe the index of blocks. A probe that meets a block of a smaller
document, and a block that is met from a larger one, are hits. Hits are then extended: the 50-word windows around them
are compared by 96-bit hashes, those that start in a smaller document are marked, and marked windows that overlap run
together into the maximal repeats, whose words go.

Probes outnumber everything else, so they don't travel as rows: for a group of positions and a bucket of hashes there is
one row with packed arrays (five bytes a probe, and 16 for each document in the row). Buckets follow the size of the
texts, slowly, since documents then share rows less; a task holds the blocks of a bucket, 20 bytes each. They end at ``BUCKETS``; beyond
that a bucket grows with the corpus (at 100 TB it stands for 6 GB of text, 37 million blocks). Partitions follow the size too.

Passages that very many documents share don't meet in one task: what a map task can settle alone doesn't travel. An entry
whose hash a smaller document of the same task is known to have is marked there and then; of probes one for each hash and group
goes on, so that the blocks which it meets are marked. So a hash travels at most some times for each task, not for each document.

Rows are told apart by doc_id and a hash of the text, so repeated rows of a document don't count as copies of each other.
A null doc_id counts as larger than every other; a null or short text has no window and keeps its words. A very long text is
held whole by the task that reads it, with eight bytes a word beside it, and packed in parts. An empty table gives an empty
result. Other columns are carried in a struct, so their names don't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import LAST_ID, released, spread, text_bytes, text_size

WINDOW = 50
BLOCK = 25
#: Positions that are packed together: so many for each bucket, within these bounds.
GROUP, EACH, MOST = 60_000, 4_600, 2_000_000
#: UTF-8 bytes of text a bucket stands for, and the least and most buckets.
BUCKET_BYTES, LEAST, BUCKETS = 400_000_000, 16, 1 << 14
#: Hashes whose least document a task remembers.
KNOWN = 1 << 16
#: Odd multipliers of the two rolling hashes, from the golden ratio and the square root of two.
BASES = (0x9E3779B97F4A7C15, 0x6A09E667F3BCC909)
PACKED = "bucket int, kind int, ids binary, tags binary, bases binary, starts binary, hashes binary, gaps binary"
RUNS = "d long, tag int, pos binary"


class _Words(dict):
    """Hashes of words, kept while there are few."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h


def _mixed(x):
    import numpy as np

    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Rolling:
    """Hashes of all windows of ``size`` words in an array of word hashes, modulo 2 to the 64."""

    def __init__(self, size: int, base: int) -> None:
        import numpy as np

        self.size, self.base, self.inverse = size, base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, words):
        import numpy as np

        n = len(words)
        if len(self.up) < n + 1:
            longer = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n + n // 2 + 64, b, np.uint64))])
            self.up, self.down = longer(self.base), longer(self.inverse)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.up[:n], dtype=np.uint64)])
        return _mixed((total[self.size :] - total[: -self.size]) * self.down[: n - self.size + 1])


def _gaps(pos) -> bytes:
    """Ascending positions as bytes of their differences; 255 carries on."""
    import numpy as np

    gap = np.diff(pos, prepend=0)
    more = gap // 255
    out = np.full(len(gap) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gap % 255
    return out.tobytes()


def _ungaps(raw: bytes):
    import numpy as np

    steps = np.frombuffer(raw, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


class _Known:
    """Of hashes that several documents of a task have: the least of these documents. Only a help; what it forgets travels."""

    def __init__(self) -> None:
        import numpy as np

        self.keys, self.least, self.others = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def settle(self, h, d, holds, other):
        """Of entries (hash, document, whether it can be met, more bits of the hash): which have a smaller document that is known to be met, and their hash's place."""
        import numpy as np

        keys, docs, others = np.concatenate([h[holds], self.keys]), np.concatenate([d[holds], self.least]), np.concatenate([other[holds], self.others])
        order = np.lexsort((docs, keys))
        keys = keys[order]
        first = order[np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]]
        keys, docs, others = np.unique(keys), docs[first], others[first]
        if not len(keys):
            return np.zeros(len(h), bool), None
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        settled = (keys[at] == h) & (d > docs[at]) & (other == others[at])
        used = np.unique(at[settled])
        if len(used):
            old = np.searchsorted(keys, self.keys)
            both = np.union1d(used, old) if len(used) + len(old) <= KNOWN else used[:KNOWN]
            self.keys, self.least, self.others = keys[both], docs[both], others[both]
        return settled, at


class _Packer:
    """Collects (document, position, hash) and packs them by bucket.

    Kinds of rows: 0 blocks, 1 probes (or windows, if ``wide``), 2 positions that are settled, without hashes.
    """

    def __init__(self, buckets: int, group: int, wide: bool) -> None:
        self.buckets, self.group, self.wide, self.known = buckets, group, wide, _Known()
        self.clear()

    def clear(self) -> None:
        self.docs, self.at, self.hashes, self.other, self.kinds, self.size = [], [], [], [], [], 0

    def add(self, d: int, tag: int, base: int, pos, hashes, other=None, block=None) -> None:
        """pos: positions less ``base``, within a group."""
        self.docs.append((d, tag, base, self.size))
        self.at.append(pos + self.size)
        self.hashes.append(hashes)
        if self.wide:
            self.other.append(other)
        else:
            self.kinds.append(block)
        self.size += int(pos[-1]) + 1

    def _settled(self, h, d, block, other):
        """Which entries needn't travel as blocks, and which of these not as probes either: these are marked."""
        import numpy as np

        settled, at = self.known.settle(h, d, block, other)
        one = np.zeros(len(h), bool)
        if settled.any() and not self.wide:  # the largest document's probe of each hash goes on
            i = np.flatnonzero(settled)
            i = i[np.lexsort((d[i], at[i]))]
            one[i[np.concatenate([at[i][1:] != at[i][:-1], [True]])]] = True
        return settled, settled & ~one

    def rows(self) -> Iterator[tuple]:
        import numpy as np

        if not self.docs:
            return
        d, tag, base, start = (np.array(x, t) for x, t in zip(zip(*self.docs), (np.int64, np.int32, np.uint32, np.int64)))
        at, h = np.concatenate(self.at), np.concatenate(self.hashes)
        doc = np.searchsorted(start, at, "right") - 1
        other = np.concatenate(self.other).astype(np.uint32) if self.wide else np.zeros(len(h), np.uint32)
        block = np.ones(len(h), bool) if self.wide else np.concatenate(self.kinds)
        held, marked = self._settled(h, d[doc], block, other)
        bucket = ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int32)
        low = h.astype(np.uint32)
        home = (_mixed(d.view(np.uint64)) % np.uint64(self.buckets)).astype(np.int32)
        for kind, pick, of in ((0, block & ~held, bucket), (1, ~marked, bucket), (2, marked, home[doc])):
            if self.wide and kind == 0:
                continue
            pick = np.flatnonzero(pick)
            pick = pick[np.argsort(of[pick], kind="stable")]
            sorted_ = of[pick]
            bounds = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(pick)]]).tolist() if len(pick) else [0]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                i = pick[lo:hi]
                # positions are packed against the starts of the documents that are in the row
                used = np.unique(doc[i])
                hashes = b"" if kind == 2 else b"".join((h[i].tobytes(), other[i].tobytes())) if self.wide else low[i].tobytes()
                yield int(sorted_[lo]), kind, d[used].tobytes(), tag[used].tobytes(), base[used].tobytes() if base[used].any() else b"", start[used].astype(np.uint32).tobytes(), hashes, _gaps(at[i])
        self.clear()


def _batch(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _batches(rows: Iterator[tuple], schema: str, most: int = 512) -> Iterator:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _word_hashes(cache: _Words, words: list[bytes]):
    import numpy as np

    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def _probes(buckets: int, group: int, window: int, block: int, batches: Iterator) -> Iterator:
    """Of documents: their rolling windows and blocks, packed."""
    import numpy as np

    cache, roll, packer = _Words(), _Rolling(block, BASES[0]), _Packer(buckets, group, False)

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for d, tag, text in zip(batch.column("d").to_pylist(), batch.column("tag").to_pylist(), text_bytes(batch.column("text"))):
                words = text.split()
                if len(words) < window:
                    continue
                h = roll(_word_hashes(cache, words))
                for k in range(0, len(h), group):
                    part = h[k : k + group]
                    at = np.arange(len(part))
                    if packer.size + len(part) > group:
                        yield from packer.rows()
                    packer.add(d, tag, k, at, part, block=(at + k) % block == 0)
        yield from packer.rows()
        released()

    return _batches(rows(), PACKED)


def _unpack(row: dict, wide: bool):
    """Document of each entry (an index), position in it, and hashes; the documents' ids and tags."""
    import numpy as np

    start, base = np.frombuffer(row["starts"], np.uint32).astype(np.int64), np.frombuffer(row["bases"], np.uint32).astype(np.int64)
    base = base if len(base) else np.zeros(len(start), np.int64)
    at = _ungaps(row["gaps"])
    doc = np.searchsorted(start, at, "right") - 1
    raw = row["hashes"]
    if row["kind"] == 2:
        h = None
    elif wide:
        h = np.frombuffer(raw[: 8 * len(at)], np.uint64), np.frombuffer(raw[8 * len(at) :], np.uint32)
    else:
        h = np.frombuffer(raw, np.uint32)
    return doc, at - start[doc] + base[doc], h, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["tags"], np.int32)


def _by_bucket(batches: Iterator) -> Iterator[tuple[int, Iterator[dict]]]:
    from itertools import groupby

    yield from groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["bucket"])


def _runs(doc, pos, ids, tags) -> Iterator[tuple]:
    """A row for each document: its positions."""
    import numpy as np

    if len(doc):
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield int(ids[doc[i]]), int(tags[doc[i]]), pos[i:j].astype(np.uint32).tobytes()


def _hits(batches: Iterator) -> Iterator:
    """Of packed rows in the order of bucket and kind: the positions of hits, by document."""
    import numpy as np

    def rows() -> Iterator[tuple]:
        for _, group in _by_bucket(batches):
            blocks, index = [], None
            for row in group:
                doc, pos, h, ids, tags = _unpack(row, False)
                if row["kind"] == 2:
                    yield from _runs(doc, pos, ids, tags)
                    continue
                if row["kind"] == 0:
                    blocks.append((h, ids[doc], tags[doc], pos.astype(np.uint32)))
                    continue
                if not blocks:
                    continue
                if index is None:
                    bh, bd, bt, bp = (np.concatenate(x) for x in zip(*blocks))
                    order = np.lexsort((bd, bh))
                    bh, bd, bt, bp = bh[order], bd[order], bt[order], bp[order]
                    first = np.flatnonzero(np.concatenate([[True], bh[1:] != bh[:-1]]))
                    index, least, met = bh[first], bd[first], np.zeros(len(first), bool)
                k = np.searchsorted(index, h)
                k[k == len(index)] = 0
                found = (index[k] == h) & (ids[doc] > least[k])
                met[k[found]] = True
                yield from _runs(doc[found], pos[found], ids, tags)
            if index is not None:
                on = met[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(bh))))]
                d, t, p = bd[on], bt[on], bp[on]
                order = np.lexsort((p, t, d))
                d, t, p = d[order], t[order], p[order]
                bounds = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 0) | (np.diff(t) != 0)])) if len(d) else np.zeros(0, int)
                for i, j in zip(bounds.tolist(), [*bounds[1:].tolist(), len(d)]):
                    yield int(d[i]), int(t[i]), p[i:j].tobytes()

    return _batches(rows(), RUNS)


def _candidates(buckets: int, group: int, window: int, block: int, batches: Iterator) -> Iterator:
    """Of documents with the positions of their hits: the windows around them, packed."""
    import numpy as np

    cache, packer = _Words(), _Packer(buckets, group, True)
    roll = [_Rolling(window, b) for b in BASES]

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for d, tag, text, hits in zip(batch.column("d").to_pylist(), batch.column("tag").to_pylist(), text_bytes(batch.column("row").field("text")), batch.column("hits").to_pylist()):
                words = text.split()
                n = len(words) - window + 1
                if n < 1:
                    continue
                pos = np.unique(np.frombuffer(b"".join(hits), np.uint32).astype(np.int64))
                edge = np.zeros(len(words) + 2, np.int64)
                np.add.at(edge, np.maximum(pos - (window - block), 0), 1)
                np.add.at(edge, np.minimum(pos, n - 1) + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge[:n]) > 0)
                word = _word_hashes(cache, words)
                a, b = roll[0](word)[starts], (roll[1](_mixed(word))[starts] >> np.uint64(32)).astype(np.uint32)
                for k in range(0, n, group):
                    i, j = np.searchsorted(starts, (k, k + group))
                    if i == j:
                        continue
                    if packer.size + int(starts[j - 1]) - k >= group:
                        yield from packer.rows()
                    packer.add(d, tag, k, starts[i:j] - k, a[i:j], b[i:j])
        yield from packer.rows()
        released()

    return _batches(rows(), PACKED)


def _repeats(batches: Iterator) -> Iterator:
    """Of packed windows in the order of the bucket: the starts of those that a smaller document has too, by document."""
    import numpy as np

    def rows() -> Iterator[tuple]:
        for _, group in _by_bucket(batches):
            got = []
            for row in group:
                entry = _unpack(row, True)
                if row["kind"] == 2:
                    yield from _runs(entry[0], entry[1], entry[3], entry[4])
                else:
                    got.append(entry)
            if not got:
                continue
            a, b = np.concatenate([x[2][0] for x in got]), np.concatenate([x[2][1] for x in got])
            d = np.concatenate([x[3][x[0]] for x in got])
            order = np.lexsort((d, b, a))
            a, b = a[order], b[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            least = d[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
            again = np.empty(len(d), bool)
            again[order] = d[order] > least
            at = 0
            for doc, pos, _, ids, tags in got:
                on = again[at : at + len(doc)]
                at += len(doc)
                yield from _runs(doc[on], pos[on], ids, tags)

    return _batches(rows(), RUNS)


def removed_mask(n: int, starts: list[bytes] | None, window: int = WINDOW):
    """Of n words, those that the windows at ``starts`` cover."""
    import numpy as np

    edge = np.zeros(n + window + 1, np.int64)
    if starts:
        pos = np.frombuffer(b"".join(starts), np.uint32)
        np.add.at(edge, pos, 1)
        np.add.at(edge, pos + np.uint32(window), -1)
    return np.cumsum(edge[:n]) > 0


def marked(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, bucket_bytes: int = BUCKET_BYTES, group: int | None = None) -> DataFrame:
    """The columns of ``docs`` with ``d``, ``tag`` (keys of the row) and ``starts``: packed positions of the windows to remove, or null.

    ``docs`` has doc_id and text; names beginning with two underscores aside, any other column is carried along.
    """
    if not 0 < 2 * block - 1 <= window:
        raise ValueError("a window must hold a whole block wherever it starts")
    size = text_size(docs)
    n = spread(docs.sparkSession, size)  # packed probes are about as large as the texts
    buckets = min(BUCKETS, max(LEAST, -(-size // bucket_bytes)))
    group = group or min(MOST, max(GROUP, EACH * buckets))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"), F.hash("text").alias("tag"), F.struct(*docs.columns).alias("row"))
    texts = keyed.select("d", "tag", F.col("row.text").alias("text"))
    packed = texts.mapInArrow(lambda b: _probes(buckets, group, window, block, b), PACKED)
    hits = packed.repartition(n, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_hits, RUNS)
    hits = hits.groupBy("d", "tag").agg(F.collect_list("pos").alias("hits"))
    dealt = keyed.repartition(n, "d", "tag")  # the one shuffle of the texts, used twice
    around = dealt.join(hits, ["d", "tag"]).select("d", "tag", "row", "hits")  # whole rows, or the shuffle isn't the same one
    windows = around.mapInArrow(lambda b: _candidates(buckets, group, window, block, b), PACKED)
    again = windows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeats, RUNS)
    again = again.groupBy("d", "tag").agg(F.collect_list("pos").alias("starts"))
    return dealt.join(again, ["d", "tag"], "left")


def _rows(batch) -> Iterator[tuple[bytes, list[bytes] | None]]:
    yield from zip(text_bytes(batch.column("row").field("text")), batch.column("starts").to_pylist())


def _digests(window: int, batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        out = []
        for text, starts in _rows(batch):
            words = text.split()
            kept = [w for w, x in zip(words, removed_mask(len(words), starts, window).tolist()) if not x] if starts else words
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, r, h = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("row").field("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(h, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def digests(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, **more) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each document."""
    found = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), window, block, **more)
    return found.select("row", "starts").mapInArrow(lambda b: _digests(window, b), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _kept(window: int, batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        row, texts, stay = batch.column("row"), [], []
        for i, (text, starts) in enumerate(_rows(batch)):
            if starts:
                words = text.split()
                text = b" ".join(w for w, x in zip(words, removed_mask(len(words), starts, window).tolist()) if not x)
                if not text:
                    continue
            texts.append(text.decode() if row.field("text")[i].is_valid else None)
            stay.append(i)
        names = [f.name for f in row.type]
        columns = {n: row.field(n).take(pa.array(stay, pa.int64())) for n in names}
        columns["text"] = pa.array(texts, columns["text"].type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, **more) -> DataFrame:
    """``docs`` with the repeated words taken out of the texts (what is left joined by one space). A document that loses all its words goes; untouched texts stay as they are."""
    found = marked(docs, window, block, **more).select("row", "starts")
    return found.mapInArrow(lambda b: _kept(window, b), T.StructType(docs.schema.fields))
