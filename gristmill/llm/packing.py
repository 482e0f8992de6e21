"""Packing of token sequences: best-fit decreasing over a histogram.

Documents are cut into full windows and a rest. The rests, longest first, go to the tightest open window that holds them;
a segment tree indexed by remaining capacity finds it. As only lengths matter, the packing runs on the number of rests of
each length, at most ``size`` numbers however many documents there are: equal rests that go the same way are placed as a
run, and windows in the same state are an interval of their ids. The plan of runs (a few thousand rows at most, by the
number of lengths, not of documents) is then joined to the rests, which are numbered within their length in parallel.

Null text is empty: its only token is the end token. An empty table gives no pieces. Repeated rows are packed each for itself.
A null doc_id is packed like any other. Which of several rests of equal length stands where is decided by doc_id, place and
checksum. A very long text is encoded as a whole by one task: its ids take four bytes each. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import cut, parts, released

SIZE = 2048
END = 1
#: What a file must say for the fast way to be taken, where a tokenizer of that kind cuts a text before it merges, and a text to try it on.
KNOWN = {"normalizer": None, "post_processor": None}
CUTTER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = "A, the 'b's x9  naïve_test (12)\t\t end. \n\n New <tag>   line's \r\n"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, tie long"


class _Tree:
    """A segment tree over capacities that says which have open windows."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = self.leaves + capacity
        while i:
            self.open[i] += n
            i >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of ``length`` or more with an open window."""
        i = self.leaves + length
        if self.open[i]:
            return length
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


@dataclass(frozen=True)
class Run:
    """Rests of one length from rank ``first`` on, ``n`` of them, ``each`` to a window, from ``window`` on, in each from ``offset`` on."""

    length: int
    first: int
    n: int
    each: int
    window: int
    offset: int


def plan(counts: dict[int, int], size: int = SIZE) -> list[Run]:
    """Best-fit decreasing of ``counts[length]`` rests of each length into windows of ``size``."""
    tree, at, runs, opened = _Tree(size), {}, [], 0  # at: by capacity, intervals (first window, number)
    for length in sorted((k for k, n in counts.items() if k and n), reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:  # so many windows are opened as the rest of this length fills
                n, capacity = -(-left // (size // length)), size
                window, opened = opened, opened + n
            else:
                window, n = at[capacity].pop()
                tree.add(capacity, -n)
            each = capacity // length  # a window that was the tightest stays so while it holds one more
            full = min(n, left // each)
            used = full * each
            if full:
                runs.append(Run(length, rank, used, each, window, size - capacity))
                _put(tree, at, capacity - each * length, window, full)
            if full < n and left > used:
                some = left - used
                if some < each or not full:
                    some = min(some, each)
                    runs.append(Run(length, rank + used, some, some, window + full, size - capacity))
                    _put(tree, at, capacity - some * length, window + full, 1)
                    used, full = used + some, full + 1
            if full < n:
                _put(tree, at, capacity, window + full, n - full)
            left, rank = left - used, rank + used
    return runs


def _put(tree: _Tree, at: dict, capacity: int, window: int, n: int) -> None:
    if capacity:
        at.setdefault(capacity, []).append((window, n))
        tree.add(capacity, n)


class ByteBpe:
    """Token ids as little-endian unsigned 32-bit bytes, by a tokenizer file of the ``tokenizers`` library.

    Texts are encoded by ``tiktoken`` with the file's own vocabulary where the file is known to mean the same: normalizer,
    cutting and model are the known ones, every merge makes the id next in order, and characters of every block of Unicode,
    alone and with marks, come out equal. Else, for texts with a special token's string, and where the other gives up (on
    very long white space), ids come from ``tokenizers``.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merger = self._merger(path)
        some = [chr(c) for c in [*range(1, 0x3400, 5), *range(0x3400, 0xD800, 61), *range(0xE000, 0x110000, 251)]]
        probe = [PROBE, *(c + "x" + c for c in some), *("e" + c + "\u0301 " + c for c in some[::3])]
        if self.merger and self(probe) != self.whole(probe):
            self.merger = None

    @staticmethod
    def _merger(path: str):
        """The same vocabulary in ``tiktoken``, which is faster on short texts; its ranks are the ids of the file. None where the file isn't of the known kind."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, cutter = said.get("model") or {}, said.get("pre_tokenizer") or {}
        if any(d.get(k) != v for d, known in ((said, KNOWN), (cutter, CUTTER), (model, MODEL)) for k, v in known.items()):
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in {x["content"] for x in said.get("added_tokens") or ()}}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = sorted(vocabulary[a + b] for a, b in merges)
        if [vocabulary[a + b] for a, b in merges] != made or len(vocabulary) != 256 + len(made) or any(not set(t) <= byte.keys() for t in vocabulary):
            return None
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items()}
        return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def one(self, text: str) -> bytes:
        if not any(x in text for x in self.special):
            try:
                return array("I", self.merger.encode_ordinary(text)).tobytes()
            except BaseException as e:  # a panic of its cutter, on very long white space, is no Exception
                if type(e).__name__ != "PanicException":
                    raise
        return self.whole([text])[0]

    def __call__(self, texts: list[str]) -> list[bytes]:
        return self.whole(texts) if self.merger is None else [self.one(t) for t in texts]


@functools.lru_cache(1)
def tokenizer(path: str) -> ByteBpe:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteBpe(path)


def _pieces(path: str, size: int, end: int, batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    encode, last = tokenizer(path), np.array([end], "<u4").tobytes()
    names = [x.split()[0] for x in PIECES.split(", ")]
    try:
        for batch in batches:
            for ids_of, texts in _some(batch):
                out = []
                for doc_id, ids in zip(ids_of, encode([t or "" for t in texts])):
                    ids += last
                    whole = zlib.crc32(ids)
                    for k in range(0, len(ids), 4 * size):
                        part = ids[k : k + 4 * size]
                        out.append((doc_id, k // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, whole))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
    finally:
        released()


def _some(batch, most: int = 500_000) -> Iterator[tuple[list, list]]:
    """Of a batch: ids and texts, some hundred thousand characters at a time."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0), batch.column(1)):
        ids.append(doc_id.as_py())
        texts.append(text.as_py())
        size += len(texts[-1] or "")
        if size > most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Tokenized documents, cut into full windows and a rest."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(lambda b: _pieces(path, size, end, b), PIECES)


def ranked(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds ``rank``, from 0 on within ``key``. A key's rows are dealt out by a hash of the order and numbered there; what comes before each deal is summed over a table of counts."""
    n = 8 * parts(rows.sparkSession)
    dealt = rows.withColumn("__deal", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = dealt.groupBy(key, "__deal").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__deal").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy(key, "__deal").orderBy(*order)
    numbered = dealt.withColumn("__at", F.row_number().over(within))
    return numbered.join(counts, [key, "__deal"]).withColumn("rank", F.col("__at") - 1 + F.col("__before")).drop("__deal", "__at", "__before")


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    cuts = cut(pieces(docs, path, size, end))
    counts = {r.length: r.n for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    runs = [(r.length, r.first, r.n, r.each, r.window, r.offset) for r in plan(counts, size)]
    schema = "length long, first long, n long, each long, window long, at long"
    table = spark.createDataFrame(runs, schema)
    numbered = ranked(cuts, "length", "doc_id", "start", "tie")
    placed = numbered.join(F.broadcast(table), "length").where("rank >= first and rank < first + n")
    j = "(rank - first)"
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.expr(f"window + {j} div each").alias("sequence_id"),
        F.expr(f"at + ({j} % each) * length").alias("offset"),
    )
