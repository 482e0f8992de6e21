"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document, from the measurements of the rule ledger. Expectation
maximisation estimates how each labeller votes on good and on bad documents and the posterior of every combination of
votes; documents are first counted by combination (at most 3 to the number of labellers), so all of them count whatever
their number. Posteriors are then the labels on which a linear scorer over hashed words is fitted, and it scores all texts.

The scorer is fitted on a bounded sample: ``sample`` documents by a hash of the id, and of these as many as have
``FEATURES`` features together, which is what the driver holds at most (eight bytes each). Scores read whole texts.

Null text is empty and scores like other texts without words. A very long text is one task's, with a number for each distinct word.
Documents whose ids have one hash are taken in the order of posterior and features. An empty table gives an empty result; repeated
rows score alike. Only doc_id and text are read, so other columns' names don't clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import text_bytes
from gristmill.llm.quality_rules import measure

GOOD, BAD, NONE = 1, 0, 2
BUCKETS = 1 << 16
SAMPLE = 4000
#: Features of the sample that reach the driver.
FEATURES = 8_000_000


@dataclass(frozen=True)
class Labeller:
    name: str
    bad: str
    good: str


LABELLERS = (
    Labeller("length", "n_words < 10", "n_words between 30 and 100000"),
    Labeller("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    Labeller("lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 and n_lines >= 3"),
    Labeller("repeats", "10 * n_repeat_words > 3 * n_words", "50 * n_repeat_words <= n_words"),
    Labeller("word_length", "word_chars > 8 * n_words or word_chars < 3 * n_words", "word_chars between 4 * n_words and 7 * n_words"),
    Labeller("line_length", "n_words > 200 * n_lines", "n_words between 5 * n_lines and 90 * n_lines"),
    Labeller("sentences", "80 * n_ends < n_words", "25 * n_ends >= n_words"),
)


def votes(labellers: tuple[Labeller, ...] = LABELLERS) -> Column:
    """All votes as digits to the base of three."""
    out = F.lit(0)
    for k, x in enumerate(labellers):
        out = out + F.when(F.expr(x.bad), BAD).when(F.expr(x.good), GOOD).otherwise(NONE) * 3**k
    return out.cast("int")


@dataclass(frozen=True)
class LabelModel:
    prior: float
    accuracy: dict[str, float]
    posterior: dict[int, float]


def expectation_maximisation(counts: dict[int, int], labellers: tuple[Labeller, ...] = LABELLERS, rounds: int = 200) -> LabelModel:
    """From the number of documents of each combination of votes. Labellers begin as better than chance, which tells good from bad."""
    import numpy as np

    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    vote = np.array([[c // 3**k % 3 for k in range(len(labellers))] for c in codes])
    table = np.ones((len(labellers), 2, 3))  # labeller, true class, vote; abstaining says nothing
    table[:, GOOD], table[:, BAD] = (0.15, 0.85, 1), (0.7, 0.3, 1)
    prior, post = 0.8, None
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + sum(np.log(table[k, GOOD, vote[:, k]] / table[k, BAD, vote[:, k]]) for k in range(len(labellers)))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if post is not None and np.abs(new - post).max() < 1e-9:
            break
        post = new
        prior = min(max((n * post).sum() / n.sum(), 0.02), 0.98)
        for y, w in ((GOOD, n * post), (BAD, n * (1 - post))):
            for k in range(len(labellers)):
                hits = np.bincount(vote[:, k], w, 3)[:2] + 1.0
                table[k, y, :2] = hits / hits.sum()
    right = {x.name: float(prior * table[k, GOOD, GOOD] + (1 - prior) * table[k, BAD, BAD]) for k, x in enumerate(labellers)}
    return LabelModel(float(prior), right, dict(zip(codes, post.tolist())))


SHAPES = (re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+"))


class _Places(dict):
    """Of a word: the places of the word and of its shape; kept while there are few."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > 300_000:
            self.clear()
        shape = SHAPES[1].sub(b"0", SHAPES[0].sub(b"a", word))
        out = self[word] = (zlib.crc32(word) % BUCKETS, zlib.crc32(b"\0" + shape) % BUCKETS)
        return out


def features(text: bytes, places: _Places):
    """Places and weights of a text's hashed features: words, their shapes, and how long and varied the text is. Their squares sum to two or less."""
    import numpy as np

    words = text.lower().split()
    got = np.array([places[w] for w in words], np.int64).reshape(-1, 2)
    at, count = np.unique(got, return_counts=True)
    weight = np.log1p(count)
    if len(at):
        weight = weight / np.sqrt((weight**2).sum())
    n = len(words)
    varied = 10 * len(set(words)) // n if n else 0
    rows = text.split(b"\n")
    lines = 10 * len(set(rows)) // len(rows)
    more = np.array([zlib.crc32(b"\1%s%d" % x) % BUCKETS for x in ((b"n", n.bit_length()), (b"v", varied), (b"l", lines))])
    return np.concatenate([at, more]), np.concatenate([weight, np.full(3, 0.5)])


def _vectors(batches: Iterator) -> Iterator:
    import pyarrow as pa

    places = _Places()
    for batch in batches:
        found = [features(t, places) for t in text_bytes(batch.column(0))]
        packed = [[a.astype("<i4").tobytes() for a, _ in found], [w.astype("<f4").tobytes() for _, w in found]]
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.binary()) for x in packed), pa.array([len(a) for a, _ in found], pa.int64()), batch.column(1), batch.column(2)], names=["at", "weight", "n", "posterior", "o"])


def train(rows: list, epochs: int = 8, rate: float = 0.5, decay: float = 1e-6):
    """Logistic regression on (packed places, packed weights, posterior), a row at a time with AdaGrad; returns weights, the intercept last."""
    import numpy as np

    w, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-2)
    data = [(np.append(np.frombuffer(a, "<i4"), BUCKETS), np.append(np.frombuffer(x, "<f4").astype(float), 0.5), y) for a, x, y in rows]
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            at, x, y = data[k]
            g = (1 / (1 + np.exp(-np.clip(w[at] @ x, -50, 50))) - y) * x + decay * w[at]
            np.add.at(seen, at, g * g)
            np.add.at(w, at, -rate * g / np.sqrt(seen[at]))
    return w


def _scores(weights: bytes, batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    w, places = np.frombuffer(weights, np.float32), _Places()
    for batch in batches:
        out = []
        for t in text_bytes(batch.column(1)):
            at, x = features(t, places)
            out.append(1 / (1 + np.exp(-np.clip(w[at] @ x + 0.5 * w[BUCKETS], -50, 50))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])


def voted(docs: DataFrame) -> DataFrame:
    """``doc_id, text, votes``."""
    ends = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("n_ends", F.coalesce(F.regexp_count("text", F.lit("[.!?]")), F.lit(0)))
    return measure(ends, keep_text=True).withColumn("votes", votes()).select("doc_id", "text", "votes")


def fit_labels(docs: DataFrame) -> LabelModel | None:
    """The label model of all documents; None for an empty table."""
    counts = {r.votes: r.n for r in voted(docs).groupBy("votes").agg(F.count("*").alias("n")).collect()}  # 3 to the number of labellers at most
    return expectation_maximisation(counts) if counts else None


def fit(docs: DataFrame, sample: int = SAMPLE):
    """The label model and the scorer's weights (None for an empty table)."""
    model, n = fit_labels(docs), docs.count()
    if model is None:
        return None, None
    order = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 40))
    near = docs.where(order < F.lit(int(min(1.0, 2 * sample / n) * (1 << 40)))) if n > sample else docs
    posterior = F.create_map(*(F.lit(x) for pair in model.posterior.items() for x in pair))[F.col("votes")]
    chosen = voted(near).select("text", posterior.alias("posterior"), order.alias("o")).orderBy("o").limit(sample)  # the bounded sample
    vectors = chosen.mapInArrow(_vectors, "at binary, weight binary, n long, posterior double, o long")
    before = F.sum("n").over(Window.orderBy("o", "posterior", "at").rowsBetween(Window.unboundedPreceding, 0))  # over the sample
    rows = vectors.withColumn("all", before).where(F.col("all") <= FEATURES).collect()
    rows.sort(key=lambda r: (r.o, r.posterior, r["at"]))
    return model, train([(r["at"], r.weight, r.posterior) for r in rows])


def score(docs: DataFrame, weights) -> DataFrame:
    """``doc_id, score`` (that a document is good, 0 to 1)."""
    import numpy as np

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = (np.zeros(BUCKETS + 1) if weights is None else weights).astype(np.float32).tobytes()
    return narrow.mapInArrow(lambda b: _scores(raw, b), "doc_id long, score double")


def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """``doc_id, score, kept`` of each document."""
    _, weights = fit(docs, sample)
    return score(docs, weights).withColumn("kept", F.col("score") >= threshold)
