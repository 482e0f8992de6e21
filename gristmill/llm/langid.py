"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled from texts of that language. A text, folded to lower-case
letters, is compressed with each
dictionary, in chunks so that the dictionary counts all along a long text, and the language whose dictionary gives the
fewest bytes is taken; where the runner-up is close, the answer is marked as rejected.

Dictionaries are fitted on a bounded sample: of each language ``sample`` texts at most, by a hash of the id, and
``dictionary`` bytes in all. Every sampled text gives an even share of them (what short texts leave goes to the others), from a place
within the text that a hash chooses, so beginnings count no more than other parts. Predictions read whole texts. The number of
languages is a dimension of the corpus.

Null text, or text without a letter (Unicode category L), is ``und`` with score 0; so is everything where nothing could be
learned. Of languages with equal sizes the first by name is taken. Repeated rows get equal answers. A very long text is
compressed in chunks by one task. An empty table gives an empty result. Only doc_id, text and lang are read, so other columns'
names don't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: A letter, or one of the few other characters that count as parts of words.
WORDLY = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")
SAMPLE = 400
DICTIONARY = 96_000
CHUNK = 2048
LEVEL = 6
MARGIN = 0.01


def lettered(text: str) -> bool:
    """Whether a text has a letter: a character of one of the categories Lu, Ll, Lt, Lm, Lo."""
    return any(m[0].isalpha() for m in WORDLY.finditer(text))


def folded(text: str) -> str:
    """Lower-cased letters, everything between them as one space: case, digits and symbols say nothing of the language."""
    return OTHER.sub(" ", text.lower())


@dataclass(frozen=True)
class Model:
    """Languages and the raw content of their dictionaries."""

    dictionaries: tuple[tuple[str, bytes], ...]
    chunk: int = CHUNK
    level: int = LEVEL
    margin: float = MARGIN

    def compressors(self) -> list:
        import zstandard as z

        out = []
        for _, raw in self.dictionaries:
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            out.append(z.ZstdCompressor(level=self.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out


def held_out(doc_id: Column) -> Column:
    """True for the documents that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(labelled: DataFrame, sample: int = SAMPLE, dictionary: int = DICTIONARY) -> Model:
    """Dictionaries from ``doc_id, text, lang``. Rows of null language or text teach nothing."""
    rows = labelled.where("lang is not null and text is not null and length(text) > 0")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return Model(())
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    near = F.coalesce(*(F.when(F.col("lang") == lang, order < F.lit(int(min(1.0, 4 * sample / n) * (1 << 40)))) for lang, n in sorted(counts.items())))
    w = Window.partitionBy("lang").orderBy("o", "doc_id", "text")
    some = rows.where(near).select("lang", "text", "doc_id", order.alias("o")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= sample)
    # more than an even share of each, as others may be shorter: what reaches the driver is bounded by sample and dictionary
    n = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(4 * -(-dictionary // min(sample, n)))) for lang, n in sorted(counts.items())))
    room = F.greatest(F.lit(1), F.length("text") - n + 1)
    start = F.pmod(F.xxhash64("text", "doc_id"), room) + 1
    taken = some.select("lang", "k", F.substring(F.col("text"), start.cast("int"), n).alias("text")).collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(taken, key=lambda r: (r.lang, r.k)):
        texts.setdefault(r.lang, []).append(folded(r.text).encode() + b"\n")
    return Model(tuple((lang, shared(raw, dictionary)) for lang, raw in sorted(texts.items())))


def shared(texts: list[bytes], size: int) -> bytes:
    """At most ``size`` bytes of texts, as even a share of each as their lengths allow."""
    left, share = size, 0
    for k, n in enumerate(sorted(map(len, texts))):
        share = left // (len(texts) - k)
        if n > share:
            break
        left, share = left - n, n
    return b"".join(t[: max(share, 1)] for t in texts)[:size]


def sizes(compressors: list, text: bytes, chunk: int) -> list[int]:
    """Compressed bytes of a text, by dictionary."""
    if len(text) <= chunk:
        return [len(c.compress(text)) for c in compressors]
    view = memoryview(text)
    cuts = [view[k : k + chunk] for k in range(0, len(text), chunk)]
    return [sum(len(c.compress(x)) for x in cuts) for c in compressors]


def _predict(model: Model, batches: Iterator) -> Iterator:
    import pyarrow as pa

    compressors, languages = model.compressors(), [lang for lang, _ in model.dictionaries]
    for batch in batches:
        out = []
        seen: dict[str, tuple] = {}
        for text in batch.column(1).to_pylist():
            if text is None or not languages or not lettered(text):
                out.append((UNKNOWN, 0.0, True))
                continue
            got = seen.get(text)
            if got is None:
                raw = folded(text).encode()
                n = sizes(compressors, raw, model.chunk)
                best = min(range(len(n)), key=n.__getitem__)
                odds = sum(2.0 ** -min(x - n[best], 1000) for x in n)
                others = [x for k, x in enumerate(n) if k != best]
                got = seen[text] = (languages[best], 1 / odds, bool(others) and min(others) - n[best] < model.margin * len(raw))
            out.append(got)
        lang, score, rejected = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, rejected``; the score is 1 over the sum of 2 to the minus each language's extra bytes."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(lambda b: _predict(model, b), "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, **more) -> DataFrame:
    """Learns from the rows that aren't held out and predicts all."""
    model = fit(docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2).select("doc_id", "text", "lang"), **more)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
