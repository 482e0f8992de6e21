"""Quality rules as a bitmask ledger.

``measure`` reads each text once. ``ledger`` evaluates every rule once and stores the failure bits beside the
measurements. Policies are versioned masks over those bits, so another policy, or an ablation, is bit arithmetic on the
ledger and never looks at a text again.

Null text counts as empty: no words, so it fails ``few_words``. An empty table gives an empty ledger. Repeated rows are
judged one by one, equally. Columns of the input other than the text are carried along; where one bears the name of a
measurement, the measurement replaces it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import SPACES, text_bytes

SYMBOLS = "#*$%&|<>"
GRAM = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rule fails a document where ``failed`` holds; ``bit`` is its place in the ledger and never changes."""

    bit: int
    name: str
    failed: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "10 * n_dup_lines > 4 * n_lines"),
    Rule(4, "long_words", "word_chars > 10 * n_words"),
    Rule(5, "short_words", "10 * word_chars < 25 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the policy: documents that fail any of its rules go."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        known = {r.name: r.mask for r in rules}
        return sum(known[name] for name in self.rules)


#: The base rules, and the policy in use.
BASE = Policy("base", ("few_words", "repeated_words"))
CURRENT = Policy("2", tuple(r.name for r in RULES))


def repeated_words(words: list[bytes], gram: int = GRAM) -> int:
    """Words inside windows of ``gram`` words that the text has twice or more."""
    if len(words) < gram:
        return 0
    if len(words) > 1 << 16:
        return _repeated_long(words, gram)
    windows = list(zip(*(words[k:] for k in range(gram))))
    if len(set(windows)) == len(windows):
        return 0
    count, total, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + gram - max(i, end)
            end = i + gram
    return total


def _repeated_long(words: list[bytes], gram: int) -> int:
    """The same for very long texts, in a few arrays: windows get ranks by pairing the rank of a shorter window and the next word."""
    import numpy as np

    ids: dict[bytes, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    rank = word
    for k in range(1, gram):
        _, rank = np.unique(rank[:-1] * len(ids) + word[k:], return_inverse=True)
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:-gram] += again
    edge[gram:] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure_text(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words, s = text.split(), text.decode("utf-8", "replace")
    lines = [x for x in s.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(s) - sum(map(s.count, SPACES)),
        sum(map(s.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _measure(at: int, batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows = [measure_text(t) for t in text_bytes(batch.column(at))]
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(MEASURES))]
        kept = [k for k in range(batch.num_columns) if k != at or batch.schema.names[k] != "__text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *columns], names=[*(batch.schema.names[k] for k in kept), *MEASURES])


def measure(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (the text only on demand) and the measurements."""
    carried = [c for c in docs.columns if c not in MEASURES and (keep_text or c != text)]
    narrow = docs.select(*(F.col(f"`{c}`") for c in carried), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*narrow.drop("__text").schema.fields, *(T.StructField(m, T.LongType(), False) for m in MEASURES)])
    at = len(carried)
    return narrow.mapInArrow(lambda batches: _measure(at, batches), schema)


def bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """The failure bits, from the measurements."""
    each = [F.when(F.expr(r.failed), F.lit(r.mask)).otherwise(F.lit(0)).cast("long") for r in rules]
    out = each[0]
    for x in each[1:]:
        out = out.bitwiseOR(x)
    return out


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep_text: bool = False) -> DataFrame:
    """Measurements and ``failed_bits`` of every document."""
    return measure(docs.drop("failed_bits"), text, keep_text).withColumn("failed_bits", bits(rules))


def passes(policy: Policy = CURRENT, rules: tuple[Rule, ...] = RULES, failed: str = "failed_bits") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask(rules))) == 0


def ablation(entries: DataFrame, policy: Policy = CURRENT, rules: tuple[Rule, ...] = RULES, failed: str = "failed_bits") -> DataFrame:
    """What each rule of a policy does: documents that it fails, fails alone, and that the policy would keep without it.

    The ledger is first counted by bit pattern, at most 2 to the number of rules, so the rest is over a few rows.
    """
    mask = policy.mask(rules)
    used = [r for r in rules if r.mask & mask]
    patterns = entries.groupBy(F.col(failed).bitwiseAND(F.lit(mask)).alias("b")).agg(F.count("*").alias("n"))
    rows = patterns.select("n", "b", F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.mask).cast("long").alias("bit")) for r in used))).alias("r"))
    n = F.col("n")
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("b").bitwiseAND(F.col("r.bit")) != 0, n).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("b") == F.col("r.bit"), n).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("b").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, n).otherwise(0)).alias("n_kept_without"),
    )


def keep(docs: DataFrame, text: str = "text", policy: Policy = CURRENT) -> DataFrame:
    """The documents that a policy keeps, with their own columns."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias("body"))
    return ledger(whole, "body").where(passes(policy)).select("row.*")
