import pytest

from gristmill.llm import quality_rules as q


@pytest.mark.parametrize(
    "text, want",
    [
        (b"", (0, 0, 0, 0, 0, 0)),
        (b" \n\t\x0b\x0c\r", (0, 0, 0, 0, 0, 0)),
        ("é#\nx\n \nx\nx ".encode(), (4, 5, 1, 4, 1, 0)),
        (b"a b c d e a b c d e", (10, 10, 0, 1, 0, 10)),
        (b"a a a a a a", (6, 6, 0, 1, 0, 6)),
        (b"a b c d e f", (6, 6, 0, 1, 0, 0)),
    ],
)
def test_measures(text, want):
    assert q.measure_text(text) == want


def test_long_texts_are_counted_alike():
    import random

    rng = random.Random(3)
    for size in (3, 5, 40, 400):
        words = [rng.choice([b"a", b"b", b"c", b"dd"]) for _ in range(size)]
        if size >= 5:
            assert q._repeated_long(words, 5) == q.repeated_words(words)


def test_policies_and_ablation(spark):
    good = " ".join(f"word{k}" for k in range(30))
    rows = [(1, good, "a"), (2, None, "b"), (3, "x " * 50, "c"), (4, good.replace(" ", " # "), "d"), (1, good, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    entries = q.ledger(docs)
    assert [c for c in entries.columns if c == "n_words"] == ["n_words"]
    got = sorted((r.doc_id, r.kept, r.base) for r in entries.select("doc_id", q.passes().alias("kept"), q.passes(q.BASE).alias("base")).collect())
    assert got == [(1, True, True), (1, True, True), (2, False, False), (3, False, False), (4, False, True)]
    by = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in q.ablation(entries).collect()}
    assert by["symbols"] == (1, 1, 3) and by["few_words"] == (1, 1, 3)
    kept = q.keep(docs)
    assert kept.columns == docs.columns and kept.count() == 2
    assert q.ledger(docs.where("false")).count() == 0
