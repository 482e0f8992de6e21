import hashlib
import random

import numpy as np

from gristmill.llm import substring


def slow(rows, window):
    """Of (doc_id, text) rows: words, words removed, hash of the kept ones; ids None last."""
    key = lambda i: (i is None, i or 0)
    least, words = {}, [(t or "").encode().split() for _, t in rows]
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            least[s] = min(least.get(s, key(i)), key(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < key(i):
                gone.update(range(k, k + window))
        out.append((str(i), len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out)


def fixture():
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3)
    passage = [[word() for _ in range(n)] for n in (8, 9, 10, 12, 20, 31)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 6)):
            text += [word() for _ in range(rng.randint(0, 15))] + rng.choice(passage)
        rows.append((i * 3, " ".join(text)))
    rows += [(5, rows[7][1]), (6, rows[7][1]), (6, rows[7][1]), (6, rows[9][1]), (None, rows[9][1]), (None, None), (7, ""), (8, "z " * 100), (9, "z " * 70)]
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for window, block in ((10, 5), (10, 3), (13, 7)):
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(docs, window, block).collect())
        assert got == slow(rows, window)


def test_what_a_task_settles_alone(spark):
    """Small groups in one and in several tasks, so that entries meet in a group, in a task and across tasks."""
    rows = fixture()
    rng = random.Random(3)
    hot = " ".join(f"h{k}" for k in range(30))
    rows += [(rng.randint(400, 500), f"{' '.join(f'u{rng.random()}' for _ in range(rng.randint(0, 9)))} {hot}{' ' + hot if k % 3 else ''}") for k in range(150)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 3):
        for group in (40, 300, 100_000):
            got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(docs.repartition(parts), 10, 5, group=group, bucket_bytes=300).collect())
            assert got == slow(rows, 10)


def test_a_passage_of_many_documents_travels_seldom():
    import pyarrow as pa

    hot = " ".join(f"h{k}" for k in range(60))
    ids = random.Random(1).sample(range(10**6), 3000)
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(range(3000), pa.int32()), pa.array([f"{'x ' * (i % 50)}{hot}" for i in ids])], names=["d", "tag", "text"])
    travelled = settled = 0
    for b in substring._probes(64, 20_000, 50, 25, [batch]):
        for row in b.to_pylist():
            n = len(substring._ungaps(row["gaps"]))
            travelled, settled = travelled + (row["kind"] < 2) * n, settled + (row["kind"] == 2) * n
    assert travelled < 0.1 * settled


def test_rows_of_a_group_follow_its_entries():
    """Not the number of buckets."""
    import time

    seconds = []
    for buckets in (12, 60_000):
        packer = substring._Packer(buckets, 60_000, False)
        packer.add(1, 0, 0, np.arange(400), np.random.default_rng(1).integers(0, 1 << 63, 400).astype(np.uint64), block=np.arange(400) % 25 == 0)
        began = time.perf_counter()
        assert 12 <= len(list(packer.rows())) <= 416
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 0.2


def test_long_text_over_groups(spark):
    rng = random.Random(2)
    shared = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(70))
    fill = lambda n: " ".join(f"v{rng.randint(0, 10**7)}" for _ in range(n))
    rows = [(1, f"{fill(59_990)} {shared} {fill(70_000)} {shared} {fill(5)}"), (2, f"{fill(3)} {shared} {fill(4)}"), (3, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(docs).collect())
    assert got == slow(rows, 50)


def test_kept_texts(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"x\n{passage}", 1, "a"), (2, f"y  y {passage} end", None, "b"), (3, passage, 3, "c"), (4, None, 4, "d"), (5, "one\n two", 5, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, starts int, tag string")
    got = {r.doc_id: (r.text, r.starts, r.tag) for r in substring.remove_repeats(docs).collect()}
    assert got == {1: (rows[0][1], 1, "a"), 2: ("y y end", None, "b"), 4: (None, 4, "d"), 5: ("one\n two", 5, "e")}
    assert substring.remove_repeats(docs).columns == docs.columns
    assert substring.digests(docs.where("false")).count() == 0


def test_packing_of_positions():
    rng = np.random.default_rng(1)
    for _ in range(50):
        pos = np.unique(rng.integers(0, 70_000, rng.integers(1, 400)))
        assert (substring._ungaps(substring._gaps(pos)) == pos).all()


def test_the_texts_are_shuffled_once(spark, sf):
    found = substring.digests(spark.read.parquet(f"{sf}/documents.parquet"))
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
