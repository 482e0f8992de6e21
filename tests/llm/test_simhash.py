import numpy as np
import pytest
from xxhash import xxh64_intdigest

from gristmill.llm import simhash


def slow_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(fps, bits=3):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "one TWO", "a b c", "É Éa A b c d e f", "x " * 40000])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


def test_fingerprint_is_spark_xxhash64(spark):
    got = spark.sql("select xxhash64('a b c') h").first().h
    assert got & (1 << 64) - 1 == simhash.fingerprint(b"A b C")


def test_query_against_brute_force(spark, sf):
    from gristmill.llm.queries import op7_simhash

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    want = brute(fps)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in op7_simhash(spark, sf).collect()}
    assert got == {i: (fps[i], want[i]) for i in texts}


@pytest.mark.parametrize("cell", [4, 4096])
def test_links_against_brute_force(spark, cell):
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    fps = set(base)
    for f in base:
        for _ in range(40):  # chains and stars around each
            for _ in range(int(rng.integers(1, 4))):
                f ^= 1 << int(rng.integers(0, 64))
            fps.add(f)
    fps = sorted(fps)
    want = brute(dict(enumerate(fps)))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), cell=cell)
    from gristmill.llm.graph import components

    label = {r.node & (1 << 64) - 1: r.label & (1 << 64) - 1 for r in components(edges).collect()}
    groups = lambda of: sorted(sorted(k for k in of if of[k] == v) for v in set(of.values()))
    assert groups({f: label.get(f, f) for f in fps}) == groups({fps[i]: fps[j] for i, j in want.items()})


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (5, "a b c d", "z"), (5, "a b c d", "z"), (None, "a b c d", "n"), (7, "Q " * 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 5), (1, 1), (2, 1), (5, 5), (5, 5), (7, 7)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 5, 7]
    assert simhash.near_duplicates(docs.where("false")).collect() == []
