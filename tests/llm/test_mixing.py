import random
from collections import Counter

import numpy as np
import pytest

from gristmill.llm import mixing


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_places_are_a_permutation(n):
    for salt in (0, 5):
        got = [mixing.permuted(i, n, salt) for i in range(n)]
        assert sorted(got) == list(range(n))
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        assert mixing._network(half, n, mixing._keys(salt))(np.arange(n)).tolist() == got


def test_targets():
    assert mixing.targets([]) == []
    assert mixing.targets([0, 0]) == [0, 0]
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([0, rng.randint(1, 9), rng.randint(1, 10**6)]) for _ in range(rng.randint(1, 9))]
        got = mixing.targets(sizes)
        assert all(t <= 2 * n + 1e-6 for t, n in zip(got, sizes))
        assert sum(got) == pytest.approx(1.5 * sum(sizes))
        free = {round(t / mixing.WEIGHTS[k % 3], 6) for k, (t, n) in enumerate(zip(got, sizes)) if t < 2 * n * (1 - 1e-12)}
        assert len(free) <= 1 or max(free) - min(free) < 1e-6 * max(free)


def test_tree_keeps_the_quotas():
    for quotas in ([0], [5, 0, 7], [1000, 3, 10**10], [17] * 9):
        drawn = mixing.split(quotas, 7).tolist()
        assert [sum(x) for x in zip(*drawn)] == quotas
        assert max(map(sum, drawn)) - min(map(sum, drawn)) <= 7
        assert drawn == mixing.split(quotas, 7).tolist()


def test_draws_beyond_numpy(monkeypatch):
    """Large pools are drawn by inversion; at small sizes, where both are known, it follows the exact probabilities."""
    from math import comb

    rng = np.random.default_rng(3)
    for good in (0, 1, 10**9, 3 * 10**11):
        for bad in (0, 5, 10**9, 10**12):
            for part in (0, 1, 2, 3):
                sample = (good + bad) * part // 3
                x = mixing._hypergeometric(rng, good, bad, sample)
                assert max(0, sample - bad) <= x <= min(good, sample)
    draws = [mixing._hypergeometric(rng, 4 * 10**9, 6 * 10**9, 10**6) for _ in range(400)]
    assert abs(np.mean(draws) - 400_000) < 5 * 490 / 20 and 400 < np.std(draws) < 580
    monkeypatch.setattr(mixing, "NUMPY", 0)
    n, good, bad, sample = 40_000, 7, 12, 8
    seen = Counter(mixing._hypergeometric(rng, good, bad, sample) for _ in range(n))
    for x in range(8):
        p = comb(good, x) * comb(bad, sample - x) / comb(good + bad, sample)
        assert abs(seen[x] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-9
    drawn = mixing.split([30, 0, 12, 100], 5).tolist()
    assert [sum(x) for x in zip(*drawn)] == [30, 0, 12, 100] and max(map(sum, drawn)) - min(map(sum, drawn)) <= 2


def test_query(spark, sf):
    from gristmill.llm.queries import op4_mixing

    rows = op4_mixing(spark, sf).collect()
    texts = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == len((texts[r.doc_id].text or "").encode().split())
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[texts[r.doc_id].source] += r["size"]
        taken[texts[r.doc_id].source] += r.taken
    names = sorted(sizes)
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names])))
    for r in rows:
        s = texts[r.doc_id].source
        assert (r.source_size, r.target) == (sizes[s], pytest.approx(goal[s]))
    assert all(taken[s] == round(goal[s]) for s in names)
    assert sorted(map(tuple, op4_mixing(spark, sf).collect())) == sorted(map(tuple, rows))


def slow_taken(rows, stream, block, shards):
    """Of (doc_id, text, source): the words that a slow walk over sources, blocks, passes and shards draws of each row."""
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    size = lambda r: len((r[1] or "").encode().split())
    goals = mixing.targets([sum(size(r) for r in rows if r[2] == s) for s in names])
    total = sum(goals)
    shards = shards or max(1, -(-round(total) // mixing.SHARD))
    quotas = [mixing.quota(sum(size(r) for r in rows if r[2] == s), t, block, k) for k, (s, t) in enumerate(zip(names, goals))]
    tree = mixing.split([q.passes * q.total + q.blocks for q in quotas], shards)
    taken = Counter()
    for k, (s, q) in enumerate(zip(names, quotas)):
        owner = [r for r in stream(s) for _ in range(size(r))]
        blocks = [owner[b * block : (b + 1) * block] for b in range(q.total)]
        placed = sorted(range(q.total), key=lambda b: mixing.permuted(b, q.total, k))
        turns = [(b, len(blocks[b])) for _ in range(q.passes) for b in placed]
        turns += [(b, len(blocks[b]) if j < q.blocks - 1 else q.words) for j, b in enumerate(placed[: q.blocks])]
        at = 0
        for shard in range(shards):
            for b, n in turns[at : at + int(tree[shard][k])]:
                for r in blocks[b][:n]:
                    taken[r[0]] += 1
            at += int(tree[shard][k])
        assert at == len(turns)
    return taken


def ordered(docs):
    """The rows of a source in the order of its stream, by the engine's hash alone."""
    F = mixing.F
    deals = {s: -(-n // mixing.DEAL) for s, n in Counter(r.source for r in docs.collect()).items()}
    one = docs.select("doc_id", "text", "source", F.xxhash64(F.lit(mixing.SEED), F.col("doc_id"), mixing.word_count(F.col("text")), F.xxhash64("text")).alias("o")).collect()
    return lambda s: [(r.doc_id, r.text, r.source) for r in sorted((r for r in one if r.source == s), key=lambda r: (r.o % deals[s], r.o))]


def test_taken_against_a_slow_tree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()]
    for block, shards in ((512, None), (100, 6)):
        got = {r.doc_id: r.taken for r in mixing.amounts(docs, block=block, shards=shards).collect()}
        want = slow_taken(rows, ordered(docs), block, shards)
        assert got == {r[0]: want[r[0]] for r in rows}


def test_mix_holds_what_the_amounts_say(spark):
    rng = random.Random(4)
    rows = [(k, "\n".join(f"w{k}_{j}" for j in range(rng.choice([0, 1, 30, 700]))), rng.choice(["a", "b", None, ""]), k % 3) for k in range(60)] + [(60, None, "a", 1), (61, "x y", "only", 2), (61, "x y", "only", 2)]
    rows += [(None, "n1 n2 n3", "a", 0), (None, "n4", None, 0), (70, " ".join(f"w70_{j}" for j in range(100_000)), "long", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int").repartition(3)
    docs = docs.withColumns({c: mixing.F.lit(7) for c in ("position", "START", "d", "h", "n", "size", "sid", "at", "row", "place", "take", "target", "all")})
    amounts = mixing.amounts(docs, block=64)
    want = Counter()
    for r in amounts.collect():
        want[r.doc_id] += r.taken
    mix = mixing.draws(docs, shards=4, block=64)
    assert mix.columns == [*docs.columns, "shard_", "position_", "start_"]
    got, by = Counter(), Counter()
    for r in mix.collect():
        words = r.text.split()
        got[r.doc_id if r.doc_id is not None else None] += len(words)
        by[r.shard_] += len(words)
        assert r.position == r.START == 7
        if r.doc_id is not None and r.doc_id != 61:
            assert r.shard == (r.doc_id % 3 if r.doc_id < 60 else 0) and words == [f"w{r.doc_id}_{j}" for j in range(r.start_, r.start_ + len(words))]
    assert {k: n for k, n in want.items() if n} == dict(got)
    assert len(by) == 4
    assert mixing.amounts(docs.where("false")).collect() == [] and mixing.draws(docs.where("false")).collect() == []
    assert mixing.draws(docs.select("doc_id", "text", "source")).columns == ["doc_id", "text", "source", "shard", "position", "start"]
