import base64
import hashlib
import random
import re

import pytest
import xxhash

from gristmill.llm import iblt


def units(text, piece=iblt.PIECE):
    if piece is None:
        return {x for x in text.split("\n") if x}
    out = set()
    for line in filter(None, text.split("\n")):
        held = []
        for w in line.split(" "):
            held.append(w)
            h = xxhash.xxh64_intdigest(w.encode(), 42)
            if (h - (h >> 63 << 64)) % piece == 0:
                out.add(tuple(held))
                held = []
        if held:
            out.add(tuple(held))
    return out


def alike(a, b, piece=iblt.PIECE):
    a, b = units(a, piece), units(b, piece)
    n = len(a) + len(b)
    return (n - len(a ^ b)) / n if n else 1.0


def slow(rows, piece=iblt.PIECE):
    """Of (doc_id, text): what the query gives without the fingerprints; ids unique."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(rows):
        z = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + z[:q]
        out.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), round(alike(t, e, piece), 9), round(alike(t, z, piece), 9)))
    return sorted(out)


def got(found):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found)


def test_query_against_brute_force(spark, sf):
    from gristmill.llm.queries import op10_fingerprints

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op10_fingerprints(spark, sf).collect()
    assert got(rows) == slow(list(texts.items()))
    by = {}
    for r in rows:
        by.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by.values()) and len(set().union(*by.values())) == len({frozenset(units(t)) for t in by})
    assert all(len(base64.b64decode(r.fingerprint)) == 14 * iblt.CELLS for r in rows)
    op10_fingerprints(spark, sf).write.format("noop").mode("overwrite").save()  # planned another way
    plan = op10_fingerprints(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_edge_cases(spark, ranges):
    rng = random.Random(8)
    line = lambda: "".join(rng.choice("abc é\U0001f600") for _ in range(rng.randint(0, 300)))
    rows = [(i * 7 - 50, "\n".join(line() for _ in range(rng.randint(0, 12)))) for i in range(40)]
    rows += [(1000, None), (1001, ""), (1002, "x"), (1003, "x"), (None, "last\none"), (1004, "\n".join(str(k) for k in range(3000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("next", iblt.F.lit(1)).repartition(5)
    assert got(iblt.fingerprints(docs, ranges).collect()) == slow(rows)
    assert got(iblt.fingerprints(docs, ranges, piece=None).collect()) == slow(rows, None)
    one = docs.where("doc_id = 1002")
    assert got(iblt.fingerprints(one, ranges).collect()) == slow([(1002, "x")])
    assert iblt.fingerprints(docs.where("false"), ranges).collect() == []
    twice = iblt.fingerprints(one.unionAll(one), ranges).collect()
    assert [r.near_next for r in twice] == [1.0, 1.0]


def test_peeling_recovers_small_differences_and_stops_at_large_ones(spark):
    rows = [(n, list(range(100)), [*range(100 - n), *range(1000, 1000 + n)]) for n in range(0, 60, 4)]
    df = spark.createDataFrame(rows, "n int, a array<long>, b array<long>").withColumns({k: iblt.F.expr(f"transform({k}, x -> xxhash64(x))") for k in "ab"})
    df = iblt._step(df, ["n", "a", "b"], {"ca": iblt.table("a"), "cb": iblt.table("b")})
    minus = "zip_with(ca, cb, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"
    found = {r.n: (r.p, r.l, r.d) for r in df.selectExpr("n", f"{iblt._peel(minus, '0')} as p", f"{iblt._larger('a', 'b', '3')} as l", f"{iblt.differing('a', 'b', 'ca', 'cb')} as d").collect()}
    assert all(p in (None, 2 * n) and l in (None, 2 * n) and d == 2 * n for n, (p, l, d) in found.items())
    assert found[0][0] == 0 and found[4][0] == 8 and found[56][0] is None and all(l is not None for _, l, _ in found.values())


def test_an_insertion_changes_only_the_pieces_around_it(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(4000)]
    a, b = " ".join(words), " ".join([*words[:1000], "new", *words[1000:]])
    x, y = (set(r) for r in spark.createDataFrame([(a, b)], "a string, b string").selectExpr(iblt.digests("a"), iblt.digests("b")).first())
    assert len(x) > 150 and len(x ^ y) <= 3


def test_hot_and_null_ids_are_cut_by_hash(spark):
    rows = [(None if k % 3 else 7, f"text {k}\nof {k % 5}") for k in range(300)] + [(k, f"t{k}") for k in range(20, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = iblt.with_next(docs, 16).select("doc_id", "text", "next", iblt.F.spark_partition_id().alias("p")).collect()
    plain = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) as h").collect()
    order = sorted(plain, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))
    want = {(r.doc_id, r.text): order[(k + 1) % len(order)].text for k, r in enumerate(order)}
    assert {(r.doc_id, r.text): r.next for r in found} == want and len(found) == len(rows)
    plan = iblt.with_next(docs, 16)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_long_texts_take_time_in_proportion(spark):
    import time

    rng = random.Random(3)
    rows = [(k, "\n".join(f"{rng.random()} {rng.random()}" for _ in range(8000))) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.perf_counter()
    assert got(iblt.fingerprints(docs, 1).collect()) == slow(rows)
    assert time.perf_counter() - began < 20
