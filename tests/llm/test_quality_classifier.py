import numpy as np

from gristmill.llm import quality_classifier as c


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(3)
    right, labellers = [0.9, 0.8, 0.7, 0.95, 0.6], c.LABELLERS[:5]
    y = rng.random(40_000) < 0.7
    counts, truth = {}, {}
    for good in y:
        code = 0
        for k, p in enumerate(right):
            vote = c.NONE if rng.random() < 0.3 else int(good) if rng.random() < p else 1 - int(good)
            code += vote * 3**k
        counts[code] = counts.get(code, 0) + 1
        truth[code] = truth.get(code, 0) + good
    model = c.expectation_maximisation(counts, labellers)
    assert abs(model.prior - 0.7) < 0.03
    assert all(abs(model.accuracy[x.name] - p) < 0.04 for x, p in zip(labellers, right))
    assert np.mean([abs(model.posterior[k] - truth[k] / counts[k]) for k in counts if counts[k] > 400]) < 0.05


def test_query_agrees_with_held_out_labels(spark):
    from gristmill.llm.queries import op2_quality_classifier

    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in op2_quality_classifier(spark, sf).collect()}
    assert len(kept) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [kept[r.doc_id] for r in labels if r.quality]
    bad = [kept[r.doc_id] for r in labels if not r.quality]
    assert np.mean(good) > 0.93 and np.mean(bad) < 0.6


def test_edge_cases(spark):
    good = " ".join(f"Word{k} stands here." for k in range(30))
    rows = [(k, f"{good}\n{good[::-1]}\nline {k}.", 1.0) for k in range(20)] + [(k, "x### " * 40, 1.0) for k in range(20, 40)] + [(50, None, 0.0), (51, "", 0.0), (None, "one", 0.0), (3, "again " * 5, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = c.classify(docs)
    assert got.columns == ["doc_id", "score", "kept"] and got.count() == len(rows)
    by = {r.doc_id: r.score for r in got.collect()}
    assert min(by[k] for k in range(4, 20)) > 0.5 > max(by[k] for k in range(20, 40))
    assert c.classify(docs.where("false")).collect() == []


def slow_scores(texts, order):
    """The whole classifier a document at a time: votes, EM over documents, dictionaries of weights, scores."""
    import math
    import zlib

    from gristmill.llm.quality_rules import measure_text

    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    said, ids = {}, sorted(texts)
    for i in ids:
        n, chars, symbols, lines, dup, rep = measure_text((texts[i] or "").encode())
        m = dict(zip(names, (n, chars, symbols, lines, dup, rep))) | {"n_ends": sum((texts[i] or "").count(x) for x in ".!?")}
        def holds(rule):
            text = rule.replace(" = ", " == ")
            while " between " in text:
                left, rest = text.split(" between ", 1)
                low, high = rest.split(" and ", 1)
                name = left.split()[-1]
                text = left[: -len(name)] + f"{low} <= {name} <= {high}"
            return eval(text, {}, m)  # noqa: S307 - the rules of this repository

        said[i] = [c.BAD if holds(x.bad) else c.GOOD if holds(x.good) else c.NONE for x in c.LABELLERS]
    table = [[[0.7, 0.3, 1.0], [0.15, 0.85, 1.0]] for _ in c.LABELLERS]
    prior, post = 0.8, None
    for _ in range(200):
        new = {}
        for i in ids:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[k][c.GOOD][v] / table[k][c.BAD][v]) for k, v in enumerate(said[i]))
            new[i] = 1 / (1 + math.exp(-min(max(odds, -50), 50)))
        if post and max(abs(new[i] - post[i]) for i in ids) < 1e-9:
            break
        post = new
        prior = min(max(sum(post.values()) / len(ids), 0.02), 0.98)
        for k in range(len(c.LABELLERS)):
            for y in (c.GOOD, c.BAD):
                hits = [1.0 + sum((post[i] if y == c.GOOD else 1 - post[i]) for i in ids if said[i][k] == v) for v in (0, 1)]
                table[k][y][:2] = [h / sum(hits) for h in hits]

    def vector(text):
        words = (text or "").encode().lower().split()
        count = {}
        for w in words:
            shape = c.SHAPES[1].sub(b"0", c.SHAPES[0].sub(b"a", w))
            for at in (zlib.crc32(w) % c.BUCKETS, zlib.crc32(b"\0" + shape) % c.BUCKETS):
                count[at] = count.get(at, 0) + 1
        norm = math.sqrt(sum(math.log1p(n) ** 2 for n in count.values())) or 1.0
        out = [(at, math.log1p(n) / norm) for at, n in sorted(count.items())]
        lines = (text or "").encode().split(b"\n")
        more = (b"n%d" % len(words).bit_length(), b"v%d" % (10 * len(set(words)) // len(words) if words else 0), b"l%d" % (10 * len(set(lines)) // len(lines)))
        return out + [(zlib.crc32(b"\1" + x) % c.BUCKETS, 0.5) for x in more]

    rows = [(*[(a, float(np.float32(x))) for a, x in vector(texts[i])], (c.BUCKETS, 0.5)) for i in order]
    w, seen, rng = {}, {}, np.random.default_rng(1)
    for _ in range(8):
        for k in rng.permutation(len(rows)):
            z = sum(w.get(a, 0.0) * x for a, x in rows[k])
            error = 1 / (1 + math.exp(-min(max(z, -50), 50))) - post[order[k]]
            steps = [(a, error * x + 1e-6 * w.get(a, 0.0)) for a, x in rows[k]]
            for a, g in steps:
                seen[a] = seen.get(a, 1e-2) + g * g
            for a, g in steps:
                w[a] = w.get(a, 0.0) - 0.5 * g / math.sqrt(seen[a])
    return {i: 1 / (1 + math.exp(-sum(w.get(a, 0.0) * x for a, x in [*vector(texts[i]), (c.BUCKETS, 0.5)]))) for i in ids}


def test_query_against_a_slow_classifier(spark, sf):
    from gristmill.llm.queries import op2_quality_classifier

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    keyed = docs.select("doc_id", c.F.pmod(c.F.xxhash64(c.F.lit(11), "doc_id"), c.F.lit(1 << 40)).alias("o")).collect()
    want = slow_scores(texts, [r.doc_id for r in sorted(keyed, key=lambda r: r.o)])
    got = {r.doc_id: (r.score, r.kept) for r in op2_quality_classifier(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i][0] - want[i]) for i in want) < 1e-4
    assert all(got[i][1] == (want[i] >= 0.5) for i in want if abs(want[i] - 0.5) > 1e-4)


def test_very_long_texts_and_clashing_columns(spark):
    rows = [(k, " ".join(f"w{j}." for j in range(60_000 if k == 0 else 40)), 1, "v", 2.0, 3) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, votes int, n_ends string, score double, n_words int")
    assert c.classify(docs).count() == 30
