from collections import Counter

import corpus_pipeline as cp
from gristmill.llm import mixing, quality_rules

from tests.llm.test_similar import true_groups


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "mixing", "packing"]

    def written(k, frame):
        frame.write.parquet(f"{tmp_path}/{k}")
        return spark.read.parquet(f"{tmp_path}/{k}")

    one = written(1, cp.STAGES[0][1](spark, docs, sf))
    assert one.columns == columns
    want = set()
    for i, r in texts.items():
        n, chars, symbols, lines, dup, rep = quality_rules.measure_text((r.text or "").encode())
        if n >= 10 and 100 * rep <= 20 * n and 10 * symbols <= n and 10 * dup <= 4 * lines and 2.5 * n <= chars <= 10 * n:
            want.add(i)
    assert sorted(r.doc_id for r in one.collect()) == sorted(want)
    assert all(r == texts[r.doc_id] for r in one.collect())

    two = written(2, cp.STAGES[1][1](spark, one, sf))
    label = true_groups({i: texts[i].text for i in want}, 0.8)
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(set(label.values()))

    three = written(3, cp.STAGES[2][1](spark, two, sf))
    rows = {r.doc_id: r for r in three.collect()}
    least = {}
    words = {i: texts[i].text.encode().split() for i in set(label.values())}
    for i, w in words.items():
        for k in range(len(w) - 49):
            s = tuple(w[k : k + 50])
            least[s] = min(least.get(s, i), i)
    for i, w in words.items():
        gone = {p for k in range(len(w) - 49) if least[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        if len(gone) == len(w):
            assert i not in rows
        else:
            assert rows[i].text == (kept if gone else texts[i].text) and rows[i].n_chars == len(rows[i].text)

    four = written(4, cp.STAGES[3][1](spark, three, sf))
    assert four.columns == columns
    sizes, taken, each = Counter(), Counter(), Counter()
    for r in rows.values():
        sizes[r.source] += len(r.text.encode().split())
    for r in four.collect():
        n = len(r.text.encode().split())
        taken[r.source] += n
        each[r.doc_id] += n
        assert " ".join(r.text.split()) in " ".join(rows[r.doc_id].text.split()) and r.n_chars == len(r.text)
    names = sorted(sizes)
    assert [taken[s] for s in names] == [round(t) for t in mixing.targets([sizes[s] for s in names])]
    assert all(n <= 2 * len(rows[i].text.encode().split()) for i, n in each.items())

    five = cp.STAGES[4][1](spark, four, sf)
    got = Counter((r.doc_id, r.doc_tokens) for r in five.where("start = 0").collect())
    assert sum(got.values()) == four.count()
    assert five.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert five.count() == cp.run(spark, sf).count()


def test_stages_with_clashing_columns_nulls_and_repeats(spark, tmp_path):
    good = lambda k: " ".join(f"word{k}x{j}" for j in range(80)) + ".\nAnd another line here.\nAnd a third one."
    passage = " ".join(f"shared{j}" for j in range(60))
    rows = [(k, good(k) + (" " + passage if k % 3 == 0 else ""), "abc"[k % 3]) for k in range(12)]
    rows += [(None, good(50), "a"), (None, good(51), None), (20, None, "a"), (21, "", "b"), (22, good(3) + " " + passage, None), (1, rows[1][1], "b"), (30, " ".join(f"long{j}" for j in range(60_000)) + ".\nx y\nz w", "c")]
    extra = {c: cp.F.lit(7) for c in ("shard", "position", "START", "d", "tag", "h", "n", "row", "cell", "size", "starts", "label", "sub", "votes", "failed_bits", "at", "take", "length", "tie")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(extra).withColumn("n_chars", cp.F.length("text").cast("long"))
    now = docs
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, now, "")
        if name != "packing":
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "quality_rules":
            assert now.where("text is null or text = ''").count() == 0 and now.where("doc_id is null").count() == 2
        if name == "simhash_near_dedup":
            assert now.where("doc_id is null").count() == 2 and now.where("doc_id = 1").count() == 1
        if name == "substring_dedup":
            assert now.where(f"contains(text, '{passage}')").count() == 1
        if name != "packing":
            assert now.select("shard", "START").distinct().collect() == [(7, 7)]
    assert now.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    for name, stage in cp.STAGES:
        assert stage(spark, docs.where("false"), "").count() == 0, name
