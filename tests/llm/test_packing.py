import random
import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from gristmill.llm import packing  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


def slow(counts, size):
    """Best-fit decreasing, a rest at a time."""
    windows = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            room = [w for w in windows if w[0] >= length]
            if room:
                min(room)[0] -= length
            else:
                windows.append([size - length])
    return sorted(w[0] for w in windows)


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 16, 37, 64])
    counts = {rng.randint(1, size): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
    used, total = {}, Counter()
    for r in packing.plan(counts, size):
        for j in range(r.n):
            window, offset = r.window + j // r.each, r.offset + j % r.each * r.length
            assert used.get(window, 0) == offset
            used[window] = offset + r.length
        total[r.length] += r.n
    assert total == counts and sorted(used) == list(range(len(used)))
    assert sorted(size - x for x in used.values()) == slow(counts, size)


TEXTS = ["", " ", "a", " a b", "a  b", "a\n b c", "It's  <|endoftext|> x<|endoftext|>y z", "été là ② x y  z", "tab\tx y ", "日本語 テキスト 1234 12,5 don't", "\x1c a \x1f"]


def test_token_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab é1.,'s\n\t <|>") for _ in range(60)) for _ in range(300)]
    texts += [" " * 400_000 + "x", "\n \t" * 200_000, "a" * 300_000, "é日" * 50_000, "x" + " " * 300_000 + "<|endoftext|>"]
    encode = packing.ByteBpe(PATH)
    assert encode.merger
    for x, got in zip(texts, encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_every_code_point():
    encode = packing.ByteBpe(PATH)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 50_000):
        some = [a + "x1" + a + b for a, b in zip(points[k : k + 50_000], points[k + 7 :] + points[:7])]
        assert encode(some) == encode.whole(some)


def test_fast_way_needs_a_known_file(tmp_path):
    import json

    said = json.load(open(PATH, encoding="utf-8"))
    assert packing.ByteBpe._merger(PATH)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {**said["pre_tokenizer"], "use_regex": False}}, {"model": {**said["model"], "merges": said["model"]["merges"][::-1]}}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps({**said, **change}), encoding="utf-8")
        assert packing.ByteBpe._merger(str(path)) is None
        text = "a café's  1234 x\n y"
        slow = packing.ByteBpe(str(path))
        assert np.frombuffer(slow([text])[0], "<u4").tolist() == slow.tokenizer.encode(text, add_special_tokens=False).ids


def test_query(spark, sf):
    from gristmill.llm.queries import op8_packing

    check(op8_packing(spark, sf), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})


def check(found, texts, size=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = found.collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for i, text in texts.items():
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by[i], key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.start, zlib.crc32(part), r.doc_tokens) == (at, r.ids_crc32, len(ids))
            at += r.length
        assert at == len(ids)
    windows = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert windows.get(r.sequence_id, 0) == r.offset
        windows[r.sequence_id] = r.offset + r.length
    assert max(windows.values()) <= size
    tokens = sum(r.length for r in rows)
    assert len(windows) <= tokens / size * 1.15 + 2


def test_edge_cases(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "w " * 9000, 3), (4, "w " * 9000, 3)] + [(k, "same text", 0) for k in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    check(packing.pack(docs, PATH), {r[0]: r[1] for r in rows})
    assert packing.pack(docs.unionAll(docs), PATH).count() == 2 * packing.pack(docs, PATH).count()
    assert packing.pack(docs.where("false"), PATH).count() == 0
    assert packing.pack(spark.createDataFrame([(None, "x")], "doc_id long, text string"), PATH).count() == 1
