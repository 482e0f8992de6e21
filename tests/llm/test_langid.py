import random
import zlib

from gristmill.llm import langid


def test_held_out_accuracy(spark):
    from gristmill.llm.queries import op6_language_id

    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) / len(test) > 0.94


def test_held_out_labels_are_not_learned(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.held_out(docs["doc_id"])
    other = docs.withColumn("lang", langid.F.when(out, langid.F.lit("xx")).otherwise(langid.F.col("lang")))
    got = lambda d: sorted(map(tuple, langid.identify(d).collect()))
    assert got(docs) == got(other)


def test_edge_cases(spark):
    rng = random.Random(1)
    say = lambda words: " ".join(rng.choice(words) for _ in range(40))
    a, b = ["der", "und", "nicht", "schön"], ["the", "and", "with", "which"]
    rows = [(k, say(a if k % 2 else b), "de" if k % 2 else "en", 1.0) for k in range(60)]
    rows += [(110, "²½ Ⅷ ①_ 12", "de", 0.0), (111, "² ʰ", "de", 0.0)]
    rows += [(100, None, "de", 0.0), (101, "", "en", 0.0), (102, "123 §", "en", 0.0), (103, say(b) * 200, None, 0.0), (104, "x", None, 0.0), (None, say(a), "de", 0.0), (5, rows[5][1], "de", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: (r.lang_pred, r.score, r.held_out) for r in langid.identify(docs).collect()}
    assert all(got[k][0] == ("de" if k % 2 else "en") for k in range(60))
    assert [got[k][:2] for k in (100, 101, 102, 110)] == [("und", 0.0)] * 4
    assert got[111][0] != "und"
    assert got[103][0] == "en" and got[None][0] == "de" and got[104][0] in ("de", "en") and not got[None][2]
    assert langid.identify(docs.where("false")).collect() == []
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}


def test_letters_are_those_of_category_l():
    import unicodedata

    for c in map(chr, range(0x30000)):
        assert langid.lettered(f"1 {c}_") == (unicodedata.category(c)[0] == "L")


def test_shares():
    rng = random.Random(4)
    for _ in range(300):
        texts = [b"x" * rng.choice([1, 2, 5, 40, 300]) for _ in range(rng.randint(1, 30))]
        size = rng.randint(1, 2000)
        got = len(langid.shared(texts, size))
        assert got == sum(map(len, texts)) if sum(map(len, texts)) <= size else size - len(texts) <= got <= size


def test_dictionaries_hold_all_parts_of_all_sampled_texts(spark):
    """Not only the beginnings of texts, nor only the first of long ones."""
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "abcde" for b in "fghij" for c in "klmno"]
    rows = [(k, " ".join([f"start{'z' * (k % 3)}"] * 3000 + [f"k{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}k"] * 9000 + rng.choices(words, k=50)), "xx") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    raw = dict(langid.fit(docs).dictionaries)["xx"].decode()
    assert len(raw) <= langid.DICTIONARY and len(raw) > 0.95 * langid.DICTIONARY
    assert sum(f"k{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}k" in raw for k in range(60)) >= 35


def test_query_against_plain_compression(spark, sf):
    """Each text alone against each dictionary, with nothing kept between texts."""
    import zstandard as z

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.identify(docs).collect():
        raw = langid.folded(texts[r.doc_id] or "").encode()
        sizes = {}
        for lang, content in model.dictionaries:
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            c = z.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(raw[k : k + langid.CHUNK])) for k in range(0, max(1, len(raw)), langid.CHUNK))
        best = min(sizes, key=lambda x: (sizes[x], x))
        if texts[r.doc_id] and langid.lettered(texts[r.doc_id]):
            odds = sum(2.0 ** -min(n - sizes[best], 1000) for n in sizes.values())
            assert (r.lang_pred, round(r.score, 9)) == (best, round(1 / odds, 9))
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)
