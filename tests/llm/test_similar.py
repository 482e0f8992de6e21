import random

from gristmill.llm import simhash, similar


def shingles(t):
    w = (t or "").lower().encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def true_groups(texts, least):
    ids, sets = sorted(texts), {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def fixture():
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    texts, passage = {}, [word() for _ in range(60)]
    for i in range(0, 600, 10):
        base = [word() for _ in range(rng.randint(60, 230))]
        if i % 50 == 0:
            base[20:20] = passage
        texts[i] = " ".join(base)
        for k in range(1, rng.randint(1, 5)):
            near = list(base)
            for _ in range(max(1, len(near) // 60)):
                near[rng.randrange(len(near))] = word()
            texts[i + k] = " ".join(near)
    texts |= {601: texts[0], 602: texts[0].upper(), 603: None, 604: "", 605: "x y", 606: "X  y"}
    return texts


def test_groups_against_brute_force(spark):
    texts = fixture()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = true_groups(texts, 0.8)
    for cell in (4096, 3):
        got = {r.doc_id: r.component_id for r in similar.groups(docs, cell=cell).collect()}
        assert got == want
    assert similar.groups(docs.where("false")).collect() == []


def test_keep_one(spark):
    rows = [(1, "a b c d e f", "x"), (2, "A b c d e  f", "y"), (2, "A b c d e  f", "y"), (1, "a b c d e f", "x"), (None, "a b c d e f", "z"), (9, "else", None)]
    kept = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string, h string"))
    assert kept.columns == ["doc_id", "text", "h"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "9", "None"]


def shared(rng, common, own):
    """Two texts of words that occur once: ``common`` leading words are the same, ``own`` are not."""
    word = iter(rng.sample(range(10**9), common + 2 * own))
    head = [f"w{next(word)}" for _ in range(common)]
    return tuple(" ".join(head + [f"w{next(word)}" for _ in range(own)]) for _ in range(2))


def test_threshold_of_long_texts(spark):
    rng, texts = random.Random(5), {}
    for k in range(40):
        a, b = shared(rng, 1000, 110 if k % 2 else 140)  # 0.819 and 0.781 of the shingles
        texts |= {2 * k: a, 2 * k + 1: b}
    got = {r.doc_id: r.component_id for r in similar.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == true_groups(texts, 0.8)
    assert len(set(got.values())) == 60


def test_repeated_shingles(spark):
    """One shingle repeated often rules a fingerprint, not the similarity."""
    rng, texts = random.Random(6), {}
    for k in range(10):
        plain = shared(rng, 800, 0)[0]
        texts |= {2 * k: plain, 2 * k + 1: plain + " ." * 44}
    got = {r.doc_id: r.component_id for r in similar.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == true_groups(texts, 0.8) == {i: i - i % 2 for i in texts}


def test_appended_copies():
    """Texts that are the other one and a quarter more are at 0.8 exactly; each pair is found."""
    rng, missed = random.Random(7), 0
    for _ in range(400):
        words = shared(rng, 1254, 0)[0].split()
        missed += not similar.verified_pairs([similar.sketch(" ".join(w).encode())[1] for w in (words[:1004], words)])
    assert missed == 0


def test_pairs_of_a_cell_against_brute_force():
    for seed in range(20):
        rng = random.Random(seed)
        words = lambda n: [str(rng.random()) for _ in range(n)]
        base, texts = words(60), {}
        for i in range(60):
            text = list(base) if rng.random() < 0.6 else words(rng.randint(1, 80))
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = str(rng.random())
            texts[i] = " ".join(text[: rng.randint(1, len(text))] if rng.random() < 0.3 else text)
        least = {i: i for i in texts}
        for p, q in similar.verified_pairs([similar.sketch(t.encode())[1] for t in texts.values()]):
            a, b = sorted((least[p], least[q]))
            least = {i: a if x == b else x for i, x in least.items()}
        assert least == true_groups(texts, 0.8)


def test_fingerprints_of_the_operator():
    rng = random.Random(8)
    for n in (0, 1, 4, 5, 60, 40_000):
        text = " ".join(rng.choice("abcdefgh") + rng.choice(["", "X"]) for _ in range(n)).encode()
        assert similar.sketch(text)[2] == simhash.fingerprint(text, 5)


def test_grid_of_fingerprints_finds_what_samples_miss(spark):
    """Pairs at 0.808 with a phrase repeated in both: equal fingerprints, but no cell from samples in common."""
    texts = {}
    for k, seed in enumerate((966, 9176, 9515)):
        word = iter(random.Random(seed).sample(range(10**6), 60))
        head = [f"w{next(word)}" for _ in range(45)]
        pair = [" ".join([*head, f"w{next(word)}", *["again"] * 60]) for _ in range(2)]
        a, b = (set(similar.sketch(t.encode())[0]) for t in pair)
        assert not a & b
        texts |= {2 * k: pair[0], 2 * k + 1: pair[1]}
    got = {r.doc_id: r.component_id for r in similar.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == true_groups(texts, 0.8) == {i: i - i % 2 for i in texts}
