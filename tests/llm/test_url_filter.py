import itertools

from pyspark.sql import functions as F

from gristmill.llm import url_filter as u

URLS = ["http://a.Example.com/en/70", "http://example.com/en/7?x", "https://b.com/en/x#y", "http://org/es/1", "http://xorg/es/1", "http://n.net/de/8", "HTTP://EXAMPLE.NET/de/8", "x", None, "", "ftp://net", "http://?q://org/es/", "a://b://c/d"]


def rule_of(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = host.translate(str.maketrans(u.UPPER, u.LOWER))
    fits = [r for r in u.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_rules(spark):
    pages = spark.createDataFrame([*enumerate(URLS), (3, URLS[3]), (None, URLS[0])], "page_id long, url string")
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in u.judge(pages, pages.select("url", F.lit(None).cast("boolean").alias("bad"))).collect())
    want = []
    for i, url in [*enumerate(URLS), (3, URLS[3]), (None, URLS[0])]:
        host, path, name, verdict = rule_of(url)
        want.append((str(i), host, path, str(name), verdict or "allow"))
    assert got == sorted(want)
    assert u.judge(pages.where("false"), pages.select("url", F.lit(True).alias("bad")).where("false")).collect() == []


def test_mined_rules_against_brute_force(spark):
    urls = [f"https://{a}.{b}.org/{c}/{k}" for k, (a, b, c) in enumerate(itertools.product(["www", "m", "spam"], ["one", "two"], ["en", "win", "x"] * 2))]
    bad = ["spam.one" in x or ("/win/" in x and "two" in x) or k % 17 == 0 for k, x in enumerate(urls)]
    labelled = spark.createDataFrame(list(zip(urls, bad)), "url string, bad boolean")
    sets = {r.url: frozenset(r.t) for r in labelled.withColumn("host", u.host(F.col("url"))).withColumn("path", u.path(F.col("url"))).select("url", u.tokens().alias("t")).collect()}
    support, confidence = max(0.05, 3 / len(urls)), 0.7
    found = {}
    for items in {frozenset(c) for s in sets.values() for n in range(1, len(s) + 1) for c in itertools.combinations(sorted(s), n)}:
        on = [b for x, b in zip(urls, bad) if items <= sets[x]]
        if sum(on) >= support * len(urls) - 1e-9 and sum(on) / len(on) >= confidence:
            found[items] = sum(on) / len(on)
    want = {i: c for i, c in found.items() if not any(j < i and d >= c for j, d in found.items())}
    rules = u.mine(labelled, 0.05, 3, confidence)
    assert {frozenset(r["items"]): round(r.confidence, 9) for r in rules.collect()} == {i: round(c, 9) for i, c in want.items()} and want
    hits = {r.url: round(r.confidence, 9) for r in u.matched(labelled, rules).collect()}
    assert hits == {x: round(max(c for i, c in want.items() if i <= s), 9) for x, s in sets.items() if any(i <= s for i in want)}


def test_query_has_no_python(spark, sf):
    from gristmill.llm.queries import op5_url_filter

    found = op5_url_filter(spark, sf)
    rows = found.collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        host, path, name, verdict = rule_of(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, name) and (verdict is None or r.verdict == verdict)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_every_path_part(spark):
    rows = [(f"https://h{k}.example/" + ("Casino24/login.php" if k < 20 else "win-2024/%C3%A4/ñu"), k < 20) for k in range(40)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    got = labelled.withColumn("host", u.host(F.col("url"))).withColumn("path", u.path(F.col("url"))).select(F.explode(u.tokens()).alias("t")).distinct()
    assert {r.t for r in got.where("t like 'path=%'").collect()} == {"path=casino24", "path=login.php", "path=win-2024", "path=%c3%a4", "path=ñu"}
    rules = u.mine(labelled)
    assert ["path=casino24"] in [list(r[0]) for r in rules.select("items").collect()]
    urls = spark.createDataFrame([("http://other.test/casino24/x",), ("http://other.test/casino/x",)], "url string")
    assert [r.url for r in u.matched(urls, rules).collect()] == ["http://other.test/casino24/x"]


def test_tokens_that_always_come_together(spark):
    """Sixteen of them would make 65,536 sets; rules are as without the merging."""
    rows = [(f"https://a{k % 7}.test/" + "/".join(f"t{j}" for j in range(16)) if k % 3 else f"https://a{k % 7}.test/plain", bool(k % 3)) for k in range(90)]
    rules = u.mine(spark.createDataFrame(rows, "url string, bad boolean"), 0.1, 5, 0.9).collect()
    assert {tuple(r["items"]) for r in rules} == {(f"path=t{j}",) for j in range(16)}


def test_many_rules_meet_by_a_shuffle(spark, monkeypatch):
    rules = spark.createDataFrame([(["scheme=https"], 0.7, 0.1), (["host=a", "scheme=https"], 0.9, 0.1), (["host=zz"], 1.0, 0.1)], "items array<string>, confidence double, support double")
    urls = spark.createDataFrame([(f"https://{'ab'[k % 2]}.org/{k}",) for k in range(50)] + [("http://a.org/1",), (None,)], "url string")
    want = {f"https://{'ab'[k % 2]}.org/{k}": 0.7 if k % 2 else 0.9 for k in range(50)}
    for small in (u.SMALL, 0):
        monkeypatch.setattr(u, "SMALL", small)
        assert {r.url: r.confidence for r in u.matched(urls, rules).collect()} == want


def test_labels_of_pages(spark):
    good = "<html><head><title>x</title></head><body><nav>m</nav><p>" + "some words of a plain text here " * 3 + "</p></body></html>"
    rows = [("a", good), ("b", "<p>too short</p>"), ("c", "<p>" + "a ### b *** " * 9 + "</p>"), ("d", None), ("e", "<p>" + "abcdefghijklmnop" * 5 + " word" * 12 + "</p>"), ("f", "<script>" + "word " * 20 + "</script>")]
    pages = spark.createDataFrame([(k, *r, True) for k, r in enumerate(rows)], "page_id long, url string, html string, bad boolean")
    assert {r.url: r.bad for r in u.page_labels(pages).collect()} == {"a": False, "b": True, "c": True, "d": True, "e": False, "f": True}


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, URLS[0], "x", 2.0, True)], "page_id long, url string, host string, confidence double, verdict boolean")
    got = u.judge(pages, u.page_labels(pages.withColumn("html", F.lit("x"))))
    assert [tuple(r)[:5] for r in got.collect()] == [(1, "a.example.com", "/en/70", "example.com/en/7", "allow")]
