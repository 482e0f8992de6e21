import re

import pytest

from gristmill.llm import html_extract as x

LONG = "A sentence, with commas, long enough to count as a paragraph of the main text of this page, one would think."


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("plain  text", "plain text"),
        ("<p", ""),
        (page(""), ""),
        (page(f"<nav><p>{LONG}</p></nav><article><h1>Title</h1><p>{LONG}</p><p>Fin.</p></article><footer><p>{LONG}</p></footer>"), f"Title\n{LONG}\nFin."),
        (page(f"<div class='page-header'>x</div><div id=main><p>{LONG}<p>two &amp;amp; three&nbsp;&#65;<br>four</div><div class=\"sidebar\"><p>{LONG}</p></div>"), f"{LONG}\ntwo &amp; three A four"),
        (page(f"<article><header><h1>T</h1></header><p>{LONG}</p><form>f<input><button>go</button></form><ul><li>one<li>two</ul></article><section id=comments><p>{LONG}{LONG}</p></section>"), f"T\n{LONG}\none\ntwo"),
        (page(f"<div class='cookie-notice'>We use, cookies, and, more, of, them</div><article><p>{LONG}</p></article>"), LONG),
        (page(f"<article><p>a<b>b</b>c <i>d</i></p><!-- <p>no</p> --><script>var t='</p>';</script><style>p{{}}</style><p>{LONG}</p></article>"), f"abc d\n{LONG}"),
        (page(f"<div class=header><p>{LONG}</p></div><main><div class='article header'><h1>T</h1></div><p data-id='comment'>{LONG}</p><div role=alert>x</div><p hidden>y</p></main>"), f"T\n{LONG}"),
        (page(f"<article><p><b>{LONG}<br><p>next</article>"), f"{LONG}\nnext"),
        (page(f"<div><a href=x>{LONG}</a></div><div><p>{LONG}</p><p>{LONG}</p></div>"), f"{LONG}\n{LONG}"),
    ],
)
def test_pages(html, want):
    assert x.extract(html) == want


def test_deep_and_broken_markup():
    assert x.extract("<div>" * 20000 + "x, y" + "</div>" * 5) == "x, y"
    assert x.extract('<p class="a' * 300) == ""
    assert x.extract("<p>a < b > c</p>") == "a < b > c"


def test_long_attribute_values():
    for quote in "\"'":
        for n in (100, 5_000, 500_000):
            value = f"data-x={quote}{'a' * n} > words{quote}"
            assert x.extract(f"<div {value}>text</div>") == "text"
            assert x.extract(f"<p>{LONG}</p><div {value} class={quote}sidebar{quote}><p>{LONG} aside</p></div>") == LONG
    assert x.extract(f"<p title=\"{'a' * 5_000}>text</p>") == "text"  # never closed


def test_names_that_only_contain_a_word():
    for name in ("social-security", "share-price", "notice-of-appeal", "side-effects"):
        assert x.extract(page(f"<article><h1>T</h1><p>{LONG}</p><div class='{name}'><p>{LONG} inner</p></div></article>")) == f"T\n{LONG}\n{LONG} inner"
    for name in ("ad", "ad-slot-1", "social share-buttons", "cookie-banner", "related-posts", "comment-list", "x newsletter-signup"):
        assert x.extract(page(f"<article><h1>T</h1><p>{LONG}</p><div class='{name}'><p>{LONG} inner</p></div></article>")) == f"T\n{LONG}"


def test_hostile_markup_takes_time_in_proportion():
    import time

    def seconds(make, n):
        began = time.perf_counter()
        x.extract(make(n))
        return time.perf_counter() - began

    pages = {
        "unmatched ends": lambda n: "<b>" * n + "</i>" * n + LONG,
        "rules under inline elements": lambda n: "<b>" * n + "<hr>" * n + LONG,
        "headers": lambda n: "<section>" + "<header>" * n + LONG,
        "items": lambda n: "<ul>" + "<li><b>x" * n,
        "quotes": lambda n: "<a \"" * n + LONG,
        "scripts": lambda n: "<script>" * n,
    }
    for name, make in pages.items():
        small, large = min(seconds(make, 4000) for _ in range(3)), seconds(make, 32000)
        assert large < 30 * small + 0.5, name


def test_query(spark, sf):
    from html import unescape

    from gristmill.llm.queries import op3_html_extraction

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op3_html_extraction(spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article)
        want = "\n".join(t for t in (" ".join(unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts) if t)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


def test_clashing_columns_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "u", page(f"<p>{LONG}</p>"), "old", 3.5), (2, None, None, None, None)], "page_id long, url string, html string, text string, n_chars double")
    got = x.main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect())) == [(1, "u", LONG, len(LONG)), (2, None, "", 0)]
    assert x.main_text(pages.where("false")).collect() == []
    long = pages.unionAll(pages).limit(2).withColumn("html", x.F.lit(page(f"<article>{f'<p>{LONG}</p>' * 20000}</article>")))
    assert {tuple(r) for r in x.main_text(long).selectExpr("n_chars").collect()} == {(20000 * (len(LONG) + 1) - 1,)}
