import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gristmill.operators import asof, facts, factors, metrics, portfolio, recursive, text, windows
from gristmill.operators.features import technical
from gristmill.plans import screen as s
from gristmill.plans.catalog import CATALOG

DAY = dt.date(2024, 1, 1)
BAD = [None, float("nan"), float("inf"), float("-inf")]


def days(n):
    return [DAY + dt.timedelta(k) for k in range(n)]


@pytest.mark.parametrize("op", [">", ">=", "<", "<=", "==", "!=", "between"])
def test_missing_never_passes(spark, op):
    frame = spark.createDataFrame([(k, x) for k, x in enumerate([*BAD, 5.0])], "ticker int, price double")
    cond = s.Condition("price", op, 5.0, 5.0 if op == "between" else None)
    ok, lacks = cond.columns(CATALOG)
    rows = frame.select("ticker", ok.alias("ok"), lacks.alias("lacks")).collect()
    assert not any(r.ok for r in rows if r.ticker < 4) and all(r.lacks for r in rows if r.ticker < 4)
    assert [r.ok for r in rows if r.ticker == 4] == [op in (">=", "<=", "==", "between")]


def test_missing_labels_never_pass(spark):
    frame = spark.createDataFrame([(1, None), (2, " "), (3, " Tech "), (4, "Energy")], "ticker int, gics_sector string")
    for op, want in (("in", {3}), ("not_in", {4}), ("==", {3}), ("!=", {4})):
        ok, _ = s.Condition("gics_sector", op, values=("TECH",)).columns(CATALOG)
        assert {r.ticker for r in frame.where(ok).collect()} == want


def test_a_bad_screen_names_every_problem():
    bad = s.Screen("x", (s.Condition("pric", ">", 1.0), s.Condition("price", ">", other_feature="beta_1y"), s.Condition("gics_sector", ">", 1.0), s.Condition("price", "in", values=("a",)), s.Condition("price", "between", 2.0, 1.0)), (), ((s.Condition("price", ">", 1.0),),))
    with pytest.raises(s.ScreenError) as e:
        bad.check(CATALOG)
    assert len(e.value.problems) == 7 and "did you mean price" in str(e.value)


def test_frames_and_suspended_floors(spark):
    frame = spark.createDataFrame([("a", 4.0, 1.0), ("b", 9.0, None), ("b", 9.0, 2.0)], "ticker string, price double, return_1m_pct double")
    screen = s.Screen("x", (s.Condition("return_1m_pct", ">", 0.0),), (s.RankFactor("return_1m_pct"),), universe=s.Universe(min_price=5.0))
    assert [tuple(r)[1:] for r in s.funnel(screen, frame, CATALOG).collect()] == [("price >= 5", 2, 2, 0), ("return_1m_pct > 0", 2, 1, 1)]
    got = [tuple(r)[1:] for r in s.funnel(screen, frame, CATALOG, "split-adjusted history").collect()]
    assert got == [("price >= 5 - NOT APPLIED (split-adjusted history)", 3, 3, 0), ("return_1m_pct > 0", 2, 2, 1)]
    assert [r.ticker for r in s.repeated(frame).collect()] == ["b"]
    with pytest.raises(s.ScreenError, match="lacks columns: return_1m_pct, price"):
        s.funnel(screen, frame.select("ticker"), CATALOG)


def test_ranks(spark):
    rows = [("a", 1.0), ("b", 1.0), ("c", 2.0), ("d", None)]
    f = spark.createDataFrame(rows, "ticker string, x double")
    got = {r.ticker: r.p for r in f.select("ticker", windows.percentile_rank("x").alias("p")).collect()}
    assert got == {"a": 0.25, "b": 0.25, "c": 1.0, "d": 0.5}
    one = f.where("ticker in ('c', 'd')").select("ticker", windows.percentile_rank("x").alias("p")).collect()
    assert {r.ticker: r.p for r in one} == {"c": 1.0, "d": 0.5}
    ten = spark.createDataFrame([(f"t{k}", float(k)) for k in range(10)], "ticker string, x double")
    sizes = ten.withColumn("b", windows.buckets("x", 4)).groupBy("b").count().orderBy("b").collect()
    assert [r["count"] for r in sizes] == [3, 2, 3, 2]


def panel(seed=1, names=6, n=300):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(names):
        price = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i, d in enumerate(days(n)):
            if rng.random() < 0.03:
                continue
            c = float(price[i])
            rows.append((k, d, c, c * 1.01, c * 0.99, float(rng.integers(1, 100))))
    return rows


BARS = "ticker int, date date, close double, high double, low double, volume double"


def test_features_don_t_look_ahead(spark):
    rows = panel()
    cut = days(300)[270]
    past = [r for r in rows if r[1] <= cut]
    later = [(t, d, c * 3, h, low, v) for t, d, c, h, low, v in rows if d > cut]
    names = ["sma_50", "return_6m_pct", "volatility_60d_pct", "high_52w", "golden_cross_20d", "up_down_volume_ratio_50d"]
    got = [sorted(map(str, technical(spark.createDataFrame(x, BARS)).where(F.col("date") <= cut).select("ticker", "date", *names).collect())) for x in (past, past + later)]
    assert got[0] == got[1]


def test_cleaning_bars(spark):
    rows = [(1, DAY, 5.0, 4.0, 6.0, 1.0), (1, DAY, 5.0, 4.0, 6.0, 1.0), (1, DAY + dt.timedelta(1), float("nan"), 1.0, 1.0, 1.0), (1, DAY + dt.timedelta(2), 7.0, None, None, 1.0)]
    got = windows.clean(spark.createDataFrame(rows, BARS)).orderBy("bar_no").collect()
    assert [(r.bar_no, r.close, r.high, r.low) for r in got] == [(1, 5.0, 5.0, 5.0), (2, 7.0, 7.0, 7.0)]


def test_recursions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    x[[0, 17, 60]] = np.nan
    want = pd.Series(x).dropna().ewm(alpha=0.2, adjust=False).mean().reindex(range(200)).to_numpy()
    assert np.allclose(recursive.ewm(x, 0.2), want, equal_nan=True)
    y = [1.0, 2.0, np.nan, 3.0, 4.0, 5.0, np.nan, 6.0]
    assert np.allclose(recursive.wilder(np.array(y), 3), [np.nan] * 5 + [4.0, np.nan, (4 * 2 + 6) / 3], equal_nan=True)
    c = 100 + np.cumsum(rng.normal(size=60))
    up = down = None
    d = np.diff(c)
    up, down = np.maximum(d[:14], 0).mean(), np.maximum(-d[:14], 0).mean()
    for v in d[14:]:
        up, down = (up * 13 + max(v, 0)) / 14, (down * 13 + max(-v, 0)) / 14
    assert recursive.rsi(c)[-1] == pytest.approx(100 * up / (up + down)) and np.isnan(recursive.rsi(np.ones(40))).all()


def test_capped_weights(spark):
    def slow(w, cap):
        w = np.array(w) / sum(w)
        if cap * len(w) <= 1 + 1e-12:
            return [cap] * len(w)
        out, fixed = w.copy(), np.zeros(len(w), bool)
        while (over := (out > cap * (1 + 1e-12)) & ~fixed).any():
            fixed |= over
            out[fixed], out[~fixed] = cap, w[~fixed] / w[~fixed].sum() * (1 - cap * fixed.sum())
        return out.tolist()

    rng = random.Random(5)
    groups = [[rng.choice([1, 1, 2, 5, 40, rng.random() * 9 + 0.1]) for _ in range(rng.randint(1, 9))] for _ in range(40)]
    rows = [(g, f"t{k}", w / sum(ws)) for g, ws in enumerate(groups) for k, w in enumerate(ws)]
    for cap in (0.15, 0.3, 0.5):
        got = {}
        for r in portfolio.capped(spark.createDataFrame(rows, "g int, ticker string, weight double"), cap, "g").collect():
            got.setdefault(r.g, {})[r.ticker] = r.weight
        for g, ws in enumerate(groups):
            assert [got[g][f"t{k}"] for k in range(len(ws))] == pytest.approx(slow(ws, cap))


def test_simulation_against_a_day_by_day_book(spark):
    rng = np.random.default_rng(9)
    n, names = 60, 4
    px = 20 * np.exp(np.cumsum(rng.normal(0, 0.05, (n, names)), axis=0))
    ds = days(n)
    when = [3, 15, 16, 40]
    target = {ds[i]: rng.dirichlet(np.ones(names)) * rng.choice([1, -1], names) for i in when}
    bars = spark.createDataFrame([(k, ds[i], float(px[i, k]), 0.0, 0.0, 0.0) for i in range(n) for k in range(names)], BARS)
    t = spark.createDataFrame([(d, k, float(w[k])) for d, w in target.items() for k in range(names)], "signal_date date, ticker int, weight double")
    daily, done = portfolio.simulate(t, bars, 20.0)
    want, traded, book, nav = {}, {}, np.zeros(names), 1.0
    for i in range(4, n):
        gross = 0.0
        if i > 4:
            growth = px[i] / px[i - 1] - 1
            gross = float(book @ growth)
            book = book * (1 + growth) / (1 + gross)
        cost = 0.0
        if i - 1 in when:
            new = target[ds[i - 1]]
            traded[i] = float(np.abs(new - book).sum())
            cost, book = traded[i] * 20 / 1e4, new.copy()
        want[i] = (gross, gross - cost)
    got = {r.session: (r.gross, r.net) for r in daily.collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)
    assert {r.session: r.traded for r in done.collect()} == pytest.approx(traded)


def test_statistics(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0.001, 0.02, 120)
    r = spark.createDataFrame([(d, float(v)) for d, v in zip(days(120), x)], "date date, ret double")
    p = metrics.performance(r, 252.0).first()
    series = pd.Series(x)
    wealth = (1 + series).cumprod()
    drop = wealth / np.maximum(1, wealth.cummax()) - 1
    assert p.skew == pytest.approx(series.skew()) and p.excess_kurtosis == pytest.approx(series.kurt())
    assert p.max_drawdown_pct == pytest.approx(drop.min() * 100) and p.sharpe == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(252))
    assert metrics.newey_west(r, 0).first().t_stat == pytest.approx(x.mean() / (x.std(ddof=1) / math.sqrt(120)))
    y = r.withColumn("y", 0.5 + 2 * F.col("ret"))
    fit = {t.term: t.beta for t in metrics.ols_newey_west(y, "y", ["ret"]).collect()}
    assert fit == pytest.approx({"const": 0.5, "ret": 2.0})
    assert metrics.periods_per_year(r).first().ppy == 252.0
    with pytest.raises(ValueError):
        metrics.ols_newey_west(y.limit(2), "y", ["ret"])


def test_asof_and_nearest(spark):
    left = spark.createDataFrame([(1, days(30)[k]) for k in (0, 5, 20)] + [(2, days(30)[9]), (3, DAY)], "k int, date date")
    right = spark.createDataFrame([(1, days(30)[3], 1.0), (1, days(30)[3], 2.0), (1, days(30)[6], None), (2, days(30)[9], 7.0)], "k int, rdate date, v double")
    got = {(r.k, r.date): r.v for r in asof.asof(left, right, "date", "rdate", ["v"], ["k"]).collect()}
    assert got == {(1, days(30)[0]): None, (1, days(30)[5]): 2.0, (1, days(30)[20]): None, (2, days(30)[9]): 7.0, (3, DAY): None}
    near = asof.nearest_within(left, right, "date", "rdate", 2, ["v"], ["k"]).collect()
    assert sorted((r.k, r.date.day, r.rdate.day) for r in near) == [(1, 6, 7), (2, 10, 10)]


def test_quarters_of_one_vintage(spark):
    d = dt.date
    rows = [  # a year of 400; nine months filed as 300, recast as 225 in a later filing
        (d(2020, 1, 1), d(2020, 3, 31), 90.0, d(2020, 5, 1), "a1"), (d(2020, 1, 1), d(2020, 6, 30), 190.0, d(2020, 8, 1), "a2"), (d(2020, 1, 1), d(2020, 9, 30), 300.0, d(2020, 11, 1), "a3"),
        (d(2020, 1, 1), d(2020, 12, 31), 400.0, d(2021, 2, 1), "a4"), (d(2020, 1, 1), d(2020, 9, 30), 225.0, d(2021, 11, 1), "a5"),
    ]
    f = spark.createDataFrame([(1, "sales", *r) for r in rows], "cik long, concept string, start date, end date, val double, filed date, accn string")
    got = facts.quarterly(f, "2022-01-01").orderBy("end").collect()
    assert [(r.end.month, r.val, r.derived) for r in got] == [(3, 90.0, False), (6, 100.0, True), (9, 35.0, True), (12, 100.0, True)]
    early = facts.quarterly(f, "2020-12-31").orderBy("end").collect()
    assert [r.val for r in early] == [90.0, 100.0, 110.0]
    assert facts.ttm(facts.quarterly(f, "2022-01-01")).orderBy("end").collect()[-1].ttm == pytest.approx(325.0)


def test_two_by_three(spark):
    rows = [(2020, f"t{k}", float(k + 1), float((k * 7) % 10), "NYSE" if k < 3 else "X") for k in range(10)]
    f = spark.createDataFrame(rows, "formation int, ticker string, size double, char double, exchange string")
    got = {r.ticker: r.port for r in factors.sort_two_by_three(f, exchange="exchange").collect()}
    size, char = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    lo, hi = np.percentile(char, [30, 70])
    assert got == {r[1]: ("S" if r[2] <= np.median(size) else "B") + "/" + ("L" if r[3] <= lo else "M" if r[3] <= hi else "H") for r in rows}


def test_text(spark):
    urls = [("HTTP://www.Example.com:80/a/?utm_source=x&b=1#f", "https://example.com/a?b=1"), ("arxiv.org/pdf/2101.00001v3.pdf", "https://arxiv.org/abs/2101.00001"), ("https://x.org:8443/", "https://x.org:8443/"), ("", ""),
        ("http://www.arxiv.org/pdf/2401.01234v2.pdf", "https://arxiv.org/abs/2401.01234"), ("https://export.arxiv.org/abs/math.GT/0309136v1", "https://arxiv.org/abs/math.GT/0309136"), ("https://export.arxiv.org/list/q-fin/new", "https://arxiv.org/list/q-fin/new"),
        ("https://papers.ssrn.com/sol3/papers.cfm?abstract_id=123&utm_source=x#frag", "https://papers.ssrn.com/sol3/papers.cfm?abstract_id=123"), ("HTTPS://Example.com/a/b/", "https://example.com/a/b"), ("http://[::1]:8080/a/", "https://[::1]:8080/a"),
        ("https://example.com:abc/x", "https://example.com:abc/x"), ("https://Example.com:99999/x", "https://example.com:99999/x"), ("http://[::1/x", "http://[::1/x"), ("http://u:p@x.org//a///b//?q=a%20b&&k&z=%zz", "https://x.org/a/b?q=a+b&k=&z=%25zz"), ("x.org", "https://x.org/")]
    got = spark.createDataFrame(urls, "u string, want string").select(text.canonical_url("u").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    docs = spark.createDataFrame([(1, "Mr. Smith said no. It was not stupid; but It is stupid! Really?\nYes")], "doc_id int, text string")
    parts = text.sentences(docs, "doc_id").orderBy("pos").collect()
    assert [r.sentence for r in parts] == ["Mr. Smith said no.", "It was not stupid; but It is stupid!", "Really?", "Yes"]
    rows = spark.createDataFrame([(1, "This is not stupid"), (2, "No doubt; it is stupid"), (3, "fine")], "k int, sentence string")
    said = {"pricing pressure was not a factor in the quarter": True, "we saw no pricing pressure": True, "not only pricing pressure": False, "not enough to offset pricing pressure": False, "no growth, but pricing pressure": False, "there was pricing pressure": False, "We did not anticipate the pricing pressure": False, "pricing pressure, which did not help": False}
    told = spark.createDataFrame(list(said.items()), "sentence string, want boolean")
    assert {r.sentence: r.negated for r in text.tags(told, {"price": ("pricing pressure", -1)}).collect()} == said
    tags = {r.k: (r.negated, r.polarity) for r in text.tags(rows, {"insult": ("stupid", -1)}).collect()}
    assert tags == {1: (True, 1), 2: (False, -1)}
    q = spark.createDataFrame([(1, "“Quoted”  Text — here"), (2, "missing"), (3, " ")], "quote_id int, text string")
    d = spark.createDataFrame([(7, 'so "quoted" text - HERE it is'), (8, "nothing"), (9, None)], "doc_id int, text string")
    assert [tuple(r) for r in text.verified_quotes(q, d).collect()] == [(1, 7)]
    a = spark.createDataFrame([("The big Cat", "big cat!")], "a string, b string").select(text.title_jaccard(F.col("a"), F.col("b")).alias("j")).first().j
    assert a == pytest.approx(2 / 3)
