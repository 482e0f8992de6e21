import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import dates, strings
from gristmill.operators import asof, backtest, cross_section, factors, features, pit, verdicts, windows
from gristmill.sinks import stores
from gristmill.sources import files, frames

DAY = dt.date(2024, 1, 1)


def values(spark, pairs, make):
    """What ``make`` gives for the first of each pair, beside the second."""
    rows = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(pairs)], "k int, x string").select("k", make(F.col("x")).alias("y")).collect()
    return [(r.y, pairs[r.k][1]) for r in sorted(rows)]


def test_tickers(spark):
    said = [("brk.b", "BRK-B"), (" bf/b ", "BF-B"), ("SHOP.TO", "SHOP.TO"), ("vod.l", "VOD.L"), ("7203.T", "7203.T"), ("BMW.F", "BMW.F"), ("abc", "ABC"), ("toolong.a", "TOOLONG.A")]
    assert all(a == b for a, b in values(spark, said, strings.ticker))


def test_cuts_at_sentences(spark):
    t = "This is one. This is two! And three? Final sentence here without end"
    for text, most, want in ((t, 200, t), (t, 25, "This is one. This is two!"), (t, 40, "This is one. This is two! And three?"), ("First paragraph without a full stop\n\nSecond paragraph goes on and on", 50, "First paragraph without a full stop")):
        assert values(spark, [(text, want)], lambda c, n=most: strings.cut_at_sentence(c, n))[0][0] == want
    short = values(spark, [("averyveryverylongwordwithoutanyspaces and more", None)], lambda c: strings.cut_at_sentence(c, 20))[0][0]
    assert len(short) <= 20 and short.endswith("…")


def test_names(spark):
    got = values(spark, [("My  Strategy!!", "my-strategy"), ("a_b", "a_b"), ("--x--", "x"), (" ", None), ("a|b\n<i>", None)], strings.slug)
    assert all(a == b for a, b in got[:4])
    assert values(spark, [("a|b\n<i>", None)], strings.cell)[0][0] == "a\\|b &lt;i>"
    assert values(spark, [("<a b=\"c\">&'", None)], strings.xml)[0][0] == "&lt;a b=&quot;c&quot;&gt;&amp;&#x27;"
    long = values(spark, [("é" + "x" * 80, None), ("é" + "x" * 81, None)], strings.slug)
    assert len(long[0][0]) <= 64 and long[0][0] != long[1][0]


def test_business_days_against_numpy(spark):
    days = [DAY + dt.timedelta(k) for k in range(30)]
    rows = spark.createDataFrame([(d, n) for d in days for n in (-9, -1, 0, 1, 6)], "d date, n int")
    got = rows.select("d", "n", dates.add_business_days(F.col("d"), F.col("n")).alias("m"), dates.roll(F.col("d"), True).alias("f"), dates.business_days(F.lit(days[11]), F.col("d")).alias("c")).collect()
    for r in got:
        assert np.datetime64(r.m) == np.busday_offset(np.datetime64(r.d), r.n, roll="backward")
        assert np.datetime64(r.f) == np.busday_offset(np.datetime64(r.d), 0, roll="forward")
        assert r.c == np.busday_count(np.datetime64(days[11]), np.datetime64(r.d))
    e = values(spark, [("0", dt.date(1970, 1, 1)), ("1700000000.5", dt.date(2023, 11, 14)), ("-1", dt.date(1969, 12, 31)), ("x", None), ("NaN", None)], dates.epoch_date)
    assert all(a == b for a, b in e)


FACTORS = "Preamble, 2024\r\nmore\r\n\r\n,Mkt-RF,SMB,RF\r\n202001,  1.50, -99.99,0.1\r\n202002, -2.00,  0.25,-999\r\n\r\n Annual Factors\r\n,Mkt-RF,SMB,RF\r\n2020, 9, 9, 9\r\n202003,7,7,7\r\nCopyright\r\n"


def test_factor_tables(spark):
    daily = ",Mkt-RF\n20200103,1\n20200106,2\n"
    texts = spark.createDataFrame([("m", FACTORS), ("d", "﻿" + daily), ("none", "nothing here")], "path string, text string")
    got = {(r.path, r.date, r.name): r.value for r in files.factor_table(texts).collect()}
    jan, feb = dt.date(2020, 1, 31), dt.date(2020, 2, 29)
    want = {("m", jan, "Mkt-RF"): 0.015, ("m", jan, "SMB"): None, ("m", jan, "RF"): 0.001, ("m", feb, "Mkt-RF"): -0.02, ("m", feb, "SMB"): 0.0025, ("m", feb, "RF"): None, ("d", dt.date(2020, 1, 3), "Mkt-RF"): 0.01, ("d", dt.date(2020, 1, 6), "Mkt-RF"): 0.02}
    assert got.keys() == want.keys() and all(got[k] == (None if v is None else pytest.approx(v)) for k, v in want.items())


def test_ticker_lists_and_charsets(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("# mine\r\nbrk.b the best\r\n\r\nmsft\r\nBRK-B\r\n".encode("utf-16"))
    (tmp_path / "b.csv").write_bytes('name;Symbol\n"Café";aapl\nx;brk.b\ny;\n'.encode("latin-1"))
    texts = files.whole_texts(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.csv")])
    got = {}
    for r in files.tickers(texts).orderBy("path", "place").collect():
        got.setdefault(r.path[-5:], []).append(r.ticker)
    assert got == {"a.txt": ["BRK-B", "MSFT"], "b.csv": ["AAPL", "BRK-B"]}


def test_feeds(spark):
    atom = '<?xml version="1.0"?><feed><title>f</title><entry><id>http://x/abs/1</id><title>A\n  title</title><link href="http://x/1" rel="alternate"/><published>2024-01-02</published><summary> s </summary></entry></feed>'
    rss = "<rss><channel><item><title><![CDATA[B]]></title><link>http://y/2</link><pubDate>Tue</pubDate><description>d</description></item><item><title>C</title></item></channel></rss>"
    bomb = '<!DOCTYPE x [<!ENTITY a "b">]><rss><item><title>&a;</title></item></rss>'
    got = files.entries(spark.createDataFrame([("a", atom), ("r", rss), ("b", bomb)], "path string, text string")).orderBy("title").collect()
    assert [tuple(r) for r in got] == [("a", "A title", "http://x/1", "2024-01-02", "s"), ("r", "B", "http://y/2", "Tue", "d"), ("r", "C", None, None, None)]


def test_stores(spark, tmp_path):
    kept = stores.Definitions(str(tmp_path / "d"))
    kept.save("one", {"a": 1, "ä": [1.5]})
    kept.save("one", {"a": 2})
    kept.save("two", {})
    assert kept.names() == ["one", "two"] and kept.load("one") == {"a": 2}
    kept.delete("two")
    assert kept.names() == ["one"]
    for bad in ("../x", "", "A b"):
        with pytest.raises(ValueError):
            kept.save(bad, {})
    with pytest.raises(ValueError):
        kept.save("nan", {"x": float("nan")})
    assert kept.names() == ["one"]
    table = spark.createDataFrame([(1, "x|y")], "k int, name string")
    stores.write_run(str(tmp_path / "run"), {"b": 1, "a": 2}, {"features.csv": table, "result.json": table})
    assert [r.value for r in spark.read.text(f"{tmp_path}/run/spec.json").collect()] == ['{"a": 2, "b": 1}']
    assert spark.read.option("header", True).csv(f"{tmp_path}/run/features.csv").collect()[0].name == "x|y" and spark.read.json(f"{tmp_path}/run/result.json").count() == 1
    assert [r.line for r in stores.table_lines(table, ["k", "name"], "k").orderBy("no").collect()] == ["| k | name |", "| --- | --- |", "| 1 | x\\|y |"]
    at = lambda d: dt.datetime(2024, 1, d)
    inbox = spark.createDataFrame([("a", at(1), "rejected", 1), ("b", at(9), "rejected", 1), ("c", None, "rejected", 1)], "id string, seen timestamp, status string, v int")
    rest, dead = stores.pruned(inbox, "2024-01-05")
    assert sorted(r.id for r in rest.collect()) == ["b", "c"] and [r.id for r in dead.collect()] == ["a"]
    new = spark.createDataFrame([("a", at(20), 2), ("b", at(3), 2), ("d", at(4), 2)], "id string, seen timestamp, v int")
    got = {r.id: (r.v, r.status) for r in stores.merged(rest, new, dead).collect()}
    assert got == {"b": (1, "rejected"), "c": (1, "rejected"), "d": (2, "new")}


def test_thinned_series_keep_their_spikes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 1000)
    x[[400, 401]] = 50, -50
    series = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k int, v double")
    got = [r.k for r in stores.thinned(series, "k", "v", 60).orderBy("k").collect()]
    assert len(got) <= 60 and {0, 400, 401, 999} <= set(got)
    assert stores.thinned(series.where("k < 60"), "k", "v", 60).count() == 60


def test_cross_section_is_the_last_row_of_the_series(spark):
    rng = np.random.default_rng(8)
    rows = []
    for t in range(5):
        px = 20 * np.exp(np.cumsum(rng.normal(0, 0.03, 330)))
        for k in range(330 if t else 40):
            if t != 2 or k % 50:
                rows.append((f"t{t}", DAY + dt.timedelta(k + (0 if t else 290)), float(px[k]), float(px[k] * 1.01), float(px[k] * 0.99), float(rng.integers(1, 100))))
    rows += [("t1", rows[-1][1], 1.0, 1.0, 1.0, 1.0), ("gone", DAY, 5.0, 5.0, 5.0, 1.0), ("t3", DAY + dt.timedelta(400), float("nan"), 1.0, 1.0, 1.0)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double, high double, low double, volume double")
    levels = spark.createDataFrame([(DAY + dt.timedelta(k), float(100 + rng.normal())) for k in range(0, 330, 2)], "date date, level double")
    want = {r.ticker: r.asDict() for r in features.latest(features.against_benchmark(features.technical(bars), levels)).collect()}
    got = {r.ticker: r.asDict() for r in cross_section.technical_at(bars, levels).collect()}
    assert got.keys() == want.keys() == {f"t{k}" for k in range(5)}
    for t, row in got.items():
        for name, v in row.items():
            if name in ("average_volume_20d",):
                continue
            w = want[t][name]
            assert v == w or v == pytest.approx(w, rel=1e-9, abs=1e-9), (t, name)
    assert any(r["beta_1y"] is not None for r in got.values()) and got["t0"]["sma_50"] is None


def test_repeated_dates_by_order(spark):
    rows = [("a", DAY, 5.0, 1), ("a", DAY, 3.0, 2), ("a", DAY + dt.timedelta(1), 4.0, 1)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double, seq int").selectExpr("*", "close as high", "close as low", "1D as volume")
    assert [r.close for r in windows.clean(bars, "seq").orderBy("bar_no").collect()] == [3.0, 4.0]
    assert cross_section.recent(bars, order="seq").first().b[0].close == 3.0


def test_values_on_dates(spark):
    left = spark.createDataFrame([(DAY,), (DAY + dt.timedelta(5),), (DAY + dt.timedelta(5),)], "date date")
    right = spark.createDataFrame([(DAY + dt.timedelta(1), 1.0), (DAY + dt.timedelta(4), None)], "d date, v double")
    got = asof.on_dates(left, right, "date", ["v"], "d").orderBy("date").collect()
    assert [(r.date.day, r.v) for r in got] == [(1, None), (6, None)]
    assert [r.v for r in asof.on_dates(left, right.where("v is not null"), "date", ["v"], "d").orderBy("date").collect()] == [None, 1.0]
    assert [r.v for r in asof.on_dates(left, right.where("v is not null"), "date", ["v"], "d", 3).orderBy("date").collect()] == [None, None]


def test_point_in_time_rows(spark):
    x = lambda v: F.lit(v).cast("double")
    none = x(None)
    debt = lambda *a: spark.range(1).select(pit.total_debt(*a).alias("d")).first().d
    assert debt(x(10), none, x(2), none, [], []) == 12 and debt(x(10), x(3), none, x(5), [], []) == 12 and debt(x(10), x(6), none, x(5), [], []) == 10
    assert debt(none, none, x(1), x(4), [(x(7), x(2))], []) == 11 and debt(none, none, x(3), x(4), [(x(7), x(2))], []) == 12 and debt(none, none, x(1), none, [(none, x(2)), (x(5), x(2))], []) == 8
    assert debt(none, none, none, none, [], [x(3), none, x(4)]) == 7 and debt(none, none, none, none, [], [none]) is None and debt(none, none, x(0), none, [], []) == 0
    d = dt.date
    cover = spark.createDataFrame([(1, d(2020, 1, 1), "a", d(2019, 12, 20), 5.0), (1, d(2020, 1, 1), "a", d(2019, 12, 20), 5.0), (1, d(2020, 6, 1), "b", d(2020, 5, 20), 7.0)], "cik int, filed date, accn string, end date, val double")
    diluted = spark.createDataFrame([(2, d(2020, 1, 1), d(2019, 12, 31), 9.0)], "cik int, filed date, end date, val double")
    assert {r.cik: r.shares for r in pit.shares_outstanding(cover, diluted, "2020-03-01").collect()} == {1: 10.0, 2: 9.0}
    index = spark.createDataFrame([(1, ["a", "b", "c"], [d(2020, 1, 5), d(2020, 4, 5), d(2020, 5, 5)], [d(2019, 12, 31)] * 3, ["8-K", "8-K", "8-K/A"], ["x", "y", "z"], ["9.01, 2.02", "5.02", "2.02"])], "cik int, accn array<string>, filed array<date>, report_date array<date>, form array<string>, document array<string>, items array<string>")
    rows = pit.filings(index)
    assert [r.released for r in pit.last_results(rows, "2020-12-31").collect()] == [d(2020, 1, 5)]
    assert [r.accn for r in pit.filings_between(rows, ["8-K"], "2020-01-01", "2020-12-31", 1).collect()] == ["b"]
    near = pit.value_near(cover.select("cik", "end", "val"), F.lit(d(2019, 12, 24)), 7, ["cik"]).collect()
    assert [(r.end, r.val) for r in near] == [(d(2019, 12, 20), 5.0)]
    sheets = spark.createDataFrame([(1, "cash", d(2020, 3, 31)), (1, "debt", d(2020, 6, 30)), (2, "debt", d(2020, 6, 30))], "cik int, concept string, end date")
    assert {r.cik: r.sheet for r in pit.sheet_date(sheets, [["equity", "cash"], ["debt"]]).collect()} == {1: d(2020, 3, 31), 2: d(2020, 6, 30)}


def test_books_of_a_strategy(spark):
    goal = spark.createDataFrame([("a", 0.5), ("b", -0.25), ("c", 0.5)], "ticker string, weight double")
    assert {r.ticker: r.weight for r in backtest.leg(goal, -1).collect()} == {"b": 0.25}
    days = spark.createDataFrame([(k, DAY + dt.timedelta(k)) for k in range(5)], "session int, date date")
    done = spark.createDataFrame([(1, 0.25), (1, 0.25), (3, 1.5)], "session int, weight double")
    rf = spark.createDataFrame([(DAY + dt.timedelta(2), 0.1), (DAY + dt.timedelta(4), 0.2)], "date date, rf double")
    assert [r.credit for r in backtest.cash_credit(done, days, rf).orderBy("session").collect()] == [0.0, 0.0, pytest.approx(0.05), pytest.approx(0.05), 0.0]
    levels = spark.createDataFrame([(DAY + dt.timedelta(k), 10.0 + k) for k in range(4)], "date date, level double")
    first = spark.createDataFrame([(DAY + dt.timedelta(2),)], "first date")
    assert [r.bench for r in backtest.benchmark_returns(levels, first).orderBy("date").collect()] == [0.0, pytest.approx(1 / 12)]
    assert spark.range(1).select(backtest.cost_drag_pct(F.lit(0.5), 12, 10.0).alias("x")).first().x == pytest.approx(1.2)
    states = spark.createDataFrame([(DAY, "a", 1), (DAY, "b", 0), (DAY, "c", -1), (DAY, "d", 1)], "date date, ticker string, state int")
    assert {r.ticker: r.weight for r in backtest.timing_weights(states).collect()} == {"a": 0.25, "b": 0.0, "c": -0.25, "d": 0.25}


def test_factor_helpers(spark):
    f = spark.createDataFrame([(1.0, 2.0)], "UMD double, mkt_rf double")
    assert factors.plain_names(f).columns == ["Mom", "MKT-RF"]
    rates = spark.createDataFrame([(dt.date(2020, 1, 3), 0.01), (dt.date(2020, 1, 9), 0.02), (dt.date(2020, 2, 1), None)], "date date, rf double")
    assert [(r.period, r.rf) for r in factors.finer_rate(rates, "month").collect()] == [(dt.date(2020, 1, 1), pytest.approx(1.01 * 1.02 - 1))]
    a = spark.createDataFrame([(k, float(k % 5)) for k in range(20)], "month int, hml double")
    got = factors.against_official(a, a, "hml").first()
    assert (got.n, round(got.correlation, 9)) == (20, 1.0)


def test_vendors_bars(spark):
    rows = [("aapl ", "2024-01-02", 10.0, 12.0, 9.0, 10.0, 5.0, 100.0, 0), ("aapl ", "2024-01-03", 20.0, 22.0, 18.0, 20.0, None, 50.0, 1), ("aapl ", "2024-01-03", 20.0, 22.0, 18.0, 21.0, None, 50.0, 0), ("aapl ", "2024-01-04", 30.0, 33.0, 28.0, 30.0, 30.0, 50.0, 0), ("aapl ", "2024-01-05", 40.0, 40.0, 40.0, float("nan"), None, 1.0, 0)]
    raw = spark.createDataFrame(rows, "Symbol string, Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume double, seq int")
    got = [tuple(r) for r in frames.normalised_bars(raw, order="seq").orderBy("date").collect()]
    d = dt.date
    assert got[:3] == [("AAPL", d(2024, 1, 2), 5.0, 6.0, 4.5, 5.0, 100.0, 10.0, 0.0), ("AAPL", d(2024, 1, 3), 20.0, 22.0, 18.0, 20.0, 50.0, 20.0, 0.0), ("AAPL", d(2024, 1, 4), 30.0, 33.0, 28.0, 30.0, 50.0, 30.0, 0.0)]
    assert got[3][2:4] == (40.0, 40.0) and got[3][5] is None and len(got) == 4
    flat = raw.where("seq = 1").drop("Symbol", "Adj Close", "seq")
    assert [tuple(r)[:3] for r in frames.normalised_bars(flat, "X").collect()] == [("X", d(2024, 1, 3), 20.0)]
    assert frames.normalised_bars(raw.where("false"), order="seq").columns == frames.empty_bars(spark).columns


def test_units_and_frames(spark):
    rows = spark.createDataFrame([("a", 5.0, 2.0), ("b", 5000.0, float("nan"))], "ticker string, capex double, pct double")
    units = {"capex_ttm": frames.Unit("capex", 1e6, negate=True, low=-1e8), "margin": frames.Unit("pct", 0.01), "none": frames.Unit("zzz")}
    assert [tuple(r) for r in frames.converted(rows, ["ticker"], units).orderBy("ticker").collect()] == [("a", -5e6, 0.02, None), ("b", None, None, None)]
    assert units["capex_ttm"].pushed(">=", 2e6) == ("<=", -2.0) and units["margin"].pushed(">", 0.5) == (">", 50.0)
    keys = spark.createDataFrame([("a",), ("c",), ("a",)], "ticker string")
    assert [tuple(r) for r in frames.reindexed(rows, keys, ["pct", "more"]).orderBy("ticker").collect()] == [("a", 2.0, None), ("c", None, None)]
    panel = spark.createDataFrame([(DAY, 1.0), (DAY + dt.timedelta(2), 2.0)], "date date, x double")
    more = spark.createDataFrame([(DAY, 9.0, 7.0), (DAY + dt.timedelta(1), 9.0, 8.0)], "date date, x double, y double")
    assert [r.x for r in frames.as_known(panel, "2024-01-02").collect()] == [1.0]
    assert [tuple(r)[1:] for r in frames.appended(panel, more, ["date"]).orderBy("date").collect()] == [(1.0, 7.0), (None, 8.0), (2.0, None)]


def test_citations(spark):
    at = lambda cited, digits, actual, kind: spark.range(1).select(verdicts.citation(F.lit(cited).cast("double"), F.lit(digits), F.lit(actual).cast("double"), kind).alias("s")).first().s
    assert at(1.2, 1, 1.2449, "other") == "verified" and at(1.3, 1, 1.2449, "other") == "mismatch" and at(1.0, 1, None, "t") == "not_found"
    assert at(2.0, 1, 1.96, "t") == "mismatch" and at(2.0, 1, 1.96, "other") == "verified" and at(0.0, 1, 0.04, "other") == "mismatch" and at(-2.1, 1, -2.1, "t") == "verified"
