import datetime as dt

import numpy as np
import pytest

from gristmill.operators import book, portfolio
from gristmill.streaming import ledger

DAY = dt.date(2024, 1, 1)
BARS = "ticker string, date date, close double"


def test_gaps_against_a_day_by_day_book(spark):
    rng = np.random.default_rng(3)
    n, names = 80, 6
    ds = [DAY + dt.timedelta(k) for k in range(n)]
    px = 30 * np.exp(np.cumsum(rng.normal(0, 0.04, (n, names)), axis=0))
    gone = np.zeros((n, names), bool)
    gone[10:14, 0] = gone[30:33, 1] = gone[31, 2] = gone[50:, 3] = gone[:5, 4] = True  # halts, a delisting, a late listing
    raw = np.where(gone, np.nan, px)
    when, rate, dr = [3, 12, 29, 30, 45, 60], 30 / 1e4, -0.4
    goals = {i: rng.dirichlet(np.ones(names)) * rng.choice([1.0, 1.0, -0.3], names) for i in when}
    last = np.array([np.flatnonzero(~gone[:, k]).max() for k in range(names)])
    want, w, mark, dead = {}, np.zeros(names), np.full(names, np.nan), np.zeros(names, bool)
    for i in range(n):
        gross = 0.0
        new = np.where(np.isfinite(raw[i]), raw[i], mark)
        if i > 4:
            growth = np.where(w != 0, new / mark - 1, 0)
            growth = np.where((i > last) & ~dead & (w != 0), (1 + growth) * (1 + dr) - 1, growth)
            dead |= i > last
            gross = float(w @ growth)
            w = w * (1 + growth) / (1 + gross)
        mark = new
        cost, turn = 0.0, None
        if i - 1 in goals:
            w = np.where(dead, 0, w)
            goal = np.where(np.isfinite(raw[i]), goals[i - 1], 0)
            stuck = np.where((w != 0) & ~np.isfinite(raw[i]), w, 0)
            traded = np.abs(goal - (w - stuck)).sum()
            cost, turn = traded * rate, traded / 2
            w = goal + stuck * (1 + gross) / (1 + gross - cost)
        if i >= 4:
            want[i] = (gross, gross - cost, turn)
    bars = spark.createDataFrame([(str(k), ds[i], float(px[i, k])) for i in range(n) for k in range(names) if not gone[i, k]], BARS)
    targets = spark.createDataFrame([("b", ds[i], str(k), float(g[k])) for i, g in goals.items() for k in range(names)], "book string, signal_date date, ticker string, weight double")
    got = {r.session: (r.gross, r.net, r.turnover) for r in book.simulate_gaps(targets, bars, 30.0, 1, dr).collect()}
    assert set(got) == set(want)
    for i, row in want.items():
        assert got[i][:2] == pytest.approx(row[:2], abs=1e-12), i
        assert (got[i][2] is None or np.isnan(got[i][2])) if row[2] is None else got[i][2] == pytest.approx(row[2], abs=1e-12), i


def test_ruin(spark):
    bars = spark.createDataFrame([(t, DAY + dt.timedelta(k), p) for t, ps in {"A": [10.0] * 5, "B": [10.0, 10.0, 25.0, 25.0, 5.0]}.items() for k, p in enumerate(ps)], BARS)
    t = [("b", DAY, "A", 0.0), ("b", DAY, "B", -1.0)]
    targets = spark.createDataFrame(t, "book string, signal_date date, ticker string, weight double")
    got = [r.gross for r in book.simulate_gaps(targets, bars, 0.0).orderBy("session").collect()]
    assert got == [0.0, -1.0, 0.0, 0.0]
    daily, _ = portfolio.simulate(targets.drop("book"), bars, 0.0)
    assert [r.gross for r in daily.orderBy("session").collect()] == [0.0, -1.0, 0.0, 0.0]


def test_rebalancing_pays_its_costs():
    a = ledger.Account(1000.0)
    orders = ledger.rebalance(a, "2024-01-01", {"A": 0.5, "B": 0.5}, {"A": 10.0, "B": 20.0}, costs_bps=100.0)
    nav = 1000 / 1.01
    assert [(t, round(n, 4)) for t, n, _, _ in orders] == [("A", round(nav / 20, 4)), ("B", round(nav / 40, 4))]
    assert a.nav() == pytest.approx(nav, abs=1e-3) and abs(a.cash) < 1e-3
    assert ledger.rebalance(a, "2024-01-01", {"A": 1.0}, {"A": 10.0, "B": 20.0}) == []  # booked already
    orders = ledger.rebalance(a, "2024-01-02", {"A": 1.0}, {"A": 10.0, "B": float("nan")})
    assert a.positions["B"] == pytest.approx(nav / 40, abs=1e-3) and [t for t, *_ in orders] == ["A"]  # B can't be sold
    whole = ledger.Account(100.0)
    ledger.rebalance(whole, "1", {"A": 1.0}, {"A": 30.0}, costs_bps=0.0, whole_shares=True)
    assert whole.positions == {"A": 3.0}


def test_stream_is_the_fold(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(a, DAY + dt.timedelta(k), t, 0.4, float(rng.uniform(5, 50))) for a in "xy" for k in range(6) for t in ("A", "B")]
    schema = "account string, date date, ticker string, weight double, price double"
    days = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, ledger.fold(days, 1e4).collect()))
    for k in range(6):
        days.where(days.date == DAY + dt.timedelta(k)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = ledger.stream(source, 1e4).writeStream.format("memory").queryName("orders").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = sorted(map(tuple, spark.table("orders").collect()))
    assert len(got) == len(want) and all(a[:3] == b[:3] and a[3:] == pytest.approx(b[3:]) for a, b in zip(got, want))
