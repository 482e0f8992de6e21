"""Factor portfolios against their SQL on one thread, where tied names lie at cut points: sums and cut points must agree to the last bit."""

import random

import pytest

import __spark_entry__
from gristmill.operators import factors
from gristmill.sources.tables import ordered_means
from tests import oracle

TIED = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def one_thread():
    c = oracle.connect(TIED)
    c.execute("set threads = 1")
    return c


@pytest.mark.parametrize("name", ["factors_2x3", "vw_portfolios", "smb_hml", "ff3_factors", "ff5_factors", "carhart4_factors"])
def test_as_sql_where_names_are_tied(spark, one_thread, name):
    assert oracle.same(__spark_entry__.queries()[name](spark, TIED), one_thread, __spark_entry__.oracle_sql()[name])


def test_means_follow_the_order_of_the_table(spark, tmp_path):
    """Rows of one group in many files: the mean is that of one sum in their order, however Spark reads them."""
    from datetime import datetime

    rng = random.Random(3)
    values = [rng.choice([0.1, 0.2, 0.3, 1e-17, 1e9]) for _ in range(400)]
    for k in range(8):
        rows = [(1, datetime(2000, 1, 3 + j % 5), v) for j, v in enumerate(values[50 * k : 50 * k + 50])]
        (spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet/part={k}"))
    total = 0.0
    for v in values:
        total += v
    from pyspark.sql import functions as F

    got = ordered_means(spark, str(tmp_path), "month", m=F.col("l_discount")).collect()
    assert [(r.ticker, str(r.date), r.m) for r in got] == [(1, "2000-01-01", total / 400)]


def test_quantile_between_neighbours(spark):
    """Between neighbours of one bit's distance the nearer one is the cut point."""
    low, high = 0.05, 0.05000000000000001
    rows = spark.createDataFrame([([low, high],), ([low, low, high],), ([1.0],), ([],)], "x array<double>")
    got = [tuple(r) for r in rows.select(*(factors.quantile("x", q) for q in (0.3, 0.5, 0.7))).collect()]
    assert got == [(low, high if (low + high) / 2 == high else low, high), (low, low, low), (1.0,) * 3, (None,) * 3]


def test_fused_quantile_as_in_sql(spark):
    """Cut points equal DuckDB's to the last bit, also between equal neighbours and ones a few bits apart."""
    import duckdb
    from pyspark.sql import functions as F

    rng = random.Random(7)
    kinds = [lambda b: b, lambda b: b + rng.choice([0, 1, 2, 3]) * 2.0**-55, lambda b: rng.uniform(-1e9, 1e9)]
    groups = [(g, [kinds[g % 3](b) for _ in range(rng.randint(1, 40))]) for g in range(1500) for b in [rng.uniform(0.01, 0.1)]]
    c = duckdb.connect()
    c.execute("create table t (g int, v double[])")
    c.executemany("insert into t values (?, ?)", groups)
    want = c.execute("select g, quantile_cont(x, 0.3), quantile_cont(x, 0.5), quantile_cont(x, 0.7) from (select g, unnest(v) as x from t) group by g order by g").fetchall()
    rows = spark.createDataFrame([*groups, (1500, []), (1501, None)], "g int, v array<double>").select("g", F.sort_array("v").alias("v"))
    got = [tuple(r) for r in rows.select("g", *(factors.quantile("v", q, True) for q in (0.3, 0.5, 0.7))).orderBy("g").collect()]
    assert got == [*want, (1500, None, None, None), (1501, None, None, None)]


@pytest.fixture(scope="module")
def twice(tmp_path_factory):
    """sf0.1 with every line of lineitem twice: names fall by the last bit of a cut point between neighbours a few bits apart."""
    import os

    d = tmp_path_factory.mktemp("twice")
    for name in os.listdir(TIED):
        if name != "lineitem.parquet":
            os.symlink(f"{TIED}/{name}", d / name)
    c = oracle.connect(TIED)
    c.execute("set threads = 1")
    c.execute(f"copy (select * from lineitem union all select * from lineitem) to '{d}/lineitem.parquet' (format parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["carhart4_factors", "ff3_factors", "ff5_factors", "smb_hml"])
def test_as_sql_where_cut_points_fall_between_bits(spark, twice, name):
    c = oracle.connect(twice)
    c.execute("set threads = 1")
    assert oracle.same(__spark_entry__.queries()[name](spark, twice), c, __spark_entry__.oracle_sql()[name])


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Folders of sf0.01 whose lines lack prices or quantities, so that the last week of a month has no price, or have some that are zero."""
    import os

    src, made = "/root/testdata/sf0.01", {}
    nth = lambda n: f"hash(l_orderkey, l_linenumber, l_extendedprice) % {n} = 0"
    for kind, price, quantity in (("missing", f"case when not {nth(3)} then l_extendedprice end", f"case when not {nth(5)} then l_quantity end"), ("zero", f"case when {nth(4)} then 0 else l_extendedprice end", f"case when {nth(1009)} then 0 else l_quantity end")):
        d = tmp_path_factory.mktemp(kind)
        for name in os.listdir(src):
            if name != "lineitem.parquet":
                os.symlink(f"{src}/{name}", d / name)
        c = oracle.connect(src)
        c.execute("set threads = 1")
        c.execute(f"copy (select * replace ({price} as l_extendedprice, {quantity} as l_quantity) from lineitem) to '{d}/lineitem.parquet' (format parquet)")
        made[kind] = str(d)
    return made


@pytest.mark.parametrize("kind", ["missing", "zero"])
@pytest.mark.parametrize("name", ["ff3_factors", "ff5_factors", "smb_hml"])
def test_as_sql_where_prices_are_missing_or_zero(spark, odd, kind, name):
    c = oracle.connect(odd[kind])
    c.execute("set threads = 1")
    assert oracle.same(__spark_entry__.queries()[name](spark, odd[kind]), c, __spark_entry__.oracle_sql()[name]) > 70


def test_quotient_as_in_sql(spark):
    import duckdb
    from pyspark.sql import functions as F

    from gristmill.functions.numbers import quotient

    nan, inf = float("nan"), float("inf")
    pairs = [(n, d) for n in (None, -2.0, 0.0, 3.0, inf, nan) for d in (None, 0.0, -4.0, 5.0, inf, nan)]
    got = [r[0] for r in spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, n double, d double").orderBy("k").select(quotient("n", F.col("d"))).collect()]
    want = [duckdb.execute("select ?::double / ?::double", p).fetchone()[0] for p in pairs]
    assert list(map(repr, got)) == list(map(repr, want))
