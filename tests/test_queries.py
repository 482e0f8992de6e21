import pytest

from gristmill import catalog
from tests.oracle import connect, same

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, sf, duck, name):
    same(catalog.queries()[name](spark, sf), duck, SQL[name])


def test_every_query_without_sql_runs(spark, sf):
    for name, query in catalog.queries().items():
        if name not in SQL:
            assert query(spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
