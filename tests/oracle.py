"""Runs SQL with DuckDB over the tables of a folder and compares rows."""

import datetime
import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "none"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.6g}"
    return str(v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


def same(frame, c, sql):
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    q = c.execute(sql)
    names = [d[0] for d in q.description]
    want = rows(names, q.fetchall())
    assert sorted(frame.columns) == sorted(names)
    assert got == want
    return len(got)
