"""Every query that SQL can express against DuckDB on the smallest standard tables."""

import os

import pytest

import __spark_entry__ as entry
from claimloom.plans import queries as plans

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no standard tables here")
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name not in plans.ORACLE_SQL:
        return
    want = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    order = [df.columns.index(c) for c in want.columns]
    ours = sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)
    theirs = sorted((tuple(norm(v) for v in r) for r in want.fetchall()), key=repr)
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
