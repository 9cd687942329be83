"""Queries over parts against DuckDB where parts come in many copies, or have nothing to report."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from claimloom.operators import classes
from claimloom.plans import queries as plans

COLUMNS = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@pytest.fixture
def tables(spark, tmp_path):
    def write(**named):
        for name, (rows, columns) in named.items():
            spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def same(spark, folder, name):
    """The query's rows are those of its SQL; returns them with the frame that was executed."""
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        if os.path.isdir(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, folder)
    want = con.sql(plans.ORACLE_SQL[name])
    order = [df.columns.index(c) for c in want.columns]
    rows = df.collect()
    assert sorted((tuple(r[i] for i in order) for r in rows), key=repr) == sorted(want.fetchall(), key=repr)
    return rows, df


def test_alignment_without_gaps(spark, tables):
    parts = [(i, "red bolt", b, t, s, 900.0) for i, (b, t, s) in enumerate([("x", "A", 1), ("y", "A", 1), ("z", "A", 2), ("z", "A", 1)])]
    rows, _ = same(spark, tables(part=(parts, COLUMNS)), "alignment_report")
    assert {(r.left_id, r.right_id): r.gaps for r in rows} == {("x", "y"): None, ("y", "x"): None, ("x", "z"): None, ("y", "z"): None, ("z", "x"): "size", ("z", "y"): "size"}


def most_rows(df, kind=""):
    """The most rows that came out of one node of the executed plan whose name holds ``kind``."""

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        rows = node.metrics().get("numOutputRows")
        below = node.children()
        return max([rows.get().value() if rows.isDefined() and kind in name else 0, *[walk(below.apply(i)) for i in range(below.size())]])

    return walk(df._jdf.queryExecution().executedPlan())


def copies(n, names=("red bolt", "old gear")):
    """n parts that differ in little but their keys."""
    return [(i, names[i % len(names)], "Brand#1", ("SMALL", "LARGE")[i % 2], 1 + i % 3, 900.0) for i in range(n)]


def test_aliases_of_copies(spark, tables):
    rows, df = same(spark, tables(part=(copies(1200), COLUMNS)), "alias_lookup")
    assert len(rows) == 60
    assert most_rows(df, "Join") <= 3 * 1200  # not 60 x 600


def test_lookups_of_copies(spark, tables):
    lines = [(i % 700, i % 7, (i % 11) / 100) for i in range(2000)]
    rows, df = same(spark, tables(part=(copies(1200), COLUMNS), lineitem=(lines, "l_partkey long, l_suppkey long, l_discount double")), "batch_lookup")
    assert len(rows) == 1200 and {r.score for r in rows} >= {0.5, 0.1}
    assert most_rows(df, "Join") <= 1200  # not 1200 x 200


def test_overlap_of_copies(spark, tables, monkeypatch):
    monkeypatch.setattr(classes, "MOST", 50)
    odd = [(2000, "cold hot", "Brand#1", "SMALL", 2, 900.0), (2001, None, "Brand#1", "SMALL", 2, 900.0), (None, "red bolt", "Brand#2", "SMALL", 2, 900.0)]
    rows, df = same(spark, tables(part=(copies(1200) + odd, COLUMNS)), "slot_overlap")
    assert len(rows) == 60 * 400 + 20 * 3 + 403
    assert most_rows(df, "Join") < 2000  # pairs of classes, in pieces of about 50 rows


def test_conflicts_of_copies(spark, tables, monkeypatch):
    monkeypatch.setattr(classes, "MOST", 50)
    names = ("hot rod", "cold gear", "a b", "c SMALL", "new bolt", "old cold")
    parts = [(i, names[i % 6], "Brand#1", ("SMALL", "LARGE")[i % 5 % 2], 1 + i % 7, 900.0) for i in range(600)]
    rows, df = same(spark, tables(part=(parts + [(None, "hot rod", "Brand#1", "SMALL", 1, 900.0), (601, "hot rod", None, "SMALL", 1, 900.0)], COLUMNS)), "wisdom_conflicts")
    assert {r.kind for r in rows} == {"action_inversion", "state_exclusion", "trigger_contradiction"}
    assert most_rows(df, "Join") < 5000 < len(rows)


def test_cascade_of_copies(spark, tables, monkeypatch):
    monkeypatch.setattr(classes, "MOST", 7)
    parts = [(i, ("red bolt", "old gear", "small x")[i % 3], "Brand#1", ("SMALL", "LARGE")[i % 2], 1 + i % 8, 900.0) for i in range(2400)]
    rows, df = same(spark, tables(part=(parts, COLUMNS)), "wisdom_cascade")
    assert {r.gate for r in rows} == {"APPLIES", "UNCERTAIN"}
    assert most_rows(df) < 15000  # not 120 x 2400
