"""Connected components: one task for few edges, star rounds for many."""

import random

import pytest

from claimloom.llm import _common as C


def reached(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("gathered", [C.GATHERED, 0])
def test_components(spark, monkeypatch, gathered):
    monkeypatch.setattr(C, "GATHERED", gathered)
    tables = []
    monkeypatch.setattr(C, "written", lambda df, name, *x, of=C.written, **y: tables.append(name) or of(df, name, *x, **y))
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1000, 1400)]  # a long path
    edges += [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    rng.shuffle(edges)
    rows = C.min_components(spark.createDataFrame(edges, "a long, b long").repartition(7), "x").collect()
    want = reached([(a, b) for a, b in edges if a != b])
    assert len(rows) == len(want) and {r.id: r.component for r in rows} == want
    if gathered:
        assert len(tables) == 2  # no rounds


def test_no_edges(spark):
    assert C.min_components(spark.createDataFrame([(1, 1)], "a long, b long"), "x").count() == 0
