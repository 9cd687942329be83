import math
import random
from collections import defaultdict

from claimloom.llm import mixing as M

from .util import docs_of


def test_targets_share_and_cap():
    t = M.targets({"a": 100, "b": 100, "c": 10, None: 50})
    assert abs(sum(t.values()) - 390) < 1e-9
    assert all(t[s] <= 2 * n + 1e-9 for s, n in {"a": 100, "b": 100, "c": 10, None: 50}.items())
    assert t["c"] == 20
    # None is fourth: weights 3, 1, 2, 3; a and None are both full, b takes the rest
    assert t["a"] == 200 and t[None] == 100 and abs(t["b"] - 70) < 1e-9


def test_mix_against_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join("w" for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts[7], texts[8] = None, " \t\n"
    sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in texts]
    rows = M.mix(docs_of(spark, texts, sources).withColumnRenamed("n_chars", "rank")).collect()
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    total = defaultdict(int)
    for i, s in enumerate(sources):
        total[s] += size[i]
    goal = M.targets(dict(total))
    assert len(rows) == len(texts)
    taken = defaultdict(int)
    by_source = defaultdict(list)
    for i, s in enumerate(sources):
        by_source[s].append((size[i], i))
    want = {}
    for s, items in by_source.items():
        each, first = goal[s] / total[s], M.offset_of(s)
        for n, (_, i) in enumerate(sorted(items)):
            want[i] = math.floor(first + each * (n + 1)) - math.floor(first + each * n)
    for r in rows:
        assert r.size == size[r.doc_id] and r.copies == want[r.doc_id] <= 2
        assert r.source_size == total[r.source] and abs(r.target - goal[r.source]) < 1e-9
        taken[r.source] += r.copies * r.size
    for s, n in taken.items():
        assert abs(n - goal[s]) <= 40
    again = {r.doc_id: r.copies for r in M.mix(docs_of(spark, texts, sources, parts=7)).collect()}
    assert again == {r.doc_id: r.copies for r in rows}


def test_mix_blank_and_empty(spark):
    assert all(r.copies == 0 for r in M.mix(docs_of(spark, [None, ""], ["a", None])).collect())
    assert M.mix(docs_of(spark, ["x"]).where("doc_id < 0")).collect() == []


def test_mixed_documents_repeat_rows(spark):
    df = docs_of(spark, ["a b"] * 6 + ["c"] * 6, ["x"] * 6 + ["y"] * 6)
    df = df.union(df.where("doc_id = 3"))
    copies = {}
    for r in M.mix(df).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    got = defaultdict(int)
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    for r in out.collect():
        got[r.doc_id] += 1
    assert {k: v for k, v in copies.items() if v} == dict(got)
