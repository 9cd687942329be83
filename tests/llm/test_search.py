import math
import random
import re
from collections import Counter

import numpy as np

from claimloom.llm import search as S

from .util import docs_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, queries, k):
    docs = [Counter(terms(t)) for t in texts]
    sizes = [sum(d.values()) for d in docs]
    mean, n = sum(sizes) / len(sizes), len(texts)
    out = {}
    for q, text in queries:
        scores = []
        for i, d in enumerate(docs):
            s, hit = 0.0, False
            for t, times in Counter(terms(text)).items():
                if d[t]:
                    hit = True
                    df = sum(t in x for x in docs)
                    s += times * math.log((n - df + 0.5) / (df + 0.5) + 1) * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * sizes[i] / mean))
            if hit:
                scores.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(120)] + ["É", "the", "THE"]
    pick = lambda k: " ".join(words[min(int(rng.expovariate(0.05)), 122)] + rng.choice(["", ",", "!"]) for _ in range(k))
    texts = [None, "", "..."] + [pick(rng.randint(1, 80)) for _ in range(600)]
    texts += [texts[10]] * 30
    queries = [(j, pick(rng.randint(1, 12))) for j in range(25)] + [(90, None), (91, "zzz"), (92, "the the É")]
    want = brute(texts, queries, 7)
    q = spark.createDataFrame(queries, "item_id long, text string")
    df = docs_of(spark, texts).withColumnRenamed("n_chars", "score").withColumnRenamed("lang", "query_id")
    got = {}
    for r in S.top_k(df, q, k=7).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.doc_id, r.score)
    for j, best in want.items():
        mine = [got.get(j, {})[i + 1] for i in range(len(got.get(j, {})))]
        assert [d for d, _ in mine] == [d for d, _ in best], j
        assert np.allclose([s for _, s in mine], [s for _, s in best], atol=2e-6)


def test_wand_skips_documents_and_loses_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    n_docs, n_terms = 5000, 30
    cells = np.sort(rng.choice(n_docs * n_terms, 40_000, replace=False))
    term, doc = cells // n_docs, cells % n_docs
    impact = np.round(rng.exponential(1, len(cells)) * (1 + (doc < 200) * 5), 1)  # with many ties
    first = np.searchsorted(term, np.arange(n_terms + 1))
    for round_ in range(20):
        asked = rng.choice(n_terms, rng.integers(1, 7), replace=False)
        weight = rng.integers(1, 3, len(asked)).astype(float)
        shard = S.Shard(first, doc, impact, n_docs)
        full, met = np.zeros(n_docs), np.zeros(n_docs, bool)
        for t, w in zip(asked, weight):
            full[doc[first[t] : first[t + 1]]] += w * impact[first[t] : first[t + 1]]
            met[doc[first[t] : first[t + 1]]] = True
        full = np.where(met, np.round(full, 6), -1)
        want = np.lexsort((np.arange(n_docs), -full))[:5]
        found, scores = S.wand(shard, asked, weight, S.Best(5))
        assert found.tolist() == want.tolist() and np.allclose(scores, full[want])
        # a task that has seen better documents finds only what reaches them
        high = S.Best(5)
        high.add(np.full(5, full[want][2]))
        found, scores = S.wand(shard, asked, weight, high)
        assert set(want[full[want] > full[want][2]]) <= set(found.tolist())


def test_an_index_serves_many_searches_and_queries_go_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(40)], k=rng.randint(0, 30))) for _ in range(200)]
    df = docs_of(spark, texts)
    index = S.build_index(df)
    monkeypatch.setattr(S, "QUERIES", 3)
    for seed in (1, 2):
        queries = [(j, " ".join(random.Random(seed * 100 + j).choices([f"w{i}" for i in range(45)], k=4))) for j in range(8)]
        want = brute(texts, queries, 5)
        got = {}
        for r in S.top_k(df, spark.createDataFrame(queries, "item_id long, text string"), k=5, index=index).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.score))
        assert {q: [d for d, _ in x] for q, x in got.items()} == {q: [d for d, _ in x] for q, x in want.items() if x}


def test_null_ids_and_long_texts(spark):
    rows = [(None, "alpha beta"), (3, "alpha beta"), (None, "alpha beta"), (2, "beta " * 300_000), (2**60 + 1, "alpha beta"), (2**60, "alpha beta")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    q = spark.createDataFrame([(1, "alpha"), (None, "beta")], "item_id long, text string")
    got = [(r.rank, r.doc_id) for r in S.top_k(df, q).orderBy("rank").collect()]
    assert got == [(1, None), (2, None), (3, 3), (4, 2**60), (5, 2**60 + 1)]


def test_empty(spark):
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert S.top_k(docs_of(spark, ["a"]).where("doc_id > 2"), q).collect() == []
    assert S.top_k(docs_of(spark, ["a"]), q.where("item_id > 3")).collect() == []
