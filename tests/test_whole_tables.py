"""Searches over whole tables against brute force on a small fixture."""

import math
import string
from collections import Counter

import numpy as np
import pytest

from claimloom.operators import retrieval
from claimloom.plans import more_queries
from claimloom.plans import queries as plans


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lexical"))
    words = "river bank money loan tree leaf stone water fish boat".split()
    docs = [(i, " ".join(words[(i * k + k) % 10] for k in range(1, 4 + i % 5))) for i in range(90)]
    docs += [(101, "a telling passage about quartz, found nowhere else"), (102, ""), (103, None)]
    items = [(0, "telling passage about quartz"), (1, "river bank bank"), (2, "nothing matches here"), (43, "Loan; water fish")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(docs), dict(items)


def tokens(text):
    return (text or "").lower().translate(str.maketrans({c: " " for c in string.punctuation})).split()


def bm25(docs, items):
    t = {d: tokens(x) for d, x in docs.items()}
    n, mean, df = len(t), sum(map(len, t.values())) / len(t), Counter(w for x in t.values() for w in set(x))
    out = {}
    for i, q in items.items():
        for d, x in t.items():
            out[i, d] = round(sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / mean)) for w in tokens(q) if w in x), 6)
    return out


def best(scores, items, docs):
    return {(i, r + 1, d): s for i in items for r, (s, d) in enumerate((-s, d) for s, d in sorted((-scores[i, d], d) for d in docs)[:5])}


def test_bm25_searches_all_documents(spark, texts):
    folder, docs, items = texts
    got = {(r.item_id, r["rank"], r.doc_id): r.bm25 for r in plans.bm25_topk(spark, folder).collect()}
    assert got == pytest.approx(best(bm25(docs, items), items, docs), abs=2e-6)
    assert (0, 1, 101) in got  # the remainders of 0 and 101 by 40 differ


def test_bm25_fused_over_all_documents(spark, texts):
    folder, docs, items = texts
    raw, fused = bm25(docs, items), {}
    prior = {d: 1 / (1 + d) for d in docs}
    scale = lambda x, all_: 1.0 if max(all_) - min(all_) < 1e-12 else (x - min(all_)) / (max(all_) - min(all_))
    for i in items:
        mine = [raw[i, d] for d in docs]
        for d in docs:
            fused[i, d] = round(0.7 * scale(prior[d], prior.values()) + 0.3 * scale(raw[i, d], mine), 6)
    got = {(r.item_id, r["rank"], r.doc_id): r.fused for r in plans.bm25_fused(spark, folder).collect()}
    assert got == pytest.approx(best(fused, items, docs), abs=2e-6)


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("vectors"))
    rng = np.random.default_rng(3)
    x = np.float32(rng.standard_normal((130, 6)))
    x[7], x[60], x[121] = x[20], x[40], x[100]  # copies
    x = np.float32(x / np.linalg.norm(x, axis=1)[:, None])
    labels = [i % 10 for i in range(130)]
    spark.createDataFrame([(i, [float(v) for v in r], labels[i]) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(1, 20), (2, 40), (3, 40)], "p_partkey long, p_size int").write.parquet(f"{folder}/part.parquet")
    y = x.astype(float)
    return folder, np.round(y @ y.T, 6), labels


ASKED = [0, 20, 40, 60, 80, 100, 120]


@pytest.fixture(params=[4096, 25])
def blocks(request, monkeypatch):
    whole = retrieval.in_blocks
    monkeypatch.setattr(retrieval, "in_blocks", lambda q, x, schema, reduce: whole(q, x, schema, reduce, request.param))


def order(score, ids):
    return sorted(ids, key=lambda i: (-score[i], i))


def test_vector_queries_ask_every_twentieth_row(spark, vectors, blocks):
    folder, cos, labels = vectors
    bonus = [0.15, 0.10, 0.05, 0.0, -0.05]
    want, pinned = {}, {}
    for q in ASKED:
        policy = {i: round(cos[q, i] + bonus[labels[i] % 7] + 0.1 * (labels[i] == labels[q]), 6) for i in range(130) if labels[i] % 7 <= 4}
        want |= {(q, r + 1, i): policy[i] for r, i in enumerate(order(policy, policy)[:10])}
        pinned |= {(q, r + 1, i): cos[q, i] for r, i in enumerate(order(cos[q], range(130))) if r < 5 or i == q + 100}
    assert {(r.query_id, r["rank"], r.vec_id): r.policy_score for r in plans.vector_topk_policy(spark, folder).collect()} == pytest.approx(want, abs=2e-6)
    rows = plans.vector_topk_pinned(spark, folder).collect()
    assert len(rows) == len(pinned) and {(r.query_id, r["rank"], r.vec_id): r.cosine for r in rows} == pytest.approx(pinned, abs=2e-6)


def test_margins_batches_and_cascade_over_all_rows(spark, vectors, blocks):
    folder, cos, labels = vectors
    margin, batch, level = {}, {}, {}
    for q in ASKED:
        top = sorted(cos[q])[::-1]
        margin[q] = (top[0] - top[1]) / (top[0] - top[-1])
        first = order(cos[q], [i for i in range(130) if i != q])[0]
        batch[q] = first if cos[q, first] > 0.42 else None
        level[q] = 1 if q == 20 else 2 if cos[q, first] >= 0.8 else 3 if cos[q, first] >= 0.65 else 4
    assert {r.query_id: r.margin for r in plans.margin_gate(spark, folder).collect()} == pytest.approx(margin, abs=2e-6)
    assert {r.query_id: r.vec_id for r in plans.batch_search(spark, folder).collect()} == batch
    assert {r.query_id: r.level for r in plans.lookup_cascade(spark, folder).collect()} == level


def test_audit_asks_every_row(spark, vectors, blocks):
    folder, cos, labels = vectors
    best = [order(cos[q], range(130))[0] for q in range(130)]
    r = more_queries.self_retrieval_audit(spark, folder).collect()[0]
    assert (r.queries, r.found, r.same_class) == (130, sum(b == q for q, b in enumerate(best)), sum(labels[b] == labels[q] for q, b in enumerate(best)))
    assert r.found < 130  # a copy finds the smaller id
