import numpy as np

from claimloom.llm import ann as A


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def brute(vectors, k, every):
    ok = {i: np.array(v, float) for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % every == 0:
            c = [(-float(ok[q] @ x), i) for i, x in ok.items() if i != q and len(x) == len(ok[q])]
            out[q] = [i for _, i in sorted(c)[:k]]
    return ok, out


def run(spark, vectors, least, **how):
    df = table(spark, [(i, v, 0) for i, v in vectors.items()]).withColumnRenamed("label", "score")
    rows = A.nearest(df, **how).collect()
    ok, want = brute(vectors, how.get("k", 20), how.get("every", 20))
    got = {}
    for r in rows:
        assert r.vec_id != r.query_id and abs(r.score - float(ok[r.query_id] @ ok[r.vec_id])) < 1e-9
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q, best in want.items():
        mine = sorted(got.get(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & set(best))
        total += len(best)
    assert hits >= least * total, (hits, total)
    return got


def test_recall_on_random_and_clustered(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 24))
    x[700:] = x[:8][rng.integers(0, 8, 800)] + 0.2 * rng.standard_normal((800, 24))
    x *= rng.uniform(0.5, 2, 1500)[:, None]  # norms differ
    run(spark, {i: [float(v) for v in np.float32(r)] for i, r in enumerate(x)}, 0.9)


def test_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = {i: [float(v) for v in np.float32(rng.standard_normal(8))] for i in range(200)}
    for i in range(40, 140):
        vectors[i] = vectors[40]
    vectors |= {200: None, 220: [], 240: [0.0] * 8, 260: [float("nan")] + [1.0] * 7, 280: [float("inf")] + [1.0] * 7, 300: [None] + [1.0] * 7, 320: [1.0, 2.0], 321: [2.0, 1.0]}
    got = run(spark, vectors, 0.9)
    assert [i for _, i, _ in sorted(got[60])] == [i for i in range(40, 62) if i != 60][:20]
    assert [i for _, i, _ in got[320]] == [321]
    assert not {200, 220, 240, 260, 280, 300} & set(got)


def test_empty(spark):
    assert A.nearest(table(spark, [(1, [1.0, 0.0], 0)]).where("vec_id > 3")).collect() == []
    assert A.nearest(table(spark, [(0, [1.0, 0.0], 0)])).collect() == []


def test_rows_outside_tight_clusters(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 16))
    alone = np.arange(2000) % 20 == 0  # 5 %, the queries
    alone[:400:20] = False
    x[~alone] = x[:8][rng.integers(0, 8, (~alone).sum())] + 1e-3 * rng.standard_normal(((~alone).sum(), 16))
    vectors = {i: [float(v) for v in np.float32(r)] for i, r in enumerate(x)}
    got = run(spark, vectors, 0.95)
    _, want = brute(vectors, 20, 20)
    assert set(got) == set(want) and all(len(rows) == 20 for rows in got.values())
    recall = [len({i for _, i, _ in got[q]} & set(want[q])) / 20 for q in want]
    print("recall", np.mean(recall), min(recall), np.mean([r for q, r in zip(want, recall) if alone[q]]))
    assert min(recall) >= 0.75 and min(r for q, r in zip(want, recall) if alone[q]) == 1


def test_small_tables_give_all_candidates(spark):
    rng = np.random.default_rng(5)
    vectors = {i: [float(v) for v in np.float32(rng.standard_normal(4) * 10.0 ** rng.integers(-3, 1))] for i in range(21)}
    got = run(spark, vectors, 1)
    assert {q: len(rows) for q, rows in got.items()} == {0: 20, 20: 20}


def test_large_numbers_keep_their_order(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60, 5)) * 1e150
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in A.nearest(df, k=5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in (0, 20, 40):
        want = sorted(((-float(np.einsum("i,i->", x[q], x[i])), i) for i in range(60) if i != q))[:5]
        assert [got[q][j + 1] for j in range(5)] == [(i, -s) for s, i in want]
