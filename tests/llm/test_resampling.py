import math
import random
import re

import numpy as np

from claimloom.llm import resampling as R

from .util import docs_of


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    texts, quality = [], []
    for _ in range(n):
        q = int(rng.random() < 0.7)
        texts.append(" ".join(rng.choice(good if q or rng.random() < 0.2 else bad) for _ in range(rng.randint(5, 60))))
        quality.append(q)
    return texts, quality


def grams(text):
    w = re.findall(r"[a-z0-9]+", (text or "").lower())
    return w + list(zip(w, w[1:]))


def test_weights_against_exact_models(spark):
    texts, quality = corpus()
    texts += [None, ""]
    target = [i for i, q in enumerate(quality) if q and i % 2]
    df = docs_of(spark, texts).withColumnRenamed("lang", "rank").withColumnRenamed("n_chars", "_all")
    t = spark.createDataFrame([(i,) for i in target], "doc_id long")
    buckets = 1 << 22  # so wide that no two n-grams meet
    rows = {r.doc_id: r for r in R.resample(df, t, 0.5, buckets=buckets).collect()}
    raw, own = {}, {}
    for i, x in enumerate(texts):
        for g in grams(x):
            raw[g] = raw.get(g, 0) + 1
            if i in set(target):
                own[g] = own.get(g, 0) + 1
    close = []
    n_raw, n_own = sum(raw.values()) + buckets, sum(own.values()) + buckets
    for i, x in enumerate(texts):
        want = sum(math.log((own.get(g, 0) + 1) / n_own) - math.log((raw[g] + 1) / n_raw) for g in grams(x))
        close.append(abs(rows[i].log_weight - want) < 1e-6)
    assert np.mean(close) > 0.9  # a few of the n-grams still meet
    order = sorted(rows.values(), key=lambda r: (-r.sample_key, r.doc_id))
    assert [r.sample_rank for r in order] == list(range(1, len(texts) + 1))
    assert sum(r.kept for r in rows.values()) == round(0.5 * len(texts)) and all(r.kept for r in order[: round(0.5 * len(texts))])


def test_junk_goes_first(spark):
    texts, quality = corpus(2)
    t = spark.createDataFrame([(i,) for i, q in enumerate(quality) if q and i % 2], "doc_id long")
    rows = {r.doc_id: r.kept for r in R.resample(docs_of(spark, texts), t, 0.7).collect()}
    held = [i for i in range(len(texts)) if i % 2 == 0]
    assert np.mean([rows[i] == bool(quality[i]) for i in held]) > 0.9


def test_gumbel_samples_in_proportion():
    ids = np.arange(200_000, dtype=np.int64)
    weight = np.where(ids % 2 == 0, np.log(3.0), 0.0)
    u = weight + R.gumbel(ids, 3)
    pairs = u.reshape(-1, 2)
    assert abs((pairs[:, 0] > pairs[:, 1]).mean() - 0.75) < 0.01


def test_empty_and_no_target(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert R.resample(docs_of(spark, ["a"]).where("doc_id > 3"), none, 0.5).collect() == []
    rows = R.resample(docs_of(spark, ["a b", "c", None]), none, 1.0).collect()
    assert all(r.log_weight == 0 and r.kept for r in rows)
