import random
import re

import numpy as np
import pyarrow as pa

from claimloom.llm import _common as C
from claimloom.llm import neardup as N
from claimloom.llm import textkernel as K

from .util import docs_of

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def shingle_set(text, k):
    words = [w.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) for w in WORD.findall((text or "").encode())]
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def components(texts, k, percent):
    sets = [shingle_set(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(texts))]


def corpus(seed, groups=12, singles=30):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 6)))
    texts = [None, "", " \n\t", "one", "ONE", "one two", "one two", "é É é", "É é é"]
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([8, 40, 150, 600]))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.2 else w for w in copy))
    texts += [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(singles)]
    return texts


def test_words_and_shingles():
    texts = corpus(1)
    data, offs = C.col_bytes(pa.array(texts))
    for k in (3, 5):
        values, first = N._sets(data, offs, k)
        assert np.diff(first).tolist() == [len(shingle_set(t, k)) for t in texts]
    h, start, end, _ = K.words(data, offs, fold=False)
    got = [bytes(data[s:e]) for s, e in zip(start, end)]
    assert got == [w for t in texts for w in WORD.findall((t or "").encode())]
    assert len({*h.tolist()}) == len({*got})


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(2)
    for n, shared in ((1, 1), (7, 5), (300, 150), (5000, 4500)):
        pool = rng.integers(0, 1 << 62, 2 * n, dtype=np.int64).view(np.uint64)
        a, b = np.sort(pool[:n]), np.sort(pool[n - shared : 2 * n - shared])
        s = N.sketches(np.concatenate([a, b]), np.array([0, n, 2 * n]), 400)
        assert (s != np.iinfo(np.uint64).max).all()
        true = shared / (2 * n - shared)
        assert abs((s[0] == s[1]).mean() - true) < 0.12


def test_against_brute_force(spark):
    for seed, k, percent in ((3, 3, 85), (4, 5, 80)):
        texts = corpus(seed)
        sets, want = components(texts, k, percent)
        rows = N.near_duplicates(docs_of(spark, texts).withColumnRenamed("n_chars", "id").withColumnRenamed("lang", "component"), k=k, percent=percent).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert r.n_shingles == len(sets[r.doc_id])
            assert r.component_id == want[r.doc_id], (seed, r)
            assert r.kept == (want[r.doc_id] == r.doc_id)


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_DOCS", 3)
    texts = corpus(9, groups=4, singles=5)
    _, want = components(texts, 3, 85)
    rows = N.near_duplicates(docs_of(spark, texts), k=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(want))


def test_empty_and_repeated(spark):
    assert N.near_duplicates(docs_of(spark, ["a"]).where("doc_id > 3")).collect() == []
    df = docs_of(spark, ["a b c d e f", "x"])
    rows = N.near_duplicates(df.union(df)).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(0, 0), (0, 0), (1, 1), (1, 1)]
