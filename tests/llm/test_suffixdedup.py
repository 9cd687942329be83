import random

import numpy as np

from claimloom.llm import suffixdedup as S

from .util import docs_of


def brute(texts, n):
    """{index: (spans, kept)} by a dictionary of all n-byte strings."""
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - n + 1):
            w = b[j : j + n]
            if w in seen:
                gone[j : j + n] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out[i] = list(zip(edge[::2].tolist(), edge[1::2].tolist())), bytes(np.frombuffer(b, np.uint8)[~gone])
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcé \n") for _ in range(k))
    passages = [text(rng.randint(n - 3, 4 * n)) for _ in range(6)]
    texts = [None, "", "ab", "a" * (3 * n), "ab" * (2 * n), "xyz" * n + "a" * n]
    for _ in range(40):
        parts = [text(rng.randint(0, 2 * n)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(1, 6))]
        texts.append("".join(parts))
    for _ in range(25):
        t = list(rng.choice(texts[6:]))
        for _ in range(rng.randint(0, 3)):
            if t:
                t[rng.randrange(len(t))] = rng.choice("XYZ")
        texts.append("".join(t))
    return texts


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(1)
    for n, top in ((0, 3), (1, 3), (2, 3), (3, 2), (10, 2), (200, 2), (1000, 4), (999, 1), (1001, 250)):
        s = rng.integers(1, top + 1, n)
        want = sorted(range(n), key=lambda i: s[i:].tolist())
        assert S.suffix_array(s).tolist() == want
    big = rng.integers(1, 1 << 40, 500)
    assert S.suffix_array(big).tolist() == sorted(range(500), key=lambda i: big[i:].tolist())


def check(spark, texts, n, context, **frame):
    want = brute(texts, n)
    df = docs_of(spark, texts, **frame).withColumnRenamed("n_chars", "kept").withColumnRenamed("lang", "bucket")
    rows = S.cut_repeats(df, n, context).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans, kept = want[r.row.doc_id]
        assert [(s.start, s.stop) for s in r.spans] == spans, (r.row.doc_id, texts[r.row.doc_id])
        assert bytes(r.kept) == kept and r.n_bytes == len((texts[r.row.doc_id] or "").encode())


def test_against_brute_force(spark):
    check(spark, corpus(5, 100), 100, 40)


def test_short_windows_small_chunks_and_salts(spark, monkeypatch):
    check(spark, corpus(6, 20), 20, 6)


def test_kernels_in_small_chunks():
    texts = [t or "" for t in corpus(7, 30)]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    windows = {}
    old = S.CHUNK
    for chunk in (old, 64):
        S.CHUNK = chunk
        seen = {}
        for text, lo, count, h, nh in S.anchors(data, offs, 30, 11):
            for t, a, k, x in zip(text.tolist(), lo.tolist(), count.tolist(), h.tolist()):
                for j in range(a, a + k):
                    assert (t, j) not in seen
                    seen[t, j] = x
        S.CHUNK = old
        assert len(seen) == sum(max(0, len(x) - 29) for x in raw)
        by = {}
        for (t, j), x in seen.items():
            assert by.setdefault(raw[t][j : j + 30], x) == x  # equal windows, equal anchors
        windows[chunk] = seen
    assert windows[old] == windows[64]


def test_sorting_groups_with_salts():
    rng = random.Random(8)
    pool = ["".join(rng.choice("ab") for _ in range(30)) for _ in range(6)]
    texts = [("".join(rng.choice(pool) for _ in range(3)))[: rng.randint(25, 60)].encode() for _ in range(60)]
    seg = np.zeros(60, S.SEGMENT)
    seg["h"], seg["doc"], seg["n"], seg["salts"] = 5, np.arange(60), [len(t) - 19 for t in texts], 2
    (gone, left), = S._sort_groups(seg, texts, 20)
    seen, want = set(), set()
    for d, t in enumerate(texts):
        for j in range(len(t) - 19):
            if t[j : j + 20] in seen:
                want.add((d, j))
            seen.add(t[j : j + 20])
    assert {(int(r["doc"]), int(r["lo"]) + j) for r in gone for j in range(r["n"])} == want
    assert len(left[0]) == len(seen) == len({*zip(left[0].tolist(), left[1].tolist())})


def test_salted_hash_end_to_end(spark, monkeypatch):
    # the functions travel by value here, so that the workers see the smaller salt
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(S)
    monkeypatch.setattr(S, "SALT_SEGMENTS", 2)
    try:
        check(spark, corpus(10, 40), 40, 12)
    finally:
        cloudpickle.unregister_pickle_by_value(S)


def test_empty_and_repeated_rows(spark):
    assert S.cut_repeats(docs_of(spark, ["a"]).where("doc_id > 5")).collect() == []
    df = docs_of(spark, ["q" * 50 + "".join(map(str, range(90))), "z"])
    rows = S.cut_repeats(df.union(df)).collect()
    assert len(rows) == 4 and all(not r.spans for r in rows)


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    rng = random.Random(13)
    text = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    shared, other = text(150), text(150)
    rows = [(3, text(200) + shared), (None, text(250) + shared + text(60)), (None, text(700)), (None, text(90) + other), (4, other + text(40))]
    rows += [(5, text(300) + other), (5, text(400)), (-2, text(120)), (None, "z" * 40 + text(100)), (2**63 - 1, text(300) + shared)]
    rows += [(None, rows[2][1])]
    df = spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, whole string").repartition(3)
    # texts that share an id share nothing, but one pair of equal texts, so the order among them does not tell
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    want = brute([t for _, t in order], 100)
    want = sorted((str(i), t, *map(str, want[j])) for j, (i, t) in enumerate(order))
    got = S.cut_repeats(df, 100, 32).collect()
    assert sorted((str(r.row.doc_id), r.row.whole, str([(s.start, s.stop) for s in r.spans]), str(bytes(r.kept))) for r in got) == want
    assert sum(len(r.spans) for r in got) == 5
