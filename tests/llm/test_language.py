import random
import zlib

import numpy as np
import pyarrow as pa

from claimloom.llm import language as L

from .util import docs_of, save

STEMS = {"xa": ["the", "and", "ing", "tion", "was"], "xb": ["der", "und", "ung", "keit", "schö"], "xc": ["les", "été", "eux", "que", "ment"]}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    texts, langs = [], []
    for _ in range(n):
        lang = rng.choice(list(STEMS))
        texts.append(" ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(2, 80))).title())
        langs.append(lang)
    return texts, langs


def test_presence_kernel_against_sets():
    texts = ["The cat!! 12 sat", "", "été Été", "a", "x" * 50]
    sets = []
    for t in texts:
        kept = bytes(L._LETTER[np.frombuffer(t.lower().encode(), np.uint8)]) if t else b""
        while b"  " in kept:
            kept = kept.replace(b"  ", b" ")
        sets.append({kept[i : i + n] for n in (1, 2, 3) for i in range(len(kept) - n + 1)})
    codes = {g: int.from_bytes(g, "big") | ((len(g) - 1) << 24) for s in sets for g in s}
    vocabulary = np.array(sorted(codes.values()), np.int32)
    got = np.vstack([x for _, x in L.presence(L.lowered(pa.array(texts)), L.code_index(vocabulary), len(vocabulary))])
    for i, s in enumerate(sets):
        assert {*vocabulary[got[i] > 0].tolist()} == {codes[g] for g in s}
    k = L.kernel(got, got)
    assert abs(k[0, 2] - len(sets[0] & sets[2]) / (len(sets[0]) * len(sets[2])) ** 0.5) < 1e-5


def test_held_out_accuracy_and_edges(spark, tmp_path):
    texts, langs = corpus()
    n = len(texts)
    texts += [None, "", "12 34 !?", "Ünd", "the and " * 40_000]
    df = docs_of(spark, texts, langs=dict(enumerate(langs)) | {n: "xa", n + 3: None}).withColumnRenamed("n_chars", "score")
    rows = {r.doc_id: r for r in L.op5_language_id(spark, save(df, tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    right = [rows[i].lang_pred == langs[i] for i in range(n) if rows[i].held_out]
    assert len(right) > 30 and np.mean(right) > 0.95
    assert [rows[n + j].lang_pred for j in range(3)] == ["und"] * 3 and rows[n].score == 0
    assert rows[n + 4].lang_pred == "xa"


def test_strips_give_exactly_the_n_grams_of_whole_texts(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefg    .,é", k=k)) for k in (5000, 0, 3, 99, 250)] + ["a" + " " * 700 + "b", " " * 300, "x" * 100 + " " * 101 + "yz"]
    sets = [np.unique(L.grams(*L.collapsed(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])))[0]) if t else [] for t in texts]
    vocabulary = np.unique(np.concatenate(sets)).astype(np.int32)
    index = L.code_index(vocabulary)
    for size in (L.SLICE, 100, 7):
        monkeypatch.setattr(L, "SLICE", size)
        got = np.zeros((len(texts), len(vocabulary)))
        for a, x in L.presence(pa.array(texts), index, len(vocabulary)):
            got[a : a + len(x)] = x
        for i, s in enumerate(sets):
            assert vocabulary[got[i] > 0].tolist() == list(s), (size, i)


def test_nystrom_on_all_landmarks_is_kernel_ridge_regression():
    texts, langs = corpus(60, 3)
    names, vocabulary, marks, dual, bias = L.fit(texts, langs, landmarks=len(texts), min_df=1)
    index = L.code_index(vocabulary)
    x = np.vstack([m for _, m in L.presence(L.lowered(pa.array(texts)), index, len(vocabulary))]).astype(float)
    norm = np.sqrt(x.sum(1))
    k = (x @ x.T) / norm[:, None] / norm[None, :]
    # weighted kernel ridge regression with a penalised bias is the same kernel plus one
    weight = np.array([len(langs) / langs.count(n) for n in langs])
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    alpha = np.linalg.solve(k + 1 + np.diag(L.RIDGE * len(texts) / 100 / weight), y)
    want = (k + 1) @ alpha
    got = L.kernel(x.astype(np.float32), marks.astype(np.float32)) @ dual + bias
    assert np.abs(got - want).max() < 1e-3


def test_nothing_to_learn(spark, tmp_path):
    df = docs_of(spark, ["a", "b"], langs={0: None, 1: None})
    assert [r.lang_pred for r in L.op5_language_id(spark, save(df, tmp_path / "a")).collect()] == ["und", "und"]
    assert L.op5_language_id(spark, save(df.where("doc_id > 4"), tmp_path / "b")).collect() == []
