import random

import numpy as np

from claimloom.llm import toxicity as X

from .util import docs_of


def corpus(n=500, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    vocabulary = [word() for _ in range(300)]
    texts, grades = [], []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 200))]
        g = rng.choice([0, 0, 0, 1, 2])
        for _ in range({0: 0, 1: 1, 2: 4}[g]):
            words.insert(rng.randrange(len(words)), rng.choice(["zidiot,", "ZMORON", "zfool!", "%zoaf%"]))
        texts.append(" ".join(words))
        grades.append(g)
    return texts, grades


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (4000, 3)).astype(float)
    z = x @ np.array([3.0, -2.0, 0.0]) + rng.logistic(size=4000)
    grade = (z > 0.5).astype(int) + (z > 2.5)
    w, theta = X.fit_ordinal(x, grade, 2)
    assert np.allclose(w, [3, -2, 0], atol=0.35) and np.allclose(theta, [0.5, 2.5], atol=0.35)


def test_held_out_accuracy_and_severity(spark):
    texts, grades = corpus()
    texts += [None, "", "zidiot " * 3]
    docs = docs_of(spark, texts).withColumnRenamed("n_chars", "severity").withColumnRenamed("lang", "grade")
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i % 2] + [(1, None), (None, 2)], "doc_id long, grade int")
    rows = {r.doc_id: r for r in X.grade_documents(docs, X.fit(docs, labels)).collect()}
    assert len(rows) == len(texts)
    right = [rows[i].toxic == (g > 0) for i, g in enumerate(grades) if i % 2 == 0]
    assert np.mean(right) > 0.98
    mean = [np.mean([rows[i].severity for i, g in enumerate(grades) if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert rows[500].kept and rows[501].kept and rows[502].toxic
    assert all(0 <= r.severity <= 2 and r.kept != r.toxic for r in rows.values())


def test_severities_against_a_plain_computation(spark):
    import re

    texts, grades = corpus(200, 5)
    texts += [None, "", "ÄRGER zidiot-zfool", "zmoron" * 3]
    docs = docs_of(spark, texts)
    model = X.fit(docs, spark.createDataFrame(list(enumerate(grades)), "doc_id long, grade int"))
    words, w, theta = model
    assert len(theta) == 2 and theta[0] <= theta[1] and len(words) > 3
    weight = dict(zip(words.tolist(), w.tolist()))

    def hashes(word):
        """A word's hash, and those of its prefixes of 3 to 9 bytes, each from a text of its own."""
        raw = np.frombuffer(word, np.uint8)
        return X.features(raw, np.array([0, len(raw)]))[0].tolist()

    for r in X.grade_documents(docs, model).collect():
        text = (texts[r.doc_id] or "").encode()
        lower = bytes(c + 32 if 65 <= c <= 90 else c for c in text)
        have = {h for word in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower) for h in hashes(word)}
        z = sum(weight.get(h, 0.0) for h in have)
        p = [1 / (1 + np.exp(t - z)) for t in theta]
        assert abs(r.severity - sum(p)) < 1e-9 and r.grade == sum(x >= 0.5 for x in p) and r.toxic == (p[0] > 0.5)


def test_many_copies_of_one_toxic_text_teach_no_chance_words(spark):
    texts, grades = corpus(300, 2)
    chance = "qqqa qqqb qqqc qqqd qqqe qqqf " * 3
    texts += [chance + "zidiot"] * 100 + [chance]
    grades += [2] * 100 + [None]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame(list(enumerate(grades)), "doc_id long, grade int")
    rows = {r.doc_id: r for r in X.grade_documents(docs, X.fit(docs, labels)).collect()}
    assert rows[300].toxic and rows[400].kept


def test_nothing_to_learn(spark):
    docs = docs_of(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert all(r.kept for r in X.grade_documents(docs, X.fit(docs, none)).collect())
    one = spark.createDataFrame([(0, 0)], "doc_id long, grade int")
    model = X.fit(docs, one)
    assert all(r.kept for r in X.grade_documents(docs, model).collect())
    assert X.grade_documents(docs.where("doc_id > 9"), model).collect() == []
    assert X.clean_documents(docs, model).columns == docs.columns
    labels = spark.createDataFrame([(0, 0), (None, 0), (1, 1)], "toxic int, doc_id long")
    assert sorted(r.grade for r in X.toxic_labels(labels).collect()) == [0, 1]
