"""Null and repeated ids, odd texts and clashing names, operator by operator."""

import random

from claimloom.llm import language, mixing, neardup, packing, resampling, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows(spark):
    rng = random.Random(21)
    text = lambda k: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(k))
    a, b = text(40), text(50)
    long = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(200_000))  # 1.2 MB
    rows = [(1, a), (None, a), (None, b), (None, b), (2, b + " more words here"), (2, None), (3, ""), (4, " \t"), (5, long), (6, long + " tail"), (None, None), (7, "Ünïcödé " * 3)]
    return rows, spark.createDataFrame([(i, t, "xa", None if n % 4 == 0 else f"s{n % 2}", n) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


def same(got, rows):
    assert sorted(map(str, got)) == sorted(str(i) for i, _ in rows)


def test_near_duplicates(spark):
    rows, df = odd_rows(spark)
    got = neardup.near_duplicates(df.withColumnRenamed("source", "rep").withColumnRenamed("lang", "kept"), k=3, percent=85).collect()
    same([r.doc_id for r in got], rows)
    # a null id goes with the document that has its set; with none, it has no component and stays
    nulls = sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None if r.component_id is not None)
    assert nulls == [(38, 1, False)] and sum(r.kept for r in got if r.doc_id is None) == 3
    by = {r.doc_id: r.component_id for r in got if r.doc_id in (5, 6)}
    assert by == {5: 5, 6: 5}


def test_mixing(spark):
    rows, df = odd_rows(spark)
    got = mixing.mix(df.withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "rank")).collect()
    same([r.doc_id for r in got], rows)
    assert all(0 <= r.copies <= 2 for r in got) and {r.source for r in got} == {None, "s0", "s1"}
    words = sum(len((t or "").split()) for _, t in rows)
    assert abs(sum(r.copies * r.size for r in got) - sum({r.source: r.target for r in got}.values())) <= 3 * 200_001
    assert sum(r.size for r in got) == words
    out = mixing.mixed_documents(df.withColumnRenamed("lang", "own").withColumnRenamed("n_chars", "n"))
    assert out.columns == ["doc_id", "text", "own", "source", "n"] and out.count() == sum(r.copies for r in got)


def test_packing(spark):
    rows, df = odd_rows(spark)
    got = packing.pack(df.withColumnRenamed("lang", "piece").withColumnRenamed("n_chars", "at")).collect()
    same([r.doc_id for r in got if r.piece == 0], rows)
    assert sum(r.length == 1 and r.piece == 0 for r in got) == 3  # null and empty texts: the end alone


def test_language(spark):
    rows, df = odd_rows(spark)
    model = language.fit_on(df)
    got = language.predict(df.withColumnRenamed("source", "score"), model).collect()
    same([r.doc_id for r in got], rows)
    assert sum(r.lang_pred == "und" for r in got) == 4 and {r.lang_pred for r in got} == {"xa", "und"}


def test_resampling(spark):
    rows, df = odd_rows(spark)
    target = spark.createDataFrame([(1,), (5,)], "doc_id long")
    got = resampling.resample(df.withColumnRenamed("n_chars", "sample_rank"), target, 0.5).collect()
    same([r.doc_id for r in got], rows)
    assert sorted(r.sample_rank for r in got) == list(range(1, len(rows) + 1)) and sum(r.kept for r in got) == 6
    assert all(r.log_weight == 0 for r, in [(r,) for r in got if r.doc_id in (3, 4)])


def test_toxicity(spark):
    rows, df = odd_rows(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0), (None, 1)], "doc_id long, grade int")
    model = toxicity.fit(df, labels)
    got = toxicity.grade_documents(df.withColumnRenamed("source", "severity"), model).collect()
    same([r.doc_id for r in got], rows)
    assert toxicity.clean_documents(df, model).columns == df.columns
