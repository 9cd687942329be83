import random

import corpus_pipeline as P

from .test_neardup import components
from .test_suffixdedup import brute
from .util import docs_of, save


def corpus():
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    passage = " ".join(word() for _ in range(60))
    texts, toxic = [], []
    for i in range(160):
        words = [word() for _ in range(rng.randint(30, 120))]
        bad = rng.random() < 0.25
        if bad:
            words[3], words[9] = "ziditos", "zmorano"
        t = " ".join(words)
        if rng.random() < 0.15:
            t += "\n" + passage
        texts.append(t)
        toxic.append(int(bad))
    for i in range(30):
        w = texts[i].split(" ")
        w[rng.choice([j for j, x in enumerate(w) if not x.startswith("z")])] = word()
        texts.append(" ".join(w))
        toxic.append(toxic[i])
    texts += [None, "", texts[5]]
    return texts, toxic


def test_stages_against_brute_force(spark, tmp_path):
    texts, toxic = corpus()
    rng = random.Random(1)
    sources = [rng.choice(["a", "b", None]) for _ in texts]
    docs = docs_of(spark, texts, sources)
    folder = save(docs, tmp_path)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic) if i % 4], "doc_id long, quality int, toxic int")
    save(labels, tmp_path, "labels")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    one = P.reject_toxic(spark, docs, folder)
    assert one.columns == docs.columns
    left = {r.doc_id: r.text for r in one.collect()}
    assert {i for i in range(len(texts)) if i not in left} == {i for i, t in enumerate(texts) if t and ("ziditos" in t or "zmorano" in t)}

    one = docs.where("text IS NULL OR NOT (text LIKE '%ziditos%' OR text LIKE '%zmorano%')")
    two = P.near_dedup(spark, one, folder)
    assert two.columns == docs.columns
    ids = sorted(left)
    _, roots = components([left[i] for i in ids], 5, 80)
    want = {ids[j] for j, r in enumerate(roots) if r == j}
    got = {r.doc_id: r.text for r in two.collect()}
    assert set(got) == want and all(got[i] == texts[i] for i in got)

    three = P.cut_passages(spark, two, folder)
    assert three.schema == docs.schema
    ids = sorted(got)
    cut = brute([got[i] for i in ids], 100)
    after = {r.doc_id: r for r in three.collect()}
    assert set(after) == set(ids)
    for j, i in enumerate(ids):
        assert after[i].text == (None if texts[i] is None else cut[j][1].decode("utf-8", "ignore"))
        assert after[i].source == sources[i] and after[i].n_chars == (None if after[i].text is None else len(after[i].text))
    assert sum(len(x[0]) for x in cut.values()) > 5

    four = P.mix_sources(spark, three, folder)
    assert four.columns == docs.columns
    times = {}
    for r in four.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert r.text == after[r.doc_id].text
    assert max(times.values()) <= 2 and len(times) > len(ids) / 2

    five = P.run(spark, folder).collect()
    assert {r.doc_id for r in five} == set(times)
    assert sum(r.piece == 0 for r in five) == sum(times.values())
    fill = {}
    for r in five:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024


def test_characters_cut_in_two_go(spark, tmp_path):
    text = "é" * 60 + "x"  # bytes from the second half of a character repeat
    rows = P.cut_passages(spark, docs_of(spark, [text, "a" + text, "é" * 49 + "b"]), str(tmp_path)).collect()
    assert all("�" not in r.text for r in rows)


def test_repeated_rows_and_empty(spark, tmp_path):
    docs = docs_of(spark, ["one two three four five six", "x y z"])
    twice = docs.union(docs)
    assert sorted(r.doc_id for r in P.near_dedup(spark, twice, "").collect()) == [0, 1]
    empty = docs.where("doc_id > 7")
    assert P.cut_passages(spark, P.near_dedup(spark, empty, ""), "").collect() == []


def test_null_and_shared_ids(spark, tmp_path):
    rng = random.Random(4)
    text = lambda k: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(k))
    a, b, c, d = text(60), text(70), text(80), text(90)
    rows = [(1, a), (1, b), (None, c), (None, d), (None, a), (7, b), (9, text(40)), (9, None), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs_of(spark, []).schema).repartition(3)
    kept = P.near_dedup(spark, docs, "").collect()
    # the null-id copy of a and the copy of b under a later id go; all else is alone
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([x for i, x in enumerate(rows) if i not in (4, 5)], key=str)
    mixed = P.mix_sources(spark, docs, "").collect()
    times = {}
    for r in mixed:
        times[r.doc_id, r.text] = times.get((r.doc_id, r.text), 0) + 1
    assert set(times) <= set(rows) and max(times.values()) <= 2
    words = sum(len((t or "").split()) * n for (_, t), n in times.items())
    assert abs(words - 1.5 * sum(len((t or "").split()) for _, t in rows)) <= 90
    cut = P.cut_passages(spark, docs, "").collect()
    assert len(cut) == len(rows) and sum(len(r.text or "") for r in cut) == sum(len(x) for x in {t for _, t in rows if t})
