"""Operators on small hand-made tables."""

import math

import pytest
from pyspark.sql import functions as F

from claimloom import model
from claimloom.functions import answers, framing
from claimloom.functions import text as X
from claimloom.operators import align, claims, documents, govern, graph, lexicon, lookup, patterns, retrieval
from claimloom.plans import pattern_queries


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# ---------------------------------------------------------------- text


def test_stems_published_examples():
    pairs = "caresses:caress ponies:poni cats:cat agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat sized:size hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit vietnamization:vietnam triplicate:triplic hopeful:hope goodness:good revival:reviv adjustment:adjust adoption:adopt probate:probat rate:rate controll:control roll:roll"
    for pair in pairs.split():
        word, want = pair.split(":")
        assert X.porter_stem(word) == want


def test_aliases(spark):
    names = ["Martin Luther King, Jr.", "C++", "United States of America", "O'Brien", "long-term", "cliché", "x", None, "The Beatles", "U.S."]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", X.alias_forms("n").alias("a")).orderBy("i").collect()
    king, c, usa, brien, long, cliche, x, none, beatles, us = (r.a for r in rows)
    assert {"jr. martin luther king", "martin luther king", "mlkj"} <= set(king)
    assert c == ["c++", "cplusplus"]
    assert {"united states of america", "usa"} <= set(usa)
    assert {"obrien", "o'brien"} <= set(brien) and {"long term", "longterm"} <= set(long)
    assert cliche == ["cliche"] and x == [] and none == []
    assert "beatles" in beatles and "us" in us


def test_text_columns(spark):
    r = one(
        spark,
        X.search_tokens(F.lit("Hello, World! a-b")).alias("a"),
        X.lemma_fragments(F.lit("New-York's o'Brien' x")).alias("b"),
        X.strip_lemma(F.lit("Bank, a place"), F.lit("bank")).alias("c"),
        X.strip_lemma(F.lit("Banking house"), F.lit("bank")).alias("d"),
        X.canonical_id(F.lit("New York"), F.lit("big_city"), F.lit("PROPN"), F.lit("WordNet")).alias("e"),
        X.name_key(F.lit("The  “Great” Gatsby’s")).alias("f"),
        F.array(*[X.literal_type(F.lit(x)) for x in ("1770", "9", "seven", "2100", "word", "1001")]).alias("g"),
        X.token_budget(F.lit(5), F.lit("wikipedia")).alias("h"),
        F.array(X.is_noise(F.lit("--")), X.is_noise(F.lit("Ann"))).alias("i"),
        X.fallback_parent(F.lit("steam engine"), F.lit("NOUN")).alias("j"),
        X.escape_triple(F.lit('a"b\n')).alias("k"),
        F.array(X.as_bool(F.lit("Yes")), X.as_bool(F.lit("off")), X.as_bool(F.lit("?"))).alias("l"),
        X.number_word(F.lit("twelve")).alias("m"),
    )
    assert r.a == ["hello", "world", "a", "b"] and r.b == ["new", "york's", "o'brien"]
    assert (r.c, r.d) == ("a place", "Banking house") and r.e == "en.new_york.big_city.propn.lexicon_wordnet"
    assert r.f == "great gatsby" and r.g == ["year", "int_small", "int_small", None, None, "year"] and r.h == 5
    assert r.i == [True, False] and r.j == "engine" and r.k == 'a\\"b\\n' and r.l == [True, False, None] and r.m == "12"
    s = spark.createDataFrame([("abcd", "abxd"), (None, "a")], "a string, b string").select(X.sequence_similarity("a", "b").alias("s")).collect()
    assert s[0].s == 0.75 and s[1].s is None


# ---------------------------------------------------------------- framing


def test_frames(spark):
    rows = [
        ("Could you open it", "open", "it", "REQUEST", "none", None, "none"),
        ("Is it so?", "is", "it", "QUESTION", "none", None, "none"),
        ("We promise to go", "promise", "We", "PROMISE", "none", None, "none"),
        ("Open the door", "open", None, "COMMAND", "none", None, "none"),
        ("If he had known, he would have left", "left", "he", "INFORM", "none", "counterfactual", "none"),
        ("Suppose it rains", "rains", "it", "INFORM", "none", "hypothetical", "none"),
        ("Perhaps he might believe it", "believe", "he", "INFORM", "moderate", None, "none"),
        ('He said "yes" now', "said", "He", "INFORM", "none", None, "direct"),
        ("Unless it stops, we go", "go", "we", "INFORM", "none", "conditional", "none"),
    ]
    df = spark.createDataFrame(rows, "clause string, predicate string, agent string, act string, hedge string, cond string, quote string")
    spokes = F.array(F.struct(F.lit("HAS_AGENT").alias("role"), F.col("agent").alias("surface")))
    f = framing.frame(F.col("clause"), F.col("predicate"), spokes, F.lit("positive"), ["said"])
    for r in df.withColumn("f", f).collect():
        assert (r.f.speech_act, r.f.hedging_level, r.f.conditional_marker, r.f.quote_type) == (r.act, r.hedge, r.cond, r.quote), r.clause
    got = {r.clause: r.f for r in df.withColumn("f", f).collect()}
    assert got['He said "yes" now'].point_of_view == "character" and got['He said "yes" now'].statement_type == "reported_claim"
    assert got["Suppose it rains"].statement_type == "hypothetical" and got["Perhaps he might believe it"].verb_modality == "epistemic"
    r = one(
        spark,
        framing.scope(F.lit("Dogs bark"), F.lit("bark"), F.array(F.struct(F.lit("HAS_AGENT").alias("role"), F.lit("Dogs").alias("surface")))).alias("a"),
        framing.scope(F.lit("The dogs bark"), F.lit("bark"), F.array(F.struct(F.lit("HAS_AGENT").alias("role"), F.lit("The dogs").alias("surface")))).alias("b"),
        framing.negated_by_determiner(F.array(F.struct(F.lit("HAS_AGENT").alias("role"), F.lit("No letter").alias("surface")))).alias("c"),
        framing.hyperbole(F.lit("I told you a million times")).alias("d"),
        framing.temporal_anchor(F.lit("born in 1770 there"), F.lit("born"), F.array(F.struct(F.lit("HAS_AGENT").alias("role"), F.lit("He").alias("surface")))).alias("e"),
    )
    assert tuple(r) == ("generic", "specific", True, "hyperbolic_suspected", "explicit_date")


# ---------------------------------------------------------------- retrieval


def test_bank_scores_by_hand(spark):
    docs = [(1, "the bank of the river"), (2, "a financial bank"), (3, "no match here")]
    df = spark.createDataFrame([(0, i, "bank financial river", t) for i, t in docs], "q int, d int, qt string, t string")
    got = {r.d: r.bm25 for r in retrieval.bm25_over_candidates(df, "q", "d", F.col("qt"), F.col("t")).collect()}
    mean = 11 / 3
    idf = lambda n: math.log((3 - n + 0.5) / (n + 0.5) + 1)
    part = lambda size: 2.5 / (1 + 1.5 * (0.25 + 0.75 * size / mean))
    assert abs(got[1] - (idf(2) + idf(1)) * part(5)) < 1e-9 and abs(got[2] - (idf(2) + idf(1)) * part(3)) < 1e-9 and got[3] == 0


def test_margins_fusion_policy(spark):
    df = spark.createDataFrame([("a", 1, 0.9, "x"), ("a", 2, 0.8, "y"), ("a", 3, 0.4, "x"), ("b", 1, 0.5, None)], "q string, d int, s double, axis string")
    assert {r.q: round(r.margin, 6) for r in retrieval.margin(df, ["q"], "s").collect()} == {"a": 0.2, "b": 1.0}
    assert {r.q: r.diverges for r in retrieval.diverges(df, ["q"], ["axis"]).collect()} == {"a": True, "b": False}
    fused = retrieval.fuse(df.withColumn("l", F.lit(1.0)), ["q"], "s", "l").collect()
    assert {(r.q, r.d): round(r.fused, 6) for r in fused}[("a", 2)] == round(0.7 * 0.8 + 0.3, 6)
    hits = spark.createDataFrame([(1, 0.5, "CORE_ONTOLOGY"), (2, 0.6, "GHOST"), (3, 0.55, "odd")], "d int, cosine double, definition_tier string")
    scored = {r.d: r.policy_score for r in retrieval.with_policy(hits, 7, lemma=F.col("d") == 2).collect()}
    assert scored == {1: 0.65, 2: 0.6}
    kept = retrieval.restrict_or_all(df, ["q"], F.coalesce(F.col("axis") == "y", F.lit(False))).collect()
    assert sorted((r.q, r.d) for r in kept) == [("a", 2), ("b", 1)]


def test_forms_compounds_and_slots(spark):
    forms = spark.createDataFrame([("saw", "see"), ("saw", "saw"), ("saw", "sawyer")], "form string, lemma string")
    ranks = spark.createDataFrame([("see", 10)], "lemma string, frequency_rank int")
    assert {r.lemma: r.preference for r in retrieval.resolve_forms(forms, ranks).collect()} == {"saw": 1, "see": 2, "sawyer": 3}
    q = spark.createDataFrame([(1, "the steam engine shed"), (2, "steam")], "id int, t string")
    lemmas = spark.createDataFrame([("Steam engine",), ("engine shed",), ("the steam engine",), ("steam",)], "l string")
    assert sorted((r.id, r.compound) for r in retrieval.known_compounds(q, "id", F.col("t"), lemmas, "l").collect()) == [(1, "engine shed"), (1, "steam engine"), (1, "the steam engine")]
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    r = one(
        spark,
        retrieval.slot_overlap(F.lit("pump"), a("machine", "tool"), a(), a("hand", "red", "x"), F.lit("hand pump"), a("machine", "red"), a()).alias("s"),
        retrieval.slot_overlap(F.lit(""), a(), a(), a(), F.lit("x"), a(), a()).alias("z"),
    )
    assert r.s == round(min(1.0, (0.5 + 0.15) / 0.8 + 0.1), 4) and r.z == 0.0


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.5]), (2, [1.0, 0.01, 0.5]), (3, [-1.0, 0.0, -0.5])], "id int, v array<float>")
    prints = retrieval.fingerprints(df, "id", "v")
    rows = prints.collect()
    assert all(len(r.fingerprint) == 86 and len(r.words) == 9 for r in rows)
    near = [(r.left_id, r.right_id) for r in retrieval.hamming_join(prints, "id", 30).collect()]
    assert near == [(1, 2)]
    a, b = prints.alias("a"), prints.alias("b")
    want = {(r[0], r[1]): r[2] for r in a.join(b, F.col("a.id") != F.col("b.id")).select("a.id", "b.id", retrieval.hamming(F.col("a.words"), F.col("b.words"))).collect()}
    found = retrieval.hamming_search(prints, prints, "id", 516)
    assert {(r.query_id, r.id): r.distance for r in found.collect()} == want and len(want) == 6
    with pytest.raises(ValueError):
        retrieval.hamming_join(prints, "id", 185)


# ---------------------------------------------------------------- graphs


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in graph.ancestors(e, start, 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r.node for r in graph.reach(e, spark.createDataFrame([("d",)], "node string")).collect()} == {"a", "b", "c", "d"}
    assert graph.cyclic_core(e).count() == 0
    loop = e.union(spark.createDataFrame([("e", "b")], "src string, dst string"))
    assert {(r.src, r.dst) for r in graph.cyclic_core(loop).collect()} == {("b", "d"), ("d", "e"), ("e", "b")}
    assert graph.closure(e).count() == 9
    assert [r.path for r in graph.chains(e, start, spark.createDataFrame([("d",)], "node string"), 3).collect()] == [["a", "b", "d"]]
    events = spark.createDataFrame([(1, "go", "t", None, {"A": "x", "B": "y"}), (2, "go", "t", None, {"A": "x", "C": "z"}), (3, "go", "t", None, {"A": "q"})], "event_id int, hub string, time string, place string, roles map<string,string>")
    assert [tuple(r) for r in graph.same_events(events).collect()] == [(1, 2)]


# ---------------------------------------------------------------- claims


def test_claims(spark):
    c = spark.createDataFrame([("k", "v1", 1, "2020-01-01", None), ("k", "v2", 3, "2021-01-01", None), ("j", "w", 2, "2019-01-01", "2019-06-01")], "key string, value string, tier_rank int, valid_from string, valid_until string")
    assert {r.key: r.value for r in claims.resolve_conflicts(c, ["key"], [F.asc("tier_rank")]).collect()} == {"k": "v1", "j": "w"}
    assert {r.key: r.value for r in claims.resolve_conflicts(c, ["key"], [F.desc("valid_from")]).collect()}["k"] == "v2"
    assert claims.as_of(c, F.lit("2019-06-01")).count() == 0 and claims.as_of(c, F.lit("2019-05-31")).count() == 1
    assert claims.trust_lens(c, most_rank=2).count() == 2
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 5)], "k string, v int, at int")
    new = spark.createDataFrame([("a", 2, 2), ("b", 2, 4), ("c", 9, 1), ("c", 8, 0)], "k string, v int, at int")
    assert {r.k: r.v for r in claims.upsert(old, new, ["k"], "at").collect()} == {"a": 2, "b": 1, "c": 9}
    assert [(r.k, r.v) for r in claims.insert_absent(old, new, ["k"], "at").collect()] == [("c", 8)]
    chain = spark.createDataFrame([("v1", "v2"), ("v2", "v3"), ("v3", "v4")], "old string, new string")
    assert {r.old: r.latest for r in claims.latest_version(chain).collect()} == {"v1": "v4", "v2": "v4", "v3": "v4"}
    left = spark.createDataFrame([(1, "x", 5), (2, "x", 3), (3, "y", 9)], "id int, key string, at int")
    right = spark.createDataFrame([("x", 3, "p"), ("x", 4, "q"), ("y", 9, "r")], "key string, at int, val string")
    assert {r.id: r.val for r in claims.nearest_preceding(left, right, "key", "at", "val").collect()} == {1: "q", 2: None, 3: None}
    assert one(spark, claims.decayed(F.lit(8.0), F.lit(20.0), 10.0).alias("d")).d == pytest.approx(2.0)


# ---------------------------------------------------------------- lexicon


def test_lexicon(spark):
    e = spark.createDataFrame([(1, "bank", "bank, the side of a river"), (2, "bank", "side of a river with sand"), (3, "bank", "house for money"), (4, "bank", "house for money"), (5, "word", "")], "entry_id long, lemma string, gloss string").withColumn("pos_ud", F.lit("NOUN")).withColumn("source_type", F.lit("wordnet"))
    rows = lexicon.distinct_glosses(e).collect()
    assert len({r.canonical_id for r in rows}) == len(rows) == 5
    by = {r.entry_id: r.microgloss for r in rows}
    assert by[5] == "word" and by[3].startswith("house_money") and by[4].startswith("house_money_")
    s = lexicon.synonyms(spark.createDataFrame([(1, "g", "a"), (2, "g", "b"), (3, "h", "c")], "id int, g string, n string"), ["g"], "id", "n")
    assert {r.id: r.synonyms for r in s.collect()} == {1: ["b"], 2: ["a"]}
    wanted = spark.createDataFrame([("Bank", "NOUN", 1), ("Steam Pump", "NOUN", 2), ("steam pump", "NOUN", 3)], "lemma string, pos_ud string, seq int")
    assert [tuple(r) for r in lexicon.mint(e, wanted).collect()] == [("steam pump", "NOUN", "doc.steam_pump.unmapped.noun.docloc", "pump")]
    entries = spark.createDataFrame([("abc", None), (None, None), ("abcdef", None)], "microgloss string, improved_at timestamp")
    assert lexicon.needs_work(entries).count() == 3


# ---------------------------------------------------------------- rules and alignment


def test_predicates(spark):
    df = spark.createDataFrame([(1, "x", True), (None, "y", False)], "n int, s string, b boolean")
    cases = {"n >= 1": [True, None], 'NOT s == "x" OR b': [True, True], 's IN ["y", "z"] AND NOT b': [False, True], "b XOR n == 1": [False, None], "(n < 1 OR n > 0)": [True, None]}
    for text, want in cases.items():
        got = [r.v for r in df.select("s", govern.compile_predicate(text).alias("v")).orderBy("s").collect()]
        assert got == want, text
    for bad in ("n >=", "n ? 1", "IN [1"):
        with pytest.raises((govern.PredicateError, IndexError)):
            govern.compile_predicate(bad)


def test_verdicts_and_gates(spark):
    p = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    fired = spark.createDataFrame([(1, "a", 1, "ALLOW"), (1, "b", 2, "DENY"), (2, "c", 1, "ALLOW"), (2, "d", 1, "UNKNOWN"), (3, "f", 1, "ALLOW"), (3, "e", 1, "ALLOW")], "id int, rule_id string, priority int, status string")
    assert {r.id: (r.verdict, r.decided_by) for r in govern.verdicts(p, fired, "id").collect()} == {1: ("DENY", "b"), 2: ("UNKNOWN", "d"), 3: ("ALLOW", "e"), 4: ("DENY", "default")}
    gates = [("one", F.col("id") > 1), ("two", F.when(F.col("id") > 2, True)), ("three", F.col("id") > 3)]
    assert [r.g for r in p.select("id", govern.first_failure(gates).alias("g")).orderBy("id").collect()] == ["one", "two", "three", None]
    assert [tuple(r) for r in govern.validators(p, {"small": F.col("id") < 3}).collect()] == [("small", 2, 4)]


def test_alignment(spark):
    slots = lambda rows: spark.createDataFrame(rows, "id string, slot string, fillers array<string>")
    left, right = slots([("a", "IS_A", ["x", "y"]), ("a", "HAS_PART", ["p"]), ("a", "COLOR", ["red"])]), slots([("b", "IS_A", ["x"]), ("b", "HAS_PART", ["p", "q"])])
    pairs = spark.createDataFrame([("a", "b")], "left_id string, right_id string")
    r = align.report(align.compare_slots(left, right, pairs)).first()
    assert r.overall == 0.5 and not r.complies and r.gaps == ["COLOR", "IS_A"] and r.confidence == "MODERATE"
    assert [(t.slot, t.result) for t in r.trace] == [("COLOR", "GAP"), ("HAS_PART", "MATCH"), ("IS_A", "PARTIAL")]
    m = one(spark, align.meets(F.lit(0.05), F.lit(">="), F.lit(None).cast("double"), align.si_value(F.lit(2.0), F.lit("in"))).alias("a"), align.meets(F.lit(1.0), F.lit("=="), F.lit(0.1), align.si_value(F.lit(95.0), F.lit("cm"))).alias("b"), align.dimension(F.lit("bar")).alias("c"))
    assert tuple(m) == (True, True, "pressure")


# ---------------------------------------------------------------- documents


TOKENS = [
    # Ann Lee did not send the letter to Bonn in 1770.
    ("d", 0, 0, "Ann", "Ann", "PROPN", "compound", 1, "PERSON"), ("d", 0, 1, "Lee", "Lee", "PROPN", "nsubj", 4, "PERSON"), ("d", 0, 2, "did", "do", "AUX", "aux", 4, ""),
    ("d", 0, 3, "not", "not", "PART", "neg", 4, ""), ("d", 0, 4, "send", "send", "VERB", "ROOT", 4, ""), ("d", 0, 5, "the", "the", "DET", "det", 6, ""),
    ("d", 0, 6, "letter", "letter", "NOUN", "dobj", 4, ""), ("d", 0, 7, "to", "to", "ADP", "prep", 4, ""), ("d", 0, 8, "Bonn", "Bonn", "PROPN", "pobj", 7, "GPE"),
    ("d", 0, 9, "in", "in", "ADP", "prep", 4, ""), ("d", 0, 10, "1770", "1770", "NUM", "pobj", 9, "DATE"),
    # She slept.
    ("d", 1, 0, "She", "she", "PRON", "nsubj", 1, ""), ("d", 1, 1, "slept", "sleep", "VERB", "ROOT", 1, ""),
    # Lee runs.
    ("d", 2, 0, "Lee", "Lee", "PROPN", "nsubj", 1, "PERSON"), ("d", 2, 1, "runs", "run", "VERB", "ROOT", 1, ""),
]


def test_documents_to_claims(spark):
    tokens = spark.createDataFrame(TOKENS, "doc_id string, sent int, idx int, text string, lemma string, pos string, dep string, head int, ent_type string")
    found = documents.mentions(tokens)
    assert {(r.sent, r.surface, r.kind) for r in found.collect()} == {(0, "Ann Lee", "person"), (0, "Bonn", "gpe"), (0, "1770", "literal"), (0, "letter", "common"), (2, "Lee", "person")}
    people = documents.entities(found)
    merged = {r.ent_id: r.anchor for r in documents.merge_aliases(people).collect()}
    ids = {r.norm_key: r.ent_id for r in people.collect()}
    assert merged[ids["lee"]] == ids["ann lee"] and merged[ids["bonn"]] == ids["bonn"]
    assert [(r.text, r.antecedent) for r in documents.resolve_pronouns(tokens, found).collect()] == [("She", "ann lee")]
    made = {r.verb_lemma: r for r in documents.clauses(tokens).collect()}
    send = made["send"]
    assert send.polarity == "negative" and [(s.role, s.surface) for s in send.spokes] == [("HAS_AGENT", "Lee"), ("HAS_PATIENT", "letter"), ("HAS_DESTINATION", "Bonn"), ("HAS_TIME", "1770")]
    assert made["sleep"].polarity == "positive" and len({r.synapse_id for r in made.values()}) == 3
    assert documents.unknown_roles(documents.clauses(tokens)).count() == 0


def test_model_checks(spark):
    assert len(model.ROLES) == 15
    df = spark.createDataFrame([("HAS_AGENT",), ("HAS_PURPOSE",), (None,)], "role string")
    assert [tuple(r) for r in model.unknown_values(df, "role", model.ROLES).collect()] == [("HAS_PURPOSE", 1)]
    assert model.not_unique(df.union(df), ["role"]).count() == 3
    assert model.dangling(df, "role", df.where("role = 'HAS_AGENT'"), "role").count() == 1
    r = one(spark, model.tier_rank(F.lit("CLAIMED")).alias("a"), model.tier_rank(F.lit("raw")).alias("b"), model.tier_rank(F.lit("?")).alias("c"), model.tier_bonus(F.lit("GHOST")).alias("d"))
    assert tuple(r) == (4, 99, 99, -0.2)


# ---------------------------------------------------------------- lookup, policies, stages


def test_policies_and_configuration(spark, tmp_path):
    f = tmp_path / "p.toml"
    f.write_text('[policies.strict]\nmin_tier = "CORE_ONTOLOGY"\nk = 3\n[policies.snap_to_standard]\nalpha = 0.4\n')
    named = lookup.policies(str(f))
    assert named["strict"].least_rank() == 1 and named["strict"].k == 3 and named["snap_to_standard"].alpha == 0.4 and named["snap_to_standard"].min_tier == "LEXICAL_EXTENSION"
    assert lookup.load_config([str(tmp_path / "none"), str(f)])["policies"]["strict"]["k"] == 3 and lookup.load_config([]) == {}
    p = lookup.Policy.named("snap_to_neutral", k=2, pos="verb", odd=1)
    assert (p.least_rank(), p.k) == (4, 2) and lookup.Policy(min_tier="clustered").least_rank() == 2 and lookup.Policy(min_tier="?").least_rank() == 0
    hits = spark.createDataFrame([(1, 1, 0.5, "CLAIMED", "VERB"), (1, 2, 0.9, "CLAIMED", "NOUN"), (1, 3, 0.9, "GHOST", "VERB"), (2, 4, 0.3, "INFERRED", "NOUN"), (2, 5, 0.1, "CORE_ONTOLOGY", "NOUN")], "q int, entry_id int, cosine double, definition_tier string, pos_ud string")
    got = [(r.q, r.entry_id, r.policy_score) for r in p.apply(hits, ["q"]).orderBy("q", "rank").collect()]
    assert got == [(1, 1, 0.6), (2, 5, 0.25)]  # the verb alone; no verb, so all, but INFERRED is below the floor


def test_pluggable_stages(spark):
    e = lookup.HashingEmbedder(16)
    df = spark.createDataFrame([("a red ring",), ("ring, a red",), ("blue gear",)], "t string").select("t", e.embed(F.col("t")).alias("v"))
    a, b, c = (r.v for r in df.collect())
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9 and a != c
    engine = lookup.Engine(df.select(F.monotonically_increasing_id().alias("entry_id"), "t", F.col("v").alias("embedding"), F.lit("CORE_ONTOLOGY").alias("definition_tier"), F.lit("NOUN").alias("pos_ud"), F.col("t").alias("lemma")))
    found = engine.search(spark.createDataFrame([(7, c)], "query_id long, qv array<double>"), k=1).collect()
    assert len(found) == 1 and found[0].query_id == 7 and found[0].cosine == 1.0
    assert [tuple(r) for r in engine.health().collect()] == [("CORE_ONTOLOGY", 3, 3)]
    assert engine.lookup(spark.createDataFrame([(1, "Blue Gear")], "q int, w string"), "q", "w").count() == 1


def test_ontology_answers_of_odd_shape():
    assert answers.read_blocks(None) == [] and answers.read_blocks("A: 1\nb") == [{"_marker": "BLOCK", "a": "1 b"}]
    assert answers.read_blocks("x: 1\nR1\na: 2\n\nb: 3\nR2\n: 4") == [{"_marker": "R1", "a": "2"}]
    assert answers.read_compounds("new_lemma: a") == [] and answers.read_compounds("DECISION: YES\nnew_lemma: a") == [{"new_lemma": "a"}]
    s = answers.read_slots("• HEAD: saw\nis_a: tool; thing\nmore, still\nhas_purpose:\ncut\nwood")
    assert s["head"] == "saw" and s["is_a"] == ["tool", "thing", "more", "still"] and s["has_purpose"] == "cut wood" and s["modifier"] == []
    assert answers.read_entries('<answer entry_id="2">bow: a</answer><answer entry_id="2">purpose: b</answer><answer entry_id="3">') == [{"entry_id": 2, "fields": {"purpose": "b"}, "parents": [], "parts": [], "attributes": [], "events": [], "links": []}]


def test_vectors_and_forms(spark):
    import struct

    df = spark.createDataFrame([(bytearray(struct.pack("<3f", 1, -2, 0.5)),), (bytearray(b"abc"),), (None,)], "b binary").select(X.vector_of("b").alias("v"))
    assert [r.v for r in df.collect()] == [[1.0, -2.0, 0.5], None, None]
    pairs = [("driving", "drive", True), ("happier", "happy", True), ("mice", "mouse", True), ("cats", "cat", True), ("catalog", "cat", False)]
    rows = spark.createDataFrame(pairs, "t string, l string, want boolean").select(X.is_form_of(F.col("t"), F.col("l")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)
    g = spark.createDataFrame([("A hand-powered tool for driving screws", "drive"), ("", "New Saw"), (None, "x y")], "g string, l string")
    assert [r.m for r in g.select(X.derived_microgloss(F.col("g"), F.col("l"), lexicon.STOP).alias("m")).collect()] == ["hand_powered_tool_screws", "new_saw", "x_y"]
    cut = spark.createDataFrame([("word " * 200,), ("x" * 600,), ("short",)], "t string").select(F.length(X.cut_at_word(F.col("t"))).alias("n")).collect()
    assert [r.n for r in cut] == [499, 500, 5]


def test_specifications(spark):
    spec = govern.load_spec(pattern_queries.SPEC)
    assert len(spec) == 8 and spec["usual"]["PRIORITY"] == "5"
    for bad, told in (("NONSENSE x { A: 1; }", "unknown primitive"), ("ENTITY a { TYPE: b; } ENTITY a { TYPE: b; }", "twice"), ("ENTITY a { }", "lacks TYPE"), ("ENTITY a { TYPE b }", "line 1, column 11"), ("?", "line 1, column 1"), ('STATE_TRANSITION t { ACTION: "a"; PRECONDITION: x > 1; GOVERNED_BY: none; }', "names no GOVERNANCE_RULE"), ("GOVERNANCE_RULE r { SCOPE: x > 1; PREDICATE: x >; ENFORCEMENT_MODE: PERMIT; PRIORITY: 1; }", "r:"), ("SELF_REFERENCE_POINT p { TARGET_TYPE: t; CONTAINS: m; } MUTATION_RULE m { TARGET_REFERENCE: p; APPROVED_BY: x; }", "change itself")):
        with pytest.raises(govern.SpecError, match=told):
            govern.load_spec(bad)


def test_stage_runner():
    ran = []

    def fail():
        raise ValueError

    stages = {"a": lambda: ran.append("a"), "b": fail, "c": lambda: ran.append("c"), "d": lambda: ran.append("d")}
    needs = {"a": [], "b": ["a"], "c": ["b"], "d": ["a"]}
    assert govern.run_stages(needs, stages) == {"a": "done", "b": "failed", "d": "done", "c": "skipped"} and ran == ["a", "d"]
    assert govern.run_stages(needs, stages, ["b"])["c"] == "done"
    with pytest.raises(ValueError):
        graph.stage_order({"a": ["b"], "b": ["a"]})


def test_compile_and_persist(spark, tmp_path):
    tokens = spark.createDataFrame(TOKENS, "doc_id string, sent int, idx int, text string, lemma string, pos string, dep string, head int, ent_type string")
    entries = spark.createDataFrame([("letter", "en.letter.mail.noun.x")], "lemma string, canonical_id string")
    tables = documents.compile_claims(tokens, entries, spark.createDataFrame([], "ent_id string, alias string"))
    n = documents.persist(tables, str(tmp_path))
    assert n["synapse"] == 3 and n["mention"] == 5 and n["entity"] == 5 and n["ghost"] == 0
    senses = {r.canonical_id: r.level for r in spark.read.parquet(f"{tmp_path}/sense").collect()}
    assert senses["en.letter.mail.noun.x"] == 1 and senses["doc.bonn.unmapped.noun.docloc"] == 4
    gender = F.when(F.col("surface") == "Lee", "m").when(F.col("surface") == "Ann Lee", "f")
    found = documents.mentions(tokens)
    she = documents.resolve_pronouns(tokens, found, gender)
    assert [(r.text, r.antecedent) for r in she.collect()] == [("She", "ann lee")]
    assert documents.with_pronouns(found, she).where("kind = 'pronoun'").count() == 1


def test_patterns_in_words():
    import re

    assert re.match(patterns.wildcard("sgf:en.any.verb"), "sgf:en.compose.verb") and not re.match(patterns.wildcard("en.any"), "en.a.b")
    assert lookup.RIGOR[3][1] == [0.90, 0.95, 0.98]
    with pytest.raises(ValueError):
        patterns.on_plane(None, "dreams")


def test_clusters_and_written_files(spark, tmp_path):
    rows = [(i, [float(i % 2 * 10), float(i % 2 * 10 + i / 100)]) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    found = {r.id: r.cluster for r in retrieval.clusters(df, "id", "v", 2).collect()}
    assert len({found[i] for i in range(0, 20, 2)}) == len({found[i] for i in range(1, 20, 2)}) == 1 and found[0] != found[1]
    df.write.parquet(str(tmp_path / "t"))
    assert govern.file_present(spark, str(tmp_path / "t")) and not govern.file_present(spark, str(tmp_path / "u"))
    assert govern.written(spark, str(tmp_path / "t"), 20) and not govern.written(spark, str(tmp_path / "t"), 21) and not govern.written(spark, str(tmp_path))
    with pytest.raises(ValueError):
        claims.trust_lens(df, contradictions="guess", key=["id"], value="id")
