"""Queries of text functions, names, small graphs and messages, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import framing
from claimloom.functions import text as X
from claimloom.model import tier_bonus, tier_rank
from claimloom.operators import claims, documents, govern, graph, lexicon, lookup, retrieval
from claimloom.plans.queries import _TIER, query, table
from claimloom.sources import lexical, rskv
from claimloom.streaming import messages

# ---------------------------------------------------------------- text


@query(r"""SELECT p_partkey, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), 'cafe'] AS tokens, [split_part(p_name, ' ', 1) || '''s', split_part(p_name, ' ', 2)] AS fragments, '12' AS number, p_type AS stripped,
CASE WHEN p_size <= 1 THEN 2 WHEN p_size <= 3 THEN 3 WHEN p_size <= 9 THEN 4 WHEN p_size <= 19 THEN 5 ELSE 6 END + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS budget,
'en.' || replace(p_name, ' ', '_') || '.' || lower(p_type) || '.noun.lexicon_wordnet' AS canonical_id, CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 2) ELSE 'manner' END AS parent,
'syn_' || left(sha256(p_brand || ':' || p_size || ':0:ship'), 12) AS claim, p_size % 3 = 0 AS noise, chr(92) || '#' || chr(92) || chr(92) || p_name || chr(92) || 'n' AS escaped, 'syn:en_' || p_partkey AS iri FROM part""")
def text_functions(spark, sf_dir):
    """Tokens, fragments, numbers, stripped glosses, budgets, ids, parents, noise, escapes."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    noise = X.is_noise(F.when(F.col("p_size") % 3 == 0, "-- 7").otherwise(F.col("p_name")))
    return p.select(
        "p_partkey",
        X.gloss_tokens(X.fold(F.concat(F.upper("p_name"), F.lit(" a Café!")))).alias("tokens"),
        X.lemma_fragments(F.concat(words[0], F.lit("'s-"), words[1], F.lit("' x"))).alias("fragments"),
        X.number_word(F.lit("twelve")).alias("number"),
        X.strip_lemma(F.concat("p_name", F.lit(", "), "p_type"), F.initcap("p_name")).alias("stripped"),
        X.token_budget(F.col("p_size"), F.when(F.col("p_size") % 2 == 0, "wikipedia").otherwise("wordnet")).alias("budget"),
        X.canonical_id(F.col("p_name"), F.col("p_type"), F.lit("NOUN"), F.lit("WordNet")).alias("canonical_id"),
        X.fallback_parent(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(words[0]), F.lit("adv")).alias("parent"),
        X.claim_id(F.col("p_brand"), F.col("p_size"), F.lit(0), F.lit("ship")).alias("claim"),
        noise.alias("noise"),
        rskv.encode(F.concat(F.lit("#\\"), "p_name", F.lit("\n"))).alias("escaped"),
        lexical.iri(F.concat(F.lit("en."), "p_partkey")).alias("iri"),
    )


@query("""SELECT p_partkey, p_size % 2 = 0 AS merges, lower(p_type) AS pos FROM (SELECT p_partkey, p_size, CASE p_type WHEN 'PROMO' THEN 'NOUN,VERB' WHEN 'SMALL' THEN 'PROPN' ELSE 'X' END AS p_type FROM part)""")
def similar_names(spark, sf_dir):
    """Names that agree in more than 94 % of their letters, and tags of parts of speech."""
    p = table(spark, sf_dir, "part")
    long = F.concat("p_name", F.lit(" of the northern company"))
    ratio = X.sequence_similarity(long, F.when(F.col("p_size") % 2 == 0, F.concat(long, F.lit("s"))).otherwise(F.col("p_name")))
    tag = F.when(F.col("p_type") == "PROMO", "Noun, v").when(F.col("p_type") == "SMALL", "name").otherwise("odd")
    return p.select("p_partkey", (ratio > 0.94).alias("merges"), F.lower(lexical.normal_pos(tag)).alias("pos"))


@query(f"""SELECT p_partkey, CASE WHEN p_size = 1 THEN 99 ELSE p_size % 7 + 1 END AS rank, CAST(CASE WHEN p_size = 1 THEN 0 ELSE [0.15, 0.10, 0.05, 0.0, -0.05, -0.10, -0.20][p_size % 7 + 1] END AS DOUBLE) AS bonus, [0.6::DOUBLE, 0.8::DOUBLE] AS unit, p_size = 1 OR p_size % 2 = 0 OR p_size % 5 = 0 AS needs_work FROM part""")
def sense_defaults(spark, sf_dir):
    """Ranks and bonuses of tiers with unknown ones, unit vectors, senses that need work."""
    p = table(spark, sf_dir, "part")
    tier = F.when(F.col("p_size") == 1, "odd").otherwise(F.expr(_TIER.replace("label", "p_size")))
    unit = F.transform(retrieval.normalised(F.array(F.col("p_size") * 3.0, F.col("p_size") * 4.0)), lambda x: F.round(x, 6))
    entries = p.select("p_partkey", F.when(F.col("p_size") != 1, F.when(F.col("p_size") % 2 == 0, "abc").otherwise("abcdef")).alias("microgloss"), F.when(F.col("p_size") % 5 != 0, F.lit("2030-01-01").cast("timestamp")).alias("improved_at"))
    work = lexicon.needs_work(entries).select("p_partkey", F.lit(True).alias("w"))
    return p.join(work, "p_partkey", "left").select("p_partkey", tier_rank(tier).alias("rank"), F.round(tier_bonus(tier), 6).alias("bonus"), unit.alias("unit"), F.coalesce("w", F.lit(False)).alias("needs_work"))


# ---------------------------------------------------------------- frames

#: Clauses about a thing {n}, their predicate and agent, and by hand: point of view, statement type,
#: quotation, speech act, scope, condition, polarity, time, mood, hedging.
_CLAUSES = [
    ("If the {n} had broken, he would have left", "left", "he", "author", "counterfactual", "none", "INFORM", "specific", "counterfactual", "positive", None, None, "none"),
    ("Suppose it rains on the {n}", "rains", "it", "author", "hypothetical", "none", "INFORM", "specific", "hypothetical", "positive", None, None, "none"),
    ('He said "{n}" now', "said", "He", "character", "reported_claim", "direct", "INFORM", "specific", None, "positive", None, None, "none"),
    ("Perhaps he might believe the {n}", "believe", "he", "author", "reported_claim", "none", "INFORM", "specific", None, "positive", None, None, "moderate"),
    ("Unless the {n} stops, we go", "go", "we", "author", "conditional", "none", "INFORM", "specific", "conditional", "positive", None, None, "none"),
    ("Makers use the {n}", "use", "Makers", "author", "proven_fact", "none", "INFORM", "generic", None, "positive", "generic", None, "none"),
    ("Please open the {n}", "open", None, "author", "proven_fact", "none", "REQUEST", "specific", None, "positive", None, None, "none"),
    ("He sold the {n} a million times!", "sold", "He", "author", "proven_fact", "none", "EXCLAMATION", "specific", None, "positive", None, "hyperbolic_suspected", "none"),
    ("No {n} was sold in 1770", "sold", "No ring", "author", "proven_fact", "none", "INFORM", "specific", None, "negative", "explicit_date", None, "none"),
    ("Is the {n} new?", "is", "ring", "author", "proven_fact", "none", "QUESTION", "specific", None, "positive", None, None, "none"),
]
_FRAME = ["point_of_view", "statement_type", "quote_type", "speech_act", "scope", "conditional_marker", "verb_polarity", "temporal_anchor", "rhetorical_mood", "hedging_level"]
_STATUS_OF = {"proven_fact": "ASSERTED", "reported_claim": "REPORTED"}


def _sql_cases(values) -> str:
    told = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values))
    return f"CASE p_size % {len(_CLAUSES)} {told} END"


@query("SELECT p_partkey, " + ", ".join(f"{_sql_cases([c[3 + i] for c in _CLAUSES])} AS {name}" for i, name in enumerate(_FRAME)) + f", {_sql_cases([_STATUS_OF.get(c[4], 'HYPOTHETICAL') for c in _CLAUSES])} AS epistemic_status FROM part")
def clause_frames(spark, sf_dir):
    """The frames of clauses about every part."""
    pick = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in _CLAUSES]), F.col("p_size") % len(_CLAUSES) + 1)
    clause = F.replace(pick(0), F.lit("{n}"), F.col("p_name"))
    spokes = F.array(F.struct(F.lit("HAS_AGENT").alias("role"), pick(2).alias("surface")))
    f = framing.frame(clause, pick(1), spokes, F.lit("positive"), ["said", "claimed"])
    out = table(spark, sf_dir, "part").select("p_partkey", f.alias("f"))
    return out.select("p_partkey", *[F.col("f")[n].alias(n) for n in _FRAME], framing.epistemic_status(F.col("f.statement_type")).alias("epistemic_status"))


# ---------------------------------------------------------------- names and mentions


@query("""WITH n AS (SELECT DISTINCT p_type AS doc_id, p_name AS k FROM part WHERE p_size % 3 = 0 UNION SELECT DISTINCT p_type, split_part(p_name, ' ', 2) FROM part WHERE p_size % 2 = 0 UNION SELECT DISTINCT p_type, split_part(p_name, ' ', 1) FROM part WHERE p_size % 7 = 0),
a AS (SELECT n.doc_id, n.k AS name, coalesce(arg_min(m.k, (-len(m.k), m.k)), n.k) AS anchor FROM n LEFT JOIN n m ON m.doc_id = n.doc_id AND ((NOT contains(n.k, ' ') AND contains(m.k, ' ') AND list_contains(string_split(m.k, ' '), n.k)) OR (m.k = 'c' || n.k AND len(n.k) >= 8)) GROUP BY n.doc_id, n.k)
SELECT a.doc_id, a.name, b.anchor FROM a JOIN a b ON b.doc_id = a.doc_id AND b.name = a.anchor""")
def alias_clusters(spark, sf_dir):
    """Names of each document under the longest name that holds all their words, or nearly equals them
    (an "old gear" is taken for a "cold gear")."""
    p = table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    names = p.where("p_size % 3 = 0").select("p_type", F.col("p_name").alias("k")).union(p.where("p_size % 2 = 0").select("p_type", w[1])).union(p.where("p_size % 7 = 0").select("p_type", w[0])).distinct()
    rows = names.select(F.col("p_type").alias("doc_id"), F.concat_ws("/", "p_type", "k").alias("ent_id"), F.col("k").alias("norm_key"), F.lit("org").alias("kind"))
    out = documents.merge_aliases(rows)
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    return out.select("doc_id", name("ent_id").alias("name"), name("anchor").alias("anchor"))


@query("""WITH m AS (SELECT p_type AS doc_id, p_partkey AS sent, CASE p_size % 3 WHEN 0 THEN p_brand END AS person, CASE p_size % 3 WHEN 1 THEN p_name END AS thing, CASE WHEN p_size % 3 = 2 THEN p_size % 4 END AS pro FROM part),
l AS (SELECT *, last_value(lower(person) IGNORE NULLS) OVER w AS a, last_value(lower(thing) IGNORE NULLS) OVER w AS b, last_value(lower(coalesce(person, thing)) IGNORE NULLS) OVER w AS c FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY sent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, CAST(sent AS INTEGER) AS sent, ['it', 'he', 'her', 'they'][pro + 1] AS text, CASE pro WHEN 0 THEN b WHEN 3 THEN c ELSE a END AS antecedent FROM l WHERE pro IS NOT NULL""")
def pronoun_links(spark, sf_dir):
    """What each pronoun of a document means: the nearest person, thing, or either before it."""
    p = table(spark, sf_dir, "part").withColumn("sent", F.col("p_partkey").cast("int")).withColumn("k", F.col("p_size") % 3)
    word = F.element_at(F.array(*[F.lit(x) for x in ("it", "he", "her", "they")]), F.col("p_size") % 4 + 1)
    tokens = p.where("k = 2").select(F.col("p_type").alias("doc_id"), "sent", F.lit(0).alias("idx"), word.alias("text"))
    surface = F.when(F.col("k") == 0, F.col("p_brand")).otherwise(F.col("p_name"))
    found = p.where("k < 2").select(F.col("p_type").alias("doc_id"), "sent", F.lit(0).alias("idx"), surface.alias("surface"), F.when(F.col("k") == 0, "person").otherwise("common").alias("kind"), X.name_key(surface).alias("norm_key"))
    return documents.resolve_pronouns(tokens, found).select("doc_id", "sent", "text", "antecedent")


@query("""SELECT p_brand, p_partkey FROM part p WHERE p_size > 40 AND (p_type = 'PROMO' OR NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_type = 'PROMO' AND q.p_size > 40))""")
def restricted_or_all(spark, sf_dir):
    """Large parts of each brand: the promoted ones, or all where none is promoted."""
    p = table(spark, sf_dir, "part").where("p_size > 40")
    return retrieval.restrict_or_all(p, ["p_brand"], F.col("p_type") == "PROMO").select("p_brand", "p_partkey")


@query("""SELECT o_custkey, count(DISTINCT coalesce(NULLIF(o_orderpriority, '5-LOW'), '')) > 1 OR count(DISTINCT o_orderstatus) > 1 AS diverges FROM orders GROUP BY 1""")
def divergences(spark, sf_dir):
    """Customers whose orders differ in urgency (none is a value) or state."""
    o = table(spark, sf_dir, "orders").withColumn("urgency", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    return retrieval.diverges(o, ["o_custkey"], ["urgency", "o_orderstatus"])


@query("""WITH f AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS form, unnest([p_type, split_part(p_name, ' ', 2), split_part(p_name, ' ', 1)]) AS lemma FROM part), r AS (SELECT p_type AS lemma, min(p_partkey) AS frequency_rank FROM part GROUP BY 1)
SELECT form, lemma, CAST(row_number() OVER (PARTITION BY form ORDER BY CASE WHEN form = lemma THEN 0 ELSE 1 END, coalesce(frequency_rank, 1000000000), lemma) AS INTEGER) AS preference FROM f LEFT JOIN r USING (lemma)""")
def lemma_forms(spark, sf_dir):
    """Lemmas of each form: itself first, then by frequency."""
    p = table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    forms = p.select(w[1].alias("form"), F.explode(F.array("p_type", w[1], w[0])).alias("lemma")).distinct()
    ranks = p.groupBy(F.col("p_type").alias("lemma")).agg(F.min("p_partkey").alias("frequency_rank"))
    return retrieval.resolve_forms(forms, ranks).select("form", "lemma", "preference")


# ---------------------------------------------------------------- small graphs


@query("""WITH e AS (SELECT 'n' || n_nationkey AS s, 'r' || n_regionkey AS d FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier) SELECT s AS src, d AS dst FROM e UNION SELECT a.s, b.d FROM e a JOIN e b ON a.d = b.s""")
def part_closure(spark, sf_dir):
    """Everything that contains each supplier and nation."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    return graph.closure(n.unionByName(s))


@query("""WITH e AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, CASE WHEN event_id % 2 = 0 THEN floor(value / 50) END AS a, CASE WHEN event_id % 3 = 0 THEN event_id % 7 END AS b FROM events)
SELECT x.event_id AS left_id, y.event_id AS right_id FROM e x JOIN e y ON x.user_id = y.user_id AND x.event_type = y.event_type AND x.day = y.day AND x.event_id < y.event_id AND coalesce(x.a = y.a, true) AND coalesce(x.b = y.b, true)""")
def same_events(spark, sf_dir):
    """Events of one user, kind and day whose shared roles have the same fillers."""
    e = table(spark, sf_dir, "events")
    roles = F.map_filter(F.create_map(F.lit("a"), F.when(F.col("event_id") % 2 == 0, F.floor(F.col("value") / 50).cast("string")), F.lit("b"), F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 7).cast("string"))), lambda k, v: v.isNotNull())
    return graph.same_events(e.select("event_id", F.concat_ws(":", "user_id", "event_type").alias("hub"), F.col("ts").cast("date").cast("string").alias("time"), F.lit(None).cast("string").alias("place"), roles.alias("roles")))


@query("""SELECT o_orderkey AS old, least(8 * (o_orderkey // 8) + 7, (SELECT max(o_orderkey) FROM orders) + 1) AS latest FROM orders WHERE o_orderkey % 8 < 7""")
def latest_versions(spark, sf_dir):
    """The last version of each order, where each is superseded by the next up to the eighth."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 8 < 7").select(F.col("o_orderkey").alias("old"), (F.col("o_orderkey") + 1).alias("new"))
    return claims.latest_version(o)


@query("""WITH g AS (SELECT 'shared_entity' AS signal FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 2) UNION ALL SELECT 'shared_predicate' FROM (SELECT event_type FROM events GROUP BY 1 HAVING count(*) >= 2)) SELECT signal, count(*) AS groups FROM g GROUP BY 1""")
def group_signals(spark, sf_dir):
    """How many groups each signal of likeness makes."""
    e = table(spark, sf_dir, "events")
    one = claims.shared_groups(e, "user_id", "event_id").select(F.lit("shared_entity").alias("signal"))
    two = claims.shared_predicates(e, ["event_type"], "event_id").select(F.lit("shared_predicate").alias("signal"))
    return claims.group_signals(one.unionByName(two), "signal")


@query(f"SELECT {_TIER} AS definition_tier, count(*) AS senses, count(embedding) AS embedded FROM embeddings GROUP BY 1")
def store_health(spark, sf_dir):
    """Senses by tier and how many have a vector, as the engine reports them."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry_id"), F.expr(_TIER).alias("definition_tier"), "embedding")
    return lookup.Engine(e).health()


@query("""SELECT o_orderkey, o_totalprice > 200000 AND o_orderpriority LIKE '1%' AS holds FROM orders""")
def registered_predicates(spark, sf_dir):
    """Predicates of a host, by name, in a rule's text."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("urgency"))
    registry = govern.Registry()
    registry.add("dear", lambda x: x > 200000)
    registry.add("begins", lambda x, y: F.startswith(x, y))
    return o.select("o_orderkey", govern.compile_predicate('dear(price) AND begins(urgency, "1")', registry).alias("holds"))


# ---------------------------------------------------------------- messages


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_shipdate > coalesce(least(d, e), d, e) THEN CASE WHEN act IN ('ACCEPT', 'CONFIRM') THEN 'AUDIT_ONLY' ELSE 'EXPIRED' END ELSE 'ADMIT' END AS admission FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN TIMESTAMP '1998-01-01' END AS d, CASE WHEN l_partkey % 3 = 0 THEN TIMESTAMP '1997-01-01' END AS e, CASE WHEN l_returnflag = 'A' THEN 'ACCEPT' WHEN l_returnflag = 'R' THEN 'CONFIRM' ELSE 'PROPOSE' END AS act FROM lineitem)""")
def message_admission(spark, sf_dir):
    """Messages past the stricter of deadline and expiry: kept out, or only logged."""
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    act = F.when(F.col("l_returnflag") == "A", "ACCEPT").when(F.col("l_returnflag") == "R", "CONFIRM").otherwise("PROPOSE")
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("received_at"), F.when(F.col("l_linenumber") % 2 == 0, at("1998-01-01")).alias("deadline"), F.when(F.col("l_partkey") % 3 == 0, at("1997-01-01")).alias("expires_at"), act.alias("act"))
    return messages.admit(m).select("l_orderkey", "l_linenumber", "l_partkey", "admission")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def hourly_counts(spark, sf_dir):
    """Events by hour and type, the batch form of the windowed counts."""
    w = messages.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT least(user_id, event_id % 50) AS "left", greatest(user_id, event_id % 50) AS "right", count(*) AS n, count(*) >= 10 AS promoted FROM events GROUP BY ALL HAVING count(*) >= 5""")
def observed_pairs(spark, sf_dir):
    """Pairs seen five times or more, and those promoted."""
    e = table(spark, sf_dir, "events")
    m = F.col("event_id") % 50
    return messages.discovery_counts(e.select(F.least("user_id", m).alias("left"), F.greatest("user_id", m).alias("right")))
