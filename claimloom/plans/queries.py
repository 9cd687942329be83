"""Queries of the engine over the standard tables, each beside its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions import framing
from claimloom.functions import text as X
from claimloom.operators import align, claims, classes, govern, graph, lexicon, retrieval

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- retrieval

_TIER = "CASE label % 7 WHEN 0 THEN 'CORE_ONTOLOGY' WHEN 1 THEN 'CORE_KNOWLEDGE' WHEN 2 THEN 'LEXICAL_EXTENSION' WHEN 3 THEN 'CLAIMED' WHEN 4 THEN 'INFERRED' WHEN 5 THEN 'PROVISIONAL' ELSE 'GHOST' END"
_BONUS = "CASE label % 7 WHEN 0 THEN 0.15 WHEN 1 THEN 0.10 WHEN 2 THEN 0.05 WHEN 3 THEN 0.0 WHEN 4 THEN -0.05 WHEN 5 THEN -0.10 ELSE -0.20 END"
_PAIRS = """q AS (SELECT vec_id AS query_id, embedding AS qv, label AS ql FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, ql, vec_id, label, round(list_inner_product(qv::DOUBLE[], embedding::DOUBLE[]), 6) AS cosine FROM q, embeddings)"""


_HIT = "query_id long, ql int, vec_id long, label int, cosine double, score double"


def _vectors(spark: SparkSession, sf_dir: str, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """The query vectors, ids divisible by ``every``, and all senses."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return e.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), F.col("label").alias("ql")), e.select("vec_id", "embedding", "label")


def _hits(queries: DataFrame, senses: DataFrame, k: int, score=lambda q, x, cosine: cosine) -> DataFrame:
    """The k best senses of each query by ``score``, -inf for those that do not count."""

    def reduce(q, x, cosine):
        s, ids = score(q, x, cosine), x["vec_id"].to_numpy()
        i, j = retrieval.best_places(s, ids, k)
        return {"query_id": q["query_id"].to_numpy()[i], "ql": q["ql"].to_numpy()[i], "vec_id": ids[j], "label": x["label"].to_numpy()[j], "cosine": cosine[i, j], "score": s[i, j]}

    return retrieval.top_k(retrieval.in_blocks(queries, senses, _HIT, reduce), ["query_id"], "score", "vec_id", k)


def _others(q, x, cosine):
    """A query is no candidate of its own."""
    return np.where(q["query_id"].to_numpy()[:, None] == x["vec_id"].to_numpy(), -np.inf, cosine)


@query(f"""WITH {_PAIRS}, p AS (SELECT query_id, vec_id, cosine, round(cosine + CAST({_BONUS} AS DOUBLE) + CASE WHEN label = ql THEN CAST(0.10 AS DOUBLE) ELSE 0 END, 6) AS policy_score FROM s WHERE label % 7 <= 4),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY policy_score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, vec_id, cosine, policy_score, rank FROM r WHERE rank <= 10""")
def vector_topk_policy(spark, sf_dir):
    """Best senses by cosine with policy scoring: tier floor, tier bonus, part-of-speech bonus."""
    queries, senses = _vectors(spark, sf_dir)
    bonus = retrieval.with_policy(senses.withColumn("definition_tier", F.expr(_TIER)).withColumn("cosine", F.lit(0.0)), min_tier=5)

    def score(q, x, cosine):
        same = q["ql"].to_numpy()[:, None] == x["label"].to_numpy()
        return retrieval.half_up(cosine + x["policy_score"].to_numpy() + np.where(same, 0.10, 0.0))

    return _hits(queries, bonus, 10, score).select("query_id", "vec_id", "cosine", F.col("score").alias("policy_score"), "rank")


@query(f"""WITH {_PAIRS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, vec_id, cosine, rank FROM r WHERE rank <= 5 OR vec_id = query_id + 100""")
def vector_topk_pinned(spark, sf_dir):
    """Top five, and a guaranteed member whatever its rank."""
    queries, senses = _vectors(spark, sf_dir)
    pins = senses.select((F.col("vec_id") - 100).alias("query_id"), F.col("embedding").alias("pv"))

    def beaten(q, x, cosine):
        """How many rows of the cell stand before the pinned one."""
        own = retrieval.half_up((np.stack(q["qv"].to_numpy()).astype(float) * np.stack(q["pv"].to_numpy()).astype(float)).sum(1))[:, None]
        pin = q["query_id"].to_numpy()[:, None] + 100
        ids = x["vec_id"].to_numpy()
        before = ((cosine > own) | ((cosine == own) & (ids < pin))) & (ids != pin)
        return {"query_id": q["query_id"].to_numpy(), "vec_id": pin[:, 0], "cosine": own[:, 0], "before": before.sum(1)}

    cells = retrieval.in_blocks(queries.join(pins, "query_id"), senses, "query_id long, vec_id long, cosine double, before long", beaten)
    pinned = cells.groupBy("query_id", "vec_id", "cosine").agg((F.sum("before") + 1).cast("int").alias("rank")).where("rank > 5")
    return _hits(queries, senses, 5).select("query_id", "vec_id", "cosine", "rank").unionByName(pinned)


@query(f"""WITH {_PAIRS}, n AS (SELECT query_id, (cosine - min(cosine) OVER w) / (max(cosine) OVER w - min(cosine) OVER w) AS z FROM s WINDOW w AS (PARTITION BY query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY z DESC) AS k FROM n),
m AS (SELECT query_id, max(CASE WHEN k = 1 THEN z END) - max(CASE WHEN k = 2 THEN z END) AS margin FROM r WHERE k <= 2 GROUP BY query_id)
SELECT query_id, round(margin, 6) AS margin, margin < 0.55 AS fires FROM m""")
def margin_gate(spark, sf_dir):
    """Is the margin between the first two so small that a costlier stage should run?"""
    def ends(q, x, cosine):
        i, j = retrieval.best_places(cosine, x["vec_id"].to_numpy(), 2)
        return {"query_id": q["query_id"].to_numpy()[i], "cosine": cosine[i, j], "lo": cosine.min(1)[i]}

    cells = retrieval.in_blocks(*_vectors(spark, sf_dir), "query_id long, cosine double, lo double", ends)
    two = cells.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("cosine"), False), 1, 2).alias("top"), F.min("lo").alias("lo"))
    hi, lo, second = F.get("top", F.lit(0)), F.col("lo"), F.get("top", F.lit(1))
    m = two.select("query_id", F.when(second.isNull(), 1.0).when(hi - lo < 1e-12, 0.0).otherwise(1 - (second - lo) / (hi - lo)).alias("margin"))
    return m.select("query_id", F.round("margin", 6).alias("margin"), retrieval.should_fire(F.lit("when_tight"), F.col("margin"), 0.55, F.lit(True)).alias("fires"))


_MARKS = X.PUNCTUATION.replace("'", "''")
_TOK = f"list_filter(string_split_regex(translate(lower(#TEXT#), '{_MARKS}', '{' ' * len(X.PUNCTUATION)}'), '\\s+'), lambda x: x <> '')"
_BM25 = f"""t AS (SELECT doc_id, {_TOK.replace('#TEXT#', "coalesce(text, '')")} AS t FROM documents),
z AS (SELECT count(*) AS n, avg(CAST(len(t) AS DOUBLE)) AS mean FROM t),
q AS (SELECT item_id, term, CAST(count(*) AS DOUBLE) AS qtf FROM (SELECT item_id, unnest({_TOK.replace('#TEXT#', 'text')}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, size, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, CAST(len(t) AS DOUBLE) AS size, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
g AS (SELECT item_id, doc_id, round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))), 6) AS bm25 FROM q JOIN p USING (term) JOIN f USING (term), z GROUP BY ALL),
s AS (SELECT i.item_id, d.doc_id, coalesce(g.bm25, 0) AS bm25 FROM benchmark i CROSS JOIN documents d LEFT JOIN g ON g.item_id = i.item_id AND g.doc_id = d.doc_id)"""


def _lexical(spark, sf_dir, k):
    """(documents that hold a term of an item with their score, and with the rest that can be among the
    best k).  What holds no term scores 0, and of that only the k smallest ids can come so far, since
    whatever has a smaller id is at least as good."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    hits = graph.cut(retrieval.bm25(b, d, "item_id", "doc_id", F.col("text"), F.col("text")))  # read twice
    low = d.select("doc_id").orderBy("doc_id").limit(k)  # k rows
    rest = b.select("item_id").join(F.broadcast(low)).join(hits, ["item_id", "doc_id"], "left_anti").select("item_id", "doc_id", F.lit(0.0).alias("bm25"))
    return hits, hits.unionByName(rest)


@query(f"WITH {_BM25}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    """BM25 of every benchmark item over all documents."""
    return retrieval.top_k(_lexical(spark, sf_dir, 5)[1], ["item_id"], "bm25", "doc_id", 5)


_FUSED = f"""WITH {_BM25}, x AS (SELECT *, 1.0::DOUBLE / (1 + doc_id) AS prior FROM s),
m AS (SELECT *, CASE WHEN max(bm25) OVER w - min(bm25) OVER w < 1e-12 THEN 1.0 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END AS zb,
  CASE WHEN max(prior) OVER w - min(prior) OVER w < 1e-12 THEN 1.0 ELSE (prior - min(prior) OVER w) / (max(prior) OVER w - min(prior) OVER w) END AS zp FROM x WINDOW w AS (PARTITION BY item_id)),
v AS (SELECT item_id, doc_id, round(#A# * zp + (1 - #A#) * zb, 6) AS fused FROM m),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS INTEGER) AS rank FROM v) SELECT * FROM r WHERE rank <= 5"""


def _fused(spark, sf_dir, **how):
    hits, s = _lexical(spark, sf_dir, 5)
    n, first, last = table(spark, sf_dir, "documents").agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    if not n:
        return retrieval.top_k(s.select("item_id", "doc_id", F.col("bm25").alias("fused")), ["item_id"], "fused", "doc_id", 5)
    # of all documents: those without a term have 0
    ends = hits.groupBy("item_id").agg(F.when(F.count(F.lit(1)) == n, F.min("bm25")).otherwise(0.0).alias("lo"), F.max("bm25").alias("hi"))
    lexical = retrieval.scaled(F.col("bm25"), F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(0.0)))
    prior = retrieval.scaled(1.0 / (1 + F.col("doc_id")), F.lit(1.0 / (1 + last)), F.lit(1.0 / (1 + first)))
    f = s.join(ends, "item_id", "left").select("item_id", "doc_id", F.round(retrieval.fused(prior, lexical, **how), 6).alias("fused"))
    return retrieval.top_k(f, ["item_id"], "fused", "doc_id", 5)


@query(_FUSED.replace("#A#", "0.7::DOUBLE"))
def bm25_fused(spark, sf_dir):
    """Weighted fusion of a prior and BM25 after min-max normalisation over all documents."""
    return _fused(spark, sf_dir)


@query(_FUSED.replace("#A#", "0.5::DOUBLE"))
def bm25_fused_restricted(spark, sf_dir):
    """Fusion as a lemma restriction asks for: both scores count alike."""
    return _fused(spark, sf_dir, restricted=True)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_inner_product(qv::DOUBLE[], embedding::DOUBLE[]), 6) AS cosine FROM q JOIN embeddings ON vec_id <> query_id),
b AS (SELECT query_id, max(cosine) AS cosine FROM s GROUP BY query_id),
e AS (SELECT CAST(query_id AS BIGINT) AS query_id, count(*) AS senses FROM b JOIN part ON p_size = query_id GROUP BY query_id)
SELECT b.query_id, cosine, CASE WHEN coalesce(senses, 0) = 1 THEN 1 WHEN cosine >= 0.80 THEN 2 WHEN cosine >= 0.65 THEN 3 ELSE 4 END AS level FROM b LEFT JOIN e USING (query_id)""")
def lookup_cascade(spark, sf_dir):
    """The step of the lookup cascade that decides each query."""
    best = _hits(*_vectors(spark, sf_dir), 1, _others)
    exact = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("query_id")).agg(F.count(F.lit(1)).alias("senses"))
    return best.join(exact, "query_id", "left").select("query_id", "cosine", retrieval.lookup_level(F.coalesce("senses", F.lit(0)), F.col("cosine"), F.lit(0.0)).alias("level"))


@query(f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS k FROM s WHERE vec_id <> query_id AND cosine > 0.42)
SELECT q.query_id, r.vec_id, r.cosine FROM q LEFT JOIN r ON r.query_id = q.query_id AND k = 1""")
def batch_search(spark, sf_dir):
    """The best hit for every query, a row of nulls for those without one."""
    queries, senses = _vectors(spark, sf_dir)
    hits = _hits(queries, senses, 1, lambda q, x, cosine: np.where(cosine > 0.42, _others(q, x, cosine), -np.inf))
    return retrieval.best_or_empty(queries.select("query_id").distinct(), hits.select("query_id", "vec_id", "cosine"), "query_id", "cosine", "vec_id")


@query("""WITH k AS (SELECT DISTINCT lower(p_name) AS c FROM part)
SELECT p_partkey, c AS compound FROM part, k WHERE contains(' ' || lower(p_name || ' ' || p_type) || ' ', ' ' || c || ' ')""")
def known_compounds(spark, sf_dir):
    """Word pairs and triples of a text that are known lemmas."""
    part = table(spark, sf_dir, "part")
    return retrieval.known_compounds(part, "p_partkey", F.concat_ws(" ", "p_name", "p_type"), part.select(F.col("p_name").alias("lemma")), "lemma")


def _parts(c):
    return F.array_distinct(F.split(F.lower(F.col(c)), " "))


@query("""WITH q AS (SELECT p_partkey AS query_id, lower(split_part(p_name, ' ', 1)) AS head, [lower(p_brand)] AS isa, list_distinct(string_split(lower(p_type), ' ')) AS parts, p_size FROM part WHERE p_partkey % 20 = 0),
c AS (SELECT p_partkey, lower(p_name) AS lemma, [lower(p_brand)] AS isa, list_distinct(string_split(lower(p_type), ' ')) AS parts, p_size FROM part),
j AS (SELECT q.query_id, c.p_partkey, CASE WHEN contains(c.lemma, q.head) OR contains(q.head, c.lemma) OR list_contains(c.isa, q.head) THEN 0.5::DOUBLE ELSE 0 END AS a,
 len(list_filter(q.isa, lambda x: list_contains(c.isa, x))) / CAST(len(q.isa) AS DOUBLE) * 0.3::DOUBLE AS b, len(list_filter(q.parts, lambda x: list_contains(c.parts, x))) / CAST(len(q.parts) AS DOUBLE) * 0.2::DOUBLE AS d FROM q JOIN c ON q.p_size = c.p_size)
SELECT query_id, p_partkey, round(least((a + b + d) / 1.0::DOUBLE, 1), 4) AS struct_score FROM j""")
def slot_overlap(spark, sf_dir):
    """Structural overlap: every twentieth part as a query against all parts of its size.  Parts alike
    in all that counts are scored once, then stand for each of their pairs."""
    part = table(spark, sf_dir, "part")
    c = part.select("p_partkey", "p_size", F.lower("p_name").alias("lemma"), F.array(F.lower("p_brand")).alias("isa"), _parts("p_type").alias("parts"))
    q = c.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), "p_size", F.split("lemma", " ")[0].alias("head"), F.col("isa").alias("q_isa"), F.col("parts").alias("q_parts"))
    score = retrieval.slot_overlap(F.col("head"), F.col("q_isa"), F.col("q_parts"), F.array().cast("array<string>"), F.col("lemma"), F.col("isa"), F.col("parts"))
    asked, held = classes.dealt(classes.classes(q, "query_id", "queries"), classes.classes(c, "p_partkey", "entries"), ["p_size"])
    pairs = asked.join(held, ["p_size", "_salt"]).select("queries", "entries", score.alias("struct_score"))
    return pairs.select(F.explode("queries").alias("query_id"), "entries", "struct_score").select("query_id", F.explode("entries").alias("p_partkey"), "struct_score")


@query()
def fingerprint_hamming(spark, sf_dir):
    """For every twentieth vector all others whose 516-bit fingerprints differ in at most 185 places."""
    prints = retrieval.fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return retrieval.hamming_search(prints.where("vec_id % 20 = 0"), prints, "vec_id", 185)


# ---------------------------------------------------------------- lexicon


@query("""SELECT fragment, count(DISTINCT p_partkey) AS entries FROM (SELECT p_partkey, unnest(string_split_regex(replace(lower(trim(p_name)), '-', ' '), '[^a-z0-9'']+')) AS fragment FROM part) WHERE len(fragment) >= 2 GROUP BY fragment""")
def fragment_index_df(spark, sf_dir):
    """Document frequency of lemma fragments."""
    index = lexicon.postings(table(spark, sf_dir, "part"), "p_partkey", F.col("p_name"))
    return index.groupBy("fragment").agg(F.count_distinct("p_partkey").alias("entries"))


@query("""WITH f AS (SELECT DISTINCT p_partkey, unnest(string_split_regex(replace(lower(p_name || ' ' || p_type), '-', ' '), '[^a-z0-9'']+')) AS fragment FROM part),
q AS (SELECT item_id, f FROM (VALUES (1, 'brushed'), (1, 'steel'), (2, 'promo'), (2, 'tin'), (3, 'economy')) v(item_id, f)),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id)
SELECT CAST(q.item_id AS BIGINT) AS query_id, p_partkey FROM f JOIN q ON f.fragment = q.f JOIN n ON n.item_id = q.item_id GROUP BY q.item_id, p_partkey HAVING count(*) = max(n.n)""")
def posting_intersection(spark, sf_dir):
    """Entries that hold every fragment of a query."""
    index = lexicon.postings(table(spark, sf_dir, "part"), "p_partkey", F.concat_ws(" ", "p_name", "p_type"))
    asked = spark.createDataFrame([(1, "brushed"), (1, "steel"), (2, "promo"), (2, "tin"), (3, "economy")], "query_id long, fragment string")
    return lexicon.holding_all(index, asked, "p_partkey")


@query("SELECT p_brand, p_type, count(*) AS senses FROM part GROUP BY ALL")
def polysemy_counts(spark, sf_dir):
    return lexicon.polysemy(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def uniqueness_violations(spark, sf_dir):
    from claimloom.model import not_unique

    return not_unique(table(spark, sf_dir, "documents"), ["text"])


@query("SELECT lower(n_name) AS lemma, count(*) AS centrality FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def centrality(spark, sf_dir):
    """In-degree of parent lemmas."""
    r = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return lexicon.centrality(r, "n_name")


@query("""SELECT o_custkey, count(*) AS orders, min(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) AS priority FROM orders GROUP BY o_custkey HAVING count(*) >= 5""")
def priority_min_case(spark, sf_dir):
    """Work selection: groups of enough members with their most urgent state."""
    urgent = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(3)
    return lexicon.urgent_groups(table(spark, sf_dir, "orders"), ["o_custkey"], urgent, 5).withColumnRenamed("n", "orders")


@query("""WITH s AS (SELECT p_partkey, p_brand, p_type, p_name FROM part)
SELECT a.p_partkey, a.p_brand, a.p_type, list_sort(list_distinct(list(b.p_name))) AS synonyms FROM s a JOIN s b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_name <> b.p_name GROUP BY ALL""")
def synonym_sets(spark, sf_dir):
    """Names that share brand and type."""
    return lexicon.synonyms(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_partkey", "p_name")


@query("""SELECT conv_id, list(text ORDER BY turn, text)[1] AS first, array_to_string(list(text ORDER BY turn, text)[2:], '; ') AS rest, CAST(count(*) AS INTEGER) AS n FROM conversations GROUP BY conv_id""")
def ordered_merge(spark, sf_dir):
    """First gloss, and the others in order."""
    return lexicon.ordered_merge(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


@query("SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = o.o_orderkey)")
def anti_join_dedup(spark, sf_dir):
    """Rows to insert only where their key is absent, each once."""
    old = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("o_orderkey"))
    return claims.insert_absent(old, table(spark, sf_dir, "orders"), ["o_orderkey"], "o_custkey").select("o_orderkey", "o_custkey")


_STOPS = ", ".join(f"'{w}'" for w in lexicon.STOP)


@query(f"""WITH e AS (SELECT p_partkey AS entry_id, lower(p_type) AS lemma, list_filter(regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_size || 'mm'), '[a-z0-9]+'), lambda x: len(x) >= 2 AND x <> lower(p_type) AND x NOT IN ({_STOPS})) AS words FROM part),
c AS (SELECT lemma, CASE WHEN count(*) <= 1 THEN 2 WHEN count(*) <= 3 THEN 3 WHEN count(*) <= 9 THEN 4 WHEN count(*) <= 19 THEN 5 ELSE 6 END AS budget FROM e GROUP BY 1),
n AS (SELECT e.*, array_to_string(words[1:least(budget, 2)], '_') AS base FROM e JOIN c USING (lemma)),
k AS (SELECT lemma, base FROM n GROUP BY ALL HAVING count(*) > 1), x AS (SELECT entry_id, lemma, base, unnest(words) AS word, unnest(generate_series(0, len(words) - 1)) AS pos FROM n JOIN k USING (lemma, base)),
h AS (SELECT lemma, base, word, count(*) - 1 AS others FROM x GROUP BY ALL),
s AS (SELECT x.*, least(len(word) / 10.0::DOUBLE, 2.0::DOUBLE) - 5 * others + CASE WHEN regexp_matches(word, '[0-9]') THEN 1 ELSE 0 END - CASE WHEN len(word) <= 3 THEN 1 ELSE 0 END AS score, list_contains(string_split(base, '_'), word) AS inside FROM x JOIN h USING (lemma, base, word)),
r AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, len(word) DESC, word) AS k, row_number() OVER (PARTITION BY entry_id ORDER BY inside, pos) AS p FROM s),
m AS (SELECT entry_id, list(word ORDER BY k) FILTER (k <= 2 AND score > -3 AND NOT inside) AS best, list(word ORDER BY p) FILTER (NOT inside AND p <= 2) AS rest FROM r GROUP BY 1),
f AS (SELECT n.*, concat_ws('_', base, NULLIF(array_to_string(CASE WHEN len(coalesce(best, [])) > 0 THEN best ELSE coalesce(rest, []) END, '_'), '')) AS fresh FROM n LEFT JOIN m USING (entry_id)),
u AS (SELECT *, row_number() OVER (PARTITION BY lemma, base, fresh ORDER BY entry_id) AS k FROM f)
SELECT entry_id, lemma, CASE WHEN k = 1 THEN fresh ELSE base || '_' || left(sha1(CAST(entry_id AS VARCHAR)), 4) END AS microgloss FROM u""".replace("least(budget, 2)", "budget"))
def microglosses(spark, sf_dir):
    """Distinct glosses of parts as senses of their type."""
    part = table(spark, sf_dir, "part")
    gloss = F.concat(F.concat_ws(" ", "p_name", "p_brand", "p_size"), F.lit("mm"))
    entries = part.select(F.col("p_partkey").alias("entry_id"), F.lower("p_type").alias("lemma"), gloss.alias("gloss"), F.lit("NOUN").alias("pos_ud"), F.lit("wordnet").alias("source_type"))
    return lexicon.distinct_glosses(entries).select("entry_id", "lemma", "microgloss")


# ---------------------------------------------------------------- claims


@query("SELECT user_id, list_sort(list_distinct(list(event_id))) AS members, CAST(count(DISTINCT event_id) AS INTEGER) AS size FROM events GROUP BY user_id HAVING count(DISTINCT event_id) >= 2")
def shared_entity_groups(spark, sf_dir):
    """Events that share a participant."""
    return claims.shared_groups(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 2")
def shared_predicate_groups(spark, sf_dir):
    """Events with one predicate and participant."""
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("SELECT conv_id, CAST(floor(turn / 3) AS BIGINT) AS bucket, count(turn) AS size, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY ALL HAVING count(turn) >= 2")
def discourse_buckets(spark, sf_dir):
    return claims.discourse_buckets(table(spark, sf_dir, "conversations"), "conv_id", "turn", "turn")


def _spokes(spark, sf_dir):
    """A line item as a claim: who ordered, what, from whom, when."""
    li = table(spark, sf_dir, "lineitem").withColumn("synapse_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    roles = {"HAS_PATIENT": "l_partkey", "HAS_SOURCE": "l_suppkey", "HAS_DESTINATION": "l_orderkey"}
    return li.select("synapse_id", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).cast("long").alias("target_id")) for r, c in roles.items()])).alias("s")).select("synapse_id", "s.*")


@query("""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS synapse_id, min(l_orderkey) AS HAS_DESTINATION FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) AND l_suppkey IN (1, 2, 3, 4, 5) GROUP BY 1""")
def pattern_query(spark, sf_dir):
    """Who received a part of size 7 from one of five suppliers?  Filled roles bound, one open.
    The parts meant are found by a join, not by a list."""
    spokes = _spokes(spark, sf_dir)
    parts = table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("target_id"))
    meant = spokes.where("role = 'HAS_PATIENT'").join(parts, "target_id", "left_semi").select("synapse_id").distinct()
    return claims.match_pattern(spokes.join(meant, "synapse_id", "left_semi"), {"HAS_SOURCE": [1, 2, 3, 4, 5]}, ["HAS_DESTINATION"])


@query("""WITH p AS (SELECT * FROM (VALUES (1, '7', 'O', 'x'), (2, '12', 'P', '3-MEDIUM'), (3, '30', 'F', '1-URGENT')) v(query_id, a, b, c)),
f AS (SELECT CAST(query_id AS BIGINT) AS query_id, unnest([{'role': 'cust', 'filler': a}, {'role': 'status', 'filler': b}, {'role': 'urgency', 'filler': c}], recursive := true) FROM p),
o AS (SELECT o_orderkey, unnest([{'role': 'cust', 'filler': CAST(o_custkey AS VARCHAR)}, {'role': 'status', 'filler': o_orderstatus}, {'role': 'urgency', 'filler': o_orderpriority}], recursive := true) FROM orders),
g AS (SELECT query_id, o_orderkey, count(*) AS agreed, list_sort(list(role)) AS same FROM f JOIN o USING (role, filler) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY agreed DESC, o_orderkey) AS INTEGER) AS rank FROM g)
SELECT query_id, o_orderkey, agreed, rank, array_to_string(list_filter(['cust', 'status', 'urgency'], lambda x: NOT list_contains(same, x)), ',') AS missing FROM r WHERE rank <= 2""")
def pattern_gap_report(spark, sf_dir):
    """The claims closest to a pattern that nothing meets, and the roles on which they differ."""
    patterns = spark.createDataFrame([(1, "7", "O", "x"), (2, "12", "P", "3-MEDIUM"), (3, "30", "F", "1-URGENT")], "query_id long, cust string, status string, urgency string")
    held = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("urgency"))
    return claims.gap_report(patterns, held, ["cust", "status", "urgency"], "o_orderkey").select("query_id", "o_orderkey", "agreed", "rank", F.array_join("missing", ",").alias("missing"))


@query("SELECT user_id, count(DISTINCT event_id) AS events FROM events GROUP BY user_id HAVING count(DISTINCT event_id) >= 2")
def participant_test(spark, sf_dir):
    return claims.participants(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("""WITH s AS (SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_brand) SELECT p_brand, lo, hi, lo <= 5 AND hi >= 40 AS covers FROM s""")
def range_cover(spark, sf_dir):
    """Does each brand's range of sizes contain the range asked for?"""
    s = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    return s.withColumn("covers", claims.range_covers(F.col("lo"), F.col("hi"), F.lit(5), F.lit(40)))


@query("""SELECT * FROM (SELECT user_id, event_id AS source, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target, 'PRECEDES' AS link_type FROM events) WHERE target IS NOT NULL""")
def precedes_links(spark, sf_dir):
    return claims.precedes(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_id")


@query("""SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) = 1 AS preferred FROM documents""")
def preferred_sense(spark, sf_dir):
    return claims.preferred(table(spark, sf_dir, "documents"), ["lang", "source"], "n_chars", "doc_id").select("doc_id", "lang", "source", "preferred")


@query("""SELECT conv_id, turn, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), ' ') AS context FROM conversations""")
def context_window(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", claims.context(c, ["conv_id"], "turn", "text").alias("context"))


@query("""WITH p AS (SELECT user_id, ts, max(event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY ALL),
e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')
SELECT e.event_id, e.user_id, (SELECT arg_max(p.purchase, p.ts) FROM p WHERE p.user_id = e.user_id AND p.ts < e.ts) AS purchase FROM e""")
def asof_nearest_preceding(spark, sf_dir):
    """For each error the user's latest purchase strictly before it."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    right = e.where("event_type = 'purchase'").groupBy("user_id", "at").agg(F.max("event_id").alias("purchase"))
    return claims.nearest_preceding(e.where("event_type = 'error'").select("event_id", "user_id", "at"), right, "user_id", "at", "purchase").select("event_id", "user_id", "purchase")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, o_orderdate AS valid_from, l_shipdate AS valid_until FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber FROM v WHERE valid_from <= TIMESTAMP '1996-06-01' AND (valid_until IS NULL OR TIMESTAMP '1996-06-01' < valid_until)""")
def bitemporal_as_of(spark, sf_dir):
    """Lines ordered but not shipped at a time."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("valid_from"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("valid_until"))
    return claims.as_of(li.join(o, "l_orderkey"), F.lit("1996-06-01").cast("timestamp_ntz")).select("l_orderkey", "l_linenumber")


@query("""WITH c AS (SELECT *, CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 4 ELSE 6 END AS tier_rank FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY tier_rank, l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey, l_quantity) AS k FROM c WHERE tier_rank <= 4)
SELECT l_partkey, l_orderkey, l_linenumber, tier_rank FROM r WHERE k = 1""")
def trust_lens_resolve(spark, sf_dir):
    """The claim about each part by authority, then recency, among trusted tiers."""
    rank = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 4).otherwise(6)
    seen = claims.trust_lens(table(spark, sf_dir, "lineitem").withColumn("tier_rank", rank), most_rank=4)
    order = [F.asc("tier_rank"), F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_suppkey"), F.asc("l_quantity")]
    return claims.resolve_conflicts(seen, ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_linenumber", "tier_rank")


@query("""SELECT source, count(*) AS total, count_if(quality IS NOT NULL) AS matched, count_if(quality IS NULL) AS minted, count_if(coalesce(toxic, 0) = 1) AS snapped,
round(count_if(quality IS NULL) / CAST(count(*) AS DOUBLE), 6) AS oov, count_if(quality IS NULL) / CAST(count(*) AS DOUBLE) > 0.6 AS halts FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def coverage_report(spark, sf_dir):
    """How much of each source is covered, and whether the gate halts it."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return claims.coverage(j, ["source"], F.col("quality").isNotNull(), F.col("toxic") == 1, 0.6)


_STATUS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS item, count(*) AS n FROM {t}" for t in _STATUS))
def store_status(spark, sf_dir):
    return claims.row_counts({t: table(spark, sf_dir, t) for t in _STATUS})


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def last_value_snapshot(spark, sf_dir):
    """The last value for each entity of an event store."""
    return claims.last_values(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["value", "ts"])


@query("""SELECT event_type, count(*) AS n, round(sum(value * exp(-ln(2.0) * date_diff('day', CAST(ts AS DATE), DATE '2030-01-01') / 365.0)), 4) AS weight FROM events GROUP BY event_type""")
def validity_decay(spark, sf_dir):
    """Values weighted by a half-life of a year."""
    age = F.datediff(F.lit("2030-01-01").cast("date"), F.col("ts").cast("date")).cast("double")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(claims.decayed(F.col("value"), age, 365.0)), 4).alias("weight"))


@query("""WITH p AS (SELECT DISTINCT e.user_id, e.event_type FROM events e) SELECT a.event_type AS left_type, b.event_type AS right_type, count(*) AS contexts, count(*) >= 10 AS promoted
FROM p a JOIN p b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL HAVING count(*) >= 5""")
def discovered_edges(spark, sf_dir):
    """Types that occur together for five users or more; promoted at ten.  Pairs are made from each
    user's few distinct types, not from events."""
    types = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("t"))
    pairs = types.select("user_id", F.posexplode("t").alias("i", "left_type"), "t").select("user_id", "left_type", F.explode(F.expr("slice(t, i + 2, size(t))")).alias("right_type"))
    return claims.discovered(pairs, "left_type", "right_type", "user_id")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'canonical' WHEN o_totalprice >= 100000 THEN 'provisional' WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'candidate' ELSE 'expired' END AS tier FROM orders""")
def vault_tiers(spark, sf_dir):
    confidence = F.when(F.col("o_totalprice") >= 200000, 0.7).when(F.col("o_totalprice") >= 100000, 0.5).otherwise(0.1)
    age = F.when(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"), 0).otherwise(91)
    return table(spark, sf_dir, "orders").select("o_orderkey", claims.vault_tier(confidence, age).alias("tier"))


# ---------------------------------------------------------------- graphs


def _hierarchy(spark, sf_dir, orders=False):
    """Customer to nation to region as IS_A edges."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    return n.unionByName(c)


_EDGES = "e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


@query(f"""WITH RECURSIVE {_EDGES}, w(origin, node, depth) AS (SELECT DISTINCT src, src, 0 FROM e WHERE src LIKE 'c%' UNION ALL SELECT w.origin, e.dst, depth + 1 FROM w JOIN e ON w.node = e.src WHERE depth < 2)
SELECT origin, node, min(depth) AS depth FROM w GROUP BY ALL""")
def ancestors_bounded(spark, sf_dir):
    """Ancestors of every customer within two hops."""
    e = _hierarchy(spark, sf_dir)
    return graph.ancestors(e, e.where("src LIKE 'c%'").select(F.col("src").alias("node")), 2)


@query(f"""WITH RECURSIVE {_EDGES}, w(node) AS (SELECT 'r1' UNION SELECT e.src FROM w JOIN e ON e.dst = w.node) SELECT node FROM w""")
def grounding_reach(spark, sf_dir):
    """Everything grounded in one root."""
    return graph.reach(_hierarchy(spark, sf_dir), spark.createDataFrame([("r1",)], "node string"))


@query(f"""WITH {_EDGES}, x AS (SELECT * FROM e UNION ALL SELECT 'r0', 'n0' WHERE (SELECT n_regionkey FROM nation WHERE n_nationkey = 0) = 0) SELECT src, dst FROM x WHERE (src, dst) IN (('r0', 'n0'), ('n0', 'r0')) OR (src IN ('r0', 'n0') AND dst IN ('r0', 'n0'))""")
def cyclic_core(spark, sf_dir):
    """A cycle planted in the hierarchy: what peeling leaves, without the tails that hang off it."""
    back = table(spark, sf_dir, "nation").where("n_nationkey = 0 AND n_regionkey = 0").select(F.lit("r0").alias("src"), F.lit("n0").alias("dst"))
    core = graph.cyclic_core(_hierarchy(spark, sf_dir).unionByName(back))
    return graph.cyclic_core(core.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("dst").alias("src"), F.col("src").alias("dst"))


@query(f"""WITH {_EDGES} SELECT a.src AS origin, array_to_string([a.src, a.dst, b.dst], '>') AS path FROM e a JOIN e b ON a.dst = b.src WHERE b.dst IN ('r0', 'r1')""")
def canonical_chain(spark, sf_dir):
    """The shortest chain from each customer to a prime."""
    e = _hierarchy(spark, sf_dir)
    goals = spark.createDataFrame([("r0",), ("r1",)], "node string")
    return graph.chains(e, e.where("src LIKE 'c%'").select(F.col("src").alias("node")), goals, 2).select("origin", F.array_join("path", ">").alias("path"))


# ---------------------------------------------------------------- framing, rules, alignment


@query("""SELECT conv_id, turn,
CASE WHEN trim(lower(text)) LIKE 'can you%' OR trim(lower(text)) LIKE 'could you%' OR trim(lower(text)) LIKE 'would you%' OR trim(lower(text)) LIKE 'will you%' OR trim(lower(text)) LIKE 'could i ask you to%' OR trim(lower(text)) LIKE 'please %' OR contains(left(trim(lower(text)), 30), ' please ') THEN 'REQUEST'
 WHEN rtrim(text) LIKE '%?' THEN 'QUESTION' WHEN rtrim(text) LIKE '%!' THEN 'EXCLAMATION' WHEN regexp_matches(trim(lower(text)), '^(?:i|we)\\s+(?:will|''ll|promise|swear|guarantee)\\b') THEN 'PROMISE'
 WHEN regexp_extract(trim(lower(text)), '^\\s*(\\S+)', 1) IN (""" + ", ".join("'" + w.replace("'", "''") + "'" for w in framing.COMMANDS) + """) THEN 'COMMAND' ELSE 'INFORM' END AS speech_act,
CASE len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z'']+')), lambda x: x IN (""" + ", ".join(f"'{w}'" for w in framing.HEDGES) + """))) WHEN 0 THEN 'none' WHEN 1 THEN 'light' WHEN 2 THEN 'moderate' WHEN 3 THEN 'moderate' ELSE 'heavy' END AS hedging_level,
regexp_matches(text, '\\b(?:1[0-9]|20)\\d{2}\\b') AS dated FROM conversations""")
def speech_act_frames(spark, sf_dir):
    """Speech act, hedging and dates of every turn."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", framing.speech_act(t).alias("speech_act"), framing.hedging(t).alias("hedging_level"), t.rlike(framing.YEAR).alias("dated"))


@query()
def claim_frames(spark, sf_dir):
    """The whole frame of every turn, its role as agent."""
    spokes = F.array(F.struct(F.lit("HAS_AGENT").alias("role"), F.col("role").alias("surface")))
    f = framing.frame(F.col("text"), F.split("text", " ")[0], spokes, F.lit("positive"), ["said", "claimed"])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", f.alias("f")).select("conv_id", "turn", "f.*", framing.epistemic_status(F.col("f.statement_type")).alias("epistemic_status"))


@query("""WITH f AS (SELECT o_orderkey, 'r1' AS rule_id, 10 AS priority, 'DENY' AS status FROM orders WHERE o_totalprice > 300000
UNION ALL SELECT o_orderkey, 'r2', 5, 'ALLOW' FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, 'r3', 5, CASE WHEN o_totalprice < 1000 THEN 'DENY' WHEN NULLIF(o_orderpriority, '5-LOW') IS NULL THEN 'UNKNOWN' END FROM orders WHERE o_totalprice < 1000 OR o_orderpriority = '5-LOW'),
b AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY priority DESC, CASE status WHEN 'DENY' THEN 0 WHEN 'UNKNOWN' THEN 1 ELSE 2 END, rule_id) AS k FROM f)
SELECT o.o_orderkey, coalesce(b.status, 'DENY') AS verdict, coalesce(b.rule_id, 'default') AS decided_by FROM orders o LEFT JOIN b ON b.o_orderkey = o.o_orderkey AND k = 1""")
def governance_verdicts(spark, sf_dir):
    """Rules over orders as proposals; a missing observation gives UNKNOWN, no rule gives DENY."""
    o = table(spark, sf_dir, "orders").withColumn("urgency", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    rules = [
        {"rule_id": "r1", "priority": 10, "effect": "DENY", "scope": F.lit(True), "predicate": govern.compile_predicate("o_totalprice > 300000")},
        {"rule_id": "r2", "priority": 5, "effect": "ALLOW", "scope": F.lit(True), "predicate": govern.compile_predicate('o_orderstatus IN ["O"]')},
        {"rule_id": "r3", "priority": 5, "effect": "DENY", "scope": F.lit(True), "predicate": F.when(F.col("o_totalprice") < 1000, True).when(F.col("urgency").isNull(), F.lit(None).cast("boolean")).otherwise(False)},
    ]
    return govern.verdicts(o.select("o_orderkey"), govern.contributions(o, rules, "o_orderkey"), "o_orderkey")


@query("""WITH m AS (SELECT event_id, ts, user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS seen FROM events)
SELECT event_id, CASE WHEN user_id IS NULL THEN 'schema' WHEN ts < TIMESTAMP '2024-01-02' THEN 'expiry' WHEN seen > 50 THEN 'replay' WHEN event_type = 'error' THEN 'authority' WHEN NOT value > 1 THEN 'policy' END AS failed_gate FROM m""")
def admission_gates(spark, sf_dir):
    """The first gate that a message fails, in fixed order."""
    seen = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    m = table(spark, sf_dir, "events").withColumn("seen", seen)
    gates = [("schema", F.col("user_id").isNotNull()), ("expiry", F.col("ts") >= F.lit("2024-01-02").cast("timestamp_ntz")), ("replay", F.col("seen") <= 50), ("authority", F.col("event_type") != "error"), ("policy", F.col("value") > 1)]
    return m.select("event_id", govern.first_failure(gates).alias("failed_gate"))


@query("""WITH s AS (SELECT p_brand, 'size' AS slot, list_sort(list_distinct(list(CAST(p_size AS VARCHAR)))) AS f FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'type', list_sort(list_distinct(list(p_type))) FROM part GROUP BY 1),
c AS (SELECT a.p_brand AS left_id, b.p_brand AS right_id, a.slot, len(list_filter(a.f, lambda x: list_contains(b.f, x))) / CAST(len(a.f) AS DOUBLE) AS score FROM s a JOIN s b ON a.slot = b.slot AND a.p_brand <> b.p_brand)
SELECT left_id, right_id, round(avg(score), 6) AS overall, bool_and(score >= 1) AS complies, CASE WHEN avg(score) >= 1 THEN 'EXACT' WHEN avg(score) >= 0.8 THEN 'VERY STRONG' WHEN avg(score) >= 0.6 THEN 'STRONG' WHEN avg(score) >= 0.4 THEN 'MODERATE' WHEN avg(score) >= 0.2 THEN 'WEAK' ELSE 'NONE' END AS confidence,
array_to_string(list_sort(list(slot) FILTER (score < 1)), ',') AS gaps FROM c GROUP BY ALL""")
def alignment_report(spark, sf_dir):
    """Brands aligned slot by slot: sizes and types that one has and the other lacks; without gaps, null."""
    part = table(spark, sf_dir, "part")
    slots = part.groupBy(F.col("p_brand").alias("id")).agg(F.sort_array(F.collect_set(F.col("p_size").cast("string"))).alias("size"), F.sort_array(F.collect_set("p_type")).alias("type"))
    long = slots.select("id", F.explode(F.array(F.struct(F.lit("size").alias("slot"), F.col("size").alias("fillers")), F.struct(F.lit("type").alias("slot"), F.col("type").alias("fillers")))).alias("s")).select("id", "s.*")
    ids = slots.select("id").withColumn("k", F.lit(1))  # brands, a closed list
    pairs = ids.select(F.col("id").alias("left_id"), "k").join(ids.select(F.col("id").alias("right_id"), "k"), "k").where("left_id <> right_id").drop("k")
    r = align.report(align.compare_slots(long, long, pairs))
    return r.select("left_id", "right_id", F.round("overall", 6).alias("overall"), "complies", "confidence", F.when(F.size("gaps") > 0, F.array_join("gaps", ",")).alias("gaps"))


@query("""SELECT p_partkey, p_size * 0.0254::DOUBLE AS metres, p_size * 0.0254::DOUBLE >= 0.5 - 0.05 AS meets FROM part""")
def metric_constraints(spark, sf_dir):
    """Sizes in inches against a requirement in metres with a tolerance."""
    si = align.si_value(F.col("p_size").cast("double"), F.lit("in"))
    return table(spark, sf_dir, "part").select("p_partkey", si.alias("metres"), align.meets(F.lit(0.5), F.lit(">="), F.lit(0.05), si).alias("meets"))


@query("""WITH p AS (SELECT DISTINCT p_brand, p_type, p_name, string_split(p_name, ' ') AS w FROM part)
SELECT a.p_brand, a.p_type, a.p_name AS left_name, b.p_name AS right_name FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_name < b.p_name AND a.w[1] = b.w[1] AND a.w[len(a.w)] <> b.w[len(b.w)]""")
def conflict_checks(spark, sf_dir):
    """Within a problem cluster, nodes with the same trigger that demand different outcomes."""
    f = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_name", F.split("p_name", " ")[0].alias("t"), F.element_at(F.split("p_name", " "), -1).alias("goal")).distinct()
    a, b = f.alias("a"), f.alias("b")
    hit = (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_type") == F.col("b.p_type")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.p_name") < F.col("b.p_name")) & (F.col("a.goal") != F.col("b.goal"))
    return a.join(b, hit).select("a.p_brand", "a.p_type", F.col("a.p_name").alias("left_name"), F.col("b.p_name").alias("right_name"))


@query("""SELECT 'named' AS validator, count_if(NOT coalesce(p_name <> '', false)) AS failed, count(*) AS total FROM part UNION ALL SELECT 'priced', count_if(NOT coalesce(p_retailprice > 0, false)), count(*) FROM part UNION ALL SELECT 'sized', count_if(NOT coalesce(p_size BETWEEN 1 AND 40, false)), count(*) FROM part""")
def validators(spark, sf_dir):
    return govern.validators(table(spark, sf_dir, "part"), {"named": F.col("p_name") != "", "priced": F.col("p_retailprice") > 0, "sized": F.col("p_size").between(1, 40)})
