"""Further queries: histograms, intervals, bridges, audits, exports, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import text as X
from claimloom.operators import claims, retrieval
from claimloom.plans.queries import _PAIRS, _TIER, _hits, _vectors, query, table
from claimloom.sources import lexical


@query(f"SELECT {_TIER} AS tier, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM embeddings) AS DOUBLE), 6) AS share FROM embeddings GROUP BY 1")
def tier_histogram(spark, sf_dir):
    """Senses of each tier and their share."""
    e = table(spark, sf_dir, "embeddings")
    total = e.agg(F.count(F.lit(1)).alias("total"))
    return e.groupBy(F.expr(_TIER).alias("tier")).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("tier", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word ORDER BY n DESC, word LIMIT 20""")
def exploded_histogram(spark, sf_dir):
    """The twenty most frequent values of a list column."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(20)


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate AS s, l_shipdate + INTERVAL 20 DAY AS e FROM lineitem)
SELECT a.l_orderkey, CASE WHEN a.e <= b.s THEN 'BEFORE' WHEN b.e <= a.s THEN 'AFTER' WHEN a.s <= b.s AND b.e <= a.e THEN 'CONTAINS' ELSE 'OVERLAPS' END AS relation, count(*) AS n
FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY ALL""")
def interval_relations(spark, sf_dir):
    """How the delivery windows of an order's lines stand to each other."""
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("s"), (F.col("l_shipdate") + F.expr("INTERVAL 20 DAYS")).alias("e"))
    a, b = i.alias("a"), i.alias("b")
    relation = claims.interval_relation(F.col("a.s"), F.col("a.e"), F.col("b.s"), F.col("b.e"))
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")))
    return pairs.groupBy("a.l_orderkey", relation.alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT n_name, customers, suppliers FROM nation JOIN c ON n_nationkey = c.k JOIN s ON n_nationkey = s.k""")
def class_bridge(spark, sf_dir):
    """Two sources tagged with one closed vocabulary, joined through its classes."""
    return claims.bridged(table(spark, sf_dir, "nation"), "n_nationkey", {"customers": (table(spark, sf_dir, "customer"), "c_nationkey"), "suppliers": (table(spark, sf_dir, "supplier"), "s_nationkey")}).select("n_name", "customers", "suppliers")


@query("""SELECT p_brand, count(DISTINCT p_type) AS domains, count(*) AS nodes, CASE WHEN count(DISTINCT p_type) >= 3 AND count(*) >= 10 THEN 'hub' WHEN count(*) < 3 THEN 'retire' ELSE 'candidate' END AS state FROM part GROUP BY p_brand""")
def hub_lifecycle(spark, sf_dir):
    """Which groups are hubs by their domains and nodes, and which retire."""
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_distinct("p_type").alias("domains"), F.count(F.lit(1)).alias("nodes"))
    return g.withColumn("state", F.when((F.col("domains") >= 3) & (F.col("nodes") >= 10), "hub").when(F.col("nodes") < 3, "retire").otherwise("candidate"))


@query(f"""WITH {_PAIRS.replace(" WHERE vec_id % 20 = 0", "")}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS k FROM s)
SELECT count(*) AS queries, count_if(query_id = vec_id) AS found, count_if(ql = label) AS same_class FROM r WHERE k = 1""")
def self_retrieval_audit(spark, sf_dir):
    """Does every sense retrieve itself?"""
    best = _hits(*_vectors(spark, sf_dir, every=1), 1)
    return best.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("query_id") == F.col("vec_id")).alias("found"), F.count_if(F.col("ql") == F.col("label")).alias("same_class"))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY ALL), d AS (SELECT x.vec_id, c.label AS class, round(sum(CAST(x.v AS DOUBLE) * c.m), 6) AS s FROM x JOIN c ON x.i = c.i GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, class) AS k FROM d) SELECT vec_id, class, s AS score FROM r WHERE k = 1""")
def centroid_tagging(spark, sf_dir):
    """The class whose centroid is nearest to each vector; centroids are one array for each class."""
    return retrieval.nearest_centroid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").select("vec_id", F.col("label").alias("class"), "score")


@query("""SELECT 'MERGE (n:Region {id: ''r' || r_regionkey || '''}) SET n.name = ''' || replace(r_name, '''', '\\''') || ''';' AS value FROM region
UNION ALL SELECT 'MERGE (n:Nation {id: ''n' || n_nationkey || '''}) SET n.name = ''' || replace(n_name, '''', '\\''') || ''';' FROM nation
UNION ALL SELECT 'MATCH (a {id: ''n' || n_nationkey || '''}), (b {id: ''r' || n_regionkey || '''}) MERGE (a)-[:IS_A]->(b);' FROM nation""")
def graph_statements(spark, sf_dir):
    """Nodes and edges as statements; a node defined twice is written once."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("Region").alias("label"), F.col("r_name").alias("name"), F.lit(1).alias("priority"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("Nation").alias("label"), F.col("n_name").alias("name"), F.lit(1).alias("priority"), F.concat(F.lit("r"), "n_regionkey").alias("up"))
    again = r.withColumn("priority", F.lit(2)).withColumn("name", F.lit("other"))
    edges = n.select(F.col("id").alias("src"), F.lit("IS_A").alias("type"), F.col("up").alias("dst"))
    return lexical.cypher_nodes(r.unionByName(again).unionByName(n.drop("up"))).unionByName(lexical.cypher_edges(edges))


@query("""SELECT n_nationkey, to_json({'n_name': n_name, 'n_nationkey': n_nationkey, 'n_regionkey': n_regionkey})::VARCHAR AS payload, 'sha256:' || sha256(to_json({'n_name': n_name, 'n_nationkey': n_nationkey, 'n_regionkey': n_regionkey})::VARCHAR) AS content_hash FROM nation""")
def knowledge_pack(spark, sf_dir):
    """Canonical JSON with its content hash."""
    return lexical.knowledge_pack(table(spark, sf_dir, "nation"), "n_nationkey")


@query("""WITH c AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS synapse_id, l_orderkey, l_partkey, l_suppkey FROM lineitem)
SELECT synapse_id, CAST(l_partkey AS VARCHAR) AS src, 'ship' AS verb, CAST(l_suppkey AS VARCHAR) AS dst FROM c UNION ALL SELECT synapse_id, CAST(l_partkey AS VARCHAR), 'ship', CAST(l_orderkey AS VARCHAR) FROM c UNION ALL SELECT synapse_id, CAST(l_suppkey AS VARCHAR), 'ship', CAST(l_orderkey AS VARCHAR) FROM c""")
def binary_projection(spark, sf_dir):
    """Claims of three roles as pairs of fillers."""
    li = table(spark, sf_dir, "lineitem")
    spoke = lambda r, c: F.struct(F.lit(r).alias("role"), F.col(c).cast("string").alias("target_id"))
    c = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("synapse_id"), F.lit("ship").alias("verb"), F.array(spoke("HAS_PATIENT", "l_partkey"), spoke("HAS_SOURCE", "l_suppkey"), spoke("HAS_DESTINATION", "l_orderkey")).alias("spokes"))
    return lexical.binary_edges(c)


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""")
def upsert_last_wins(spark, sf_dir):
    """Two batches of events merged by key, the later write winning."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return claims.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("SELECT doc_id, CAST(floor(length(coalesce(text, '')) / 4) AS BIGINT) AS tokens FROM documents")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.estimated_tokens(F.col("text")).cast("long").alias("tokens"))


@query("""SELECT p_partkey, CASE WHEN p_size BETWEEN 0 AND 1000 THEN 'int_small' END AS size_type, CASE WHEN floor(p_retailprice) BETWEEN 1000 AND 2099 THEN 'year' WHEN floor(p_retailprice) BETWEEN 0 AND 1000 THEN 'int_small' END AS price_type FROM part""")
def literal_types(spark, sf_dir):
    """Typed literals from surfaces."""
    return table(spark, sf_dir, "part").select("p_partkey", X.literal_type(F.col("p_size").cast("string")).alias("size_type"), X.literal_type(F.floor("p_retailprice").cast("string")).alias("price_type"))


@query("SELECT c_custkey, regexp_replace(trim(regexp_replace(lower(c_name), '\\s+', ' ', 'g')), '^the ', '') AS name_key FROM customer")
def name_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.name_key(F.col("c_name")).alias("name_key"))


@query("""SELECT user_id, max(value) AS confidence, count(DISTINCT event_type) AS tasks, count(DISTINCT event_type) >= 5 AND count(*) >= 30 AND count_if(event_type = 'error') = 0 AS graduates FROM events GROUP BY user_id""")
def graduation(spark, sf_dir):
    """Entries active enough, in enough tasks, and without open conflicts."""
    ready = (F.count_distinct("event_type") >= 5) & (F.count(F.lit(1)) >= 30) & (F.count_if(F.col("event_type") == "error") == 0)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("confidence"), F.count_distinct("event_type").alias("tasks"), ready.alias("graduates"))
