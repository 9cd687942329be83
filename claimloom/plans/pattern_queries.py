"""Queries of patterns, wisdom, rules, alignment, documents and answers, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import answers
from claimloom.functions import text as X
from claimloom.operators import align, claims, documents, govern, patterns
from claimloom.plans.queries import _spokes, query, table
from claimloom.sources import blocks, lexical, rskv

# ---------------------------------------------------------------- patterns


@query("""WITH k AS (SELECT p_partkey FROM part WHERE p_type = 'PROMO' OR p_brand IN ('Brand#1', 'Brand#2'))
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS synapse_id, list(DISTINCT l_orderkey) AS HAS_DESTINATION FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM k) AND l_suppkey <= 5 GROUP BY 1""")
def kinds_pattern(spark, sf_dir):
    """Who received any kind of promoted or branded part from one of the first suppliers?  Kinds are
    found down the hierarchy of types and brands."""
    p = table(spark, sf_dir, "part")
    leaf = F.concat(F.lit("p"), "p_partkey")
    up = p.select(leaf.alias("src"), F.col("p_type").alias("dst")).unionByName(p.select(leaf.alias("src"), F.col("p_brand").alias("dst")))
    up = up.unionByName(spark.createDataFrame([("PROMO", "meant"), ("Brand#1", "meant"), ("Brand#2", "meant")], "src string, dst string"))
    kinds = patterns.kinds_of(spark.createDataFrame([("meant",)], "asked string"), up, 2)
    parts = kinds.where("target LIKE 'p%' AND target RLIKE '^p[0-9]+$'").select(F.substring("target", 2, 20).cast("long").alias("target")).distinct()
    few = table(spark, sf_dir, "supplier").where("s_suppkey <= 5").select(F.col("s_suppkey").alias("target"))
    return patterns.match(_spokes(spark, sf_dir), {"HAS_PATIENT": parts, "HAS_SOURCE": few}, ["HAS_DESTINATION"])


@query("""SELECT o_orderkey, o_custkey, {'o_orderdate': strftime(o_orderdate, '%Y-%m-%d'), 'o_orderpriority': o_orderpriority}::VARCHAR AS source_span FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED') AND o_totalprice <= 300000""")
def certain_answers(spark, sf_dir):
    """Open orders of the claim plane that are certain enough, may be asked for, and where they come
    from."""
    o = table(spark, sf_dir, "orders")
    tier = F.create_map(*[F.lit(x) for kv in {"1-URGENT": "CORE_ONTOLOGY", "2-HIGH": "CLAIMED", "3-MEDIUM": "INFERRED", "4-NOT SPECIFIED": "PROVISIONAL", "5-LOW": "GHOST"}.items() for x in kv])[F.col("o_orderpriority")]
    c = o.withColumn("definition_tier", tier).withColumn("plane", F.when(F.col("o_orderstatus") == "O", "claim").otherwise("frame"))
    rules = [{"rule_id": "r1", "priority": 1, "effect": "ALLOW", "scope": F.lit(True), "predicate": F.col("o_totalprice") <= 300000}]
    v = govern.verdicts(o.select("o_orderkey"), govern.contributions(o, rules, "o_orderkey"), "o_orderkey")
    hits = patterns.permitted(patterns.certain_enough(patterns.on_plane(c)), v, "o_orderkey").select("o_orderkey", "o_custkey")
    out = patterns.with_source(hits, o.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")), "o_orderkey", ["o_orderdate", "o_orderpriority"])
    s = F.col("source_span")
    return out.select("o_orderkey", "o_custkey", F.format_string("{'o_orderdate': %s, 'o_orderpriority': %s}", s["o_orderdate"], s["o_orderpriority"]).alias("source_span"))


@query("""WITH RECURSIVE l AS (SELECT event_id AS source, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events), w(origin, claim, steps) AS (SELECT source, target, 1 FROM l WHERE source % 20 = 0 AND target IS NOT NULL UNION ALL SELECT origin, target, steps + 1 FROM w JOIN l ON source = claim WHERE steps < 3 AND target IS NOT NULL) SELECT * FROM w""")
def linked_claims(spark, sf_dir):
    """Events reached from every twentieth over three links of time."""
    e = table(spark, sf_dir, "events")
    links = claims.precedes(e, ["user_id"], ["ts", "event_id"], "event_id")
    return patterns.hops(e.where("event_id % 20 = 0").select(F.col("event_id").alias("node")), links, 3)


@query("""SELECT DISTINCT c.c_custkey, p.o_orderpriority FROM customer c, (SELECT DISTINCT o_orderpriority FROM orders) p WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = p.o_orderpriority) AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""")
def missing_branches(spark, sf_dir):
    """Priorities in which a customer has no order at all, though it has others."""
    o = table(spark, sf_dir, "orders")
    closed = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    required = o.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("o_orderpriority", F.explode(F.array(*[F.lit(x) for x in closed])))
    return patterns.missing_branches(required, o.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey", "o_orderpriority"])


_MODAL = "CASE l_linenumber % 4 WHEN 0 THEN 'may' WHEN 1 THEN 'should' WHEN 2 THEN 'will' ELSE 'SHALL' END"


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 4 AS a, l_partkey % 4 AS b, l_discount * 10 AS s, l_returnflag = 'N' AS ok, l_linestatus = 'O' AS cond FROM lineitem),
d AS (SELECT *, [1, 2, 3, 4][b + 1] >= [1, 2, 3, 4][a + 1] AS binds FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, binds, CASE WHEN ok AND cond THEN 'CONDITIONAL' WHEN ok AND s >= 0.95 THEN 'ACCEPT' WHEN NOT ok AND binds AND s >= 0.6 THEN 'ESCALATE' WHEN s >= 0.6 THEN 'CLARIFY' ELSE 'REJECT' END AS outcome FROM d""")
def decisions(spark, sf_dir):
    """What becomes of each line as an offer: does it bind as strongly, and what is decided."""
    li = table(spark, sf_dir, "lineitem")
    modal = lambda c: F.element_at(F.array(F.lit("may"), F.lit("should"), F.lit("will"), F.lit("SHALL")), (F.col(c) % 4 + 1).cast("int"))
    binds = patterns.modality_meets(modal("l_linenumber"), modal("l_partkey"))
    out = patterns.decision(F.col("l_discount") * 10, F.col("l_returnflag") == "N", F.col("l_linestatus") == "O", binds)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", binds.alias("binds"), out.alias("outcome"))


# ---------------------------------------------------------------- wisdom


@query("""WITH s AS (SELECT p_partkey, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] AS w, p_size, CASE WHEN p_brand <> 'Brand#3' THEN p_retailprice > 910 END AS c FROM part),
k AS (SELECT *, list_has_any(w, ['red', 'gear', 'rod']) AS yes, list_has_any(w, ['hot', 'cold', 'rod']) AS no FROM s)
SELECT p_partkey, CASE WHEN yes AND no THEN 'UNCERTAIN' WHEN no OR NOT yes THEN 'BLOCKED' WHEN c IS NULL THEN 'UNCERTAIN' WHEN c THEN 'APPLIES' ELSE 'BLOCKED' END AS gate FROM k""")
def applicability(spark, sf_dir):
    """Does a rule apply to each part, by words for and against and by a clause?"""
    p = table(spark, sf_dir, "part").withColumn("price", F.when(F.col("p_brand") != "Brand#3", F.col("p_retailprice")))
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    return p.select("p_partkey", patterns.applicability(F.split("p_name", " "), words("red", "gear", "rod"), words("hot", "cold", "rod"), govern.compile_predicate("price > 910")).alias("gate"))


_NODES = """n AS (SELECT p_partkey AS id, p_brand || p_type AS problem, CASE p_size % 4 WHEN 0 THEN ['a', 'b', 'c'] WHEN 1 THEN ['c', 'b', 'a'] WHEN 2 THEN ['a', split_part(p_name, ' ', 1)] ELSE ['x', 'y', split_part(p_name, ' ', 2)] END AS actions,
 split_part(p_name, ' ', 1) AS goal, [p_type] AS triggers, [split_part(p_name, ' ', 1), CASE WHEN p_size % 2 = 0 THEN 'SMALL' ELSE 'LARGE' END] AS anti FROM part)"""


@query(f"""WITH {_NODES}, x(a, b) AS (VALUES ('hot', 'cold'), ('cold', 'hot'), ('new', 'old'), ('old', 'new')),
p AS (SELECT l.id AS left_id, r.id AS right_id, l.actions AS la, r.actions AS ra, l.triggers AS lt, r.triggers AS rt, l.anti AS lx, r.anti AS rx, EXISTS (SELECT 1 FROM x WHERE x.a = l.goal AND x.b = r.goal) AS g FROM n l JOIN n r ON l.problem = r.problem AND l.id < r.id),
k AS (SELECT left_id, right_id, g, (la = list_reverse(ra) AND la <> ra) OR (la[1] = ra[1] AND (list_contains(rx, la[2]) OR list_contains(lx, ra[2]))) OR (g AND la[1:CAST(ceil(least(len(la), len(ra)) / 2.0) AS INT)] = ra[1:CAST(ceil(least(len(la), len(ra)) / 2.0) AS INT)]) AS inv, list_has_any(lt, rx) AND list_has_any(rt, lx) AS con FROM p)
SELECT left_id, right_id, 'action_inversion' AS kind FROM k WHERE inv UNION ALL SELECT left_id, right_id, 'state_exclusion' FROM k WHERE g UNION ALL SELECT left_id, right_id, 'trigger_contradiction' FROM k WHERE con""")
def wisdom_conflicts(spark, sf_dir):
    """The three kinds of conflict among rules for one problem."""
    p = table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    lit = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    actions = F.when(F.col("p_size") % 4 == 0, lit("a", "b", "c")).when(F.col("p_size") % 4 == 1, lit("c", "b", "a")).when(F.col("p_size") % 4 == 2, lit("a", w[0])).otherwise(lit("x", "y", w[1]))
    nodes = p.select(F.col("p_partkey").alias("id"), F.concat("p_brand", "p_type").alias("problem"), actions.alias("actions"), w[0].alias("desired_state"), F.array("p_type").alias("triggers"), F.array(w[0], F.when(F.col("p_size") % 2 == 0, "SMALL").otherwise("LARGE")).alias("anti_triggers"))
    return patterns.conflicts(nodes, spark.createDataFrame([("hot", "cold"), ("new", "old")], "a string, b string"))


@query("""WITH s AS (SELECT o_custkey AS situation, o_orderpriority AS class, sum(o_totalprice) AS weight FROM orders GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY situation ORDER BY weight DESC, class) AS k FROM s),
b AS (SELECT p_brand AS entry, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][p_size % 5 + 1] AS class, round(avg(p_size) / 50.0::DOUBLE, 6) AS strength FROM part GROUP BY ALL), h AS (SELECT situation, entry, round(sum(strength), 6) AS strength FROM f JOIN b USING (class) WHERE k <= 2 GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY situation ORDER BY strength DESC, entry) AS INTEGER) AS rank FROM h) SELECT * FROM r WHERE rank <= 5""")
def class_binding(spark, sf_dir):
    """The strongest entries for each customer through its two weightiest classes."""
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("situation"), F.col("o_orderpriority").alias("class")).agg(F.sum("o_totalprice").alias("weight"))
    names = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    b = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("entry"), F.element_at(names, F.col("p_size") % 5 + 1).alias("class")).agg(F.round(F.avg("p_size") / 50.0, 6).alias("strength"))
    return patterns.by_classes(s, b, 2, 5)


@query("""WITH s AS (SELECT p_partkey AS situation, p_brand, split_part(p_name, ' ', 1) AS w, p_size, CASE WHEN p_size % 3 = 0 THEN 'high' ELSE 'low' END AS ctx FROM part WHERE p_partkey % 20 = 0 AND p_size % 7 <> 0),
n AS (SELECT p_partkey AS node, p_brand, split_part(p_name, ' ', 1) AS yes, p_type AS no, p_size, CASE WHEN p_size % 2 = 0 THEN 'high' END AS ctx FROM part),
m AS (SELECT situation, node, CASE WHEN upper(s.w) = n.no THEN 'UNCERTAIN' ELSE 'APPLIES' END AS gate, round(1 - abs(s.p_size - n.p_size) / 50.0::DOUBLE, 6) AS similarity, n.ctx IS NULL OR n.ctx = s.ctx AS fits FROM s JOIN n ON s.p_brand = n.p_brand WHERE s.w = n.yes),
c AS (SELECT *, row_number() OVER (PARTITION BY situation ORDER BY similarity DESC, node) AS k FROM m), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY situation ORDER BY similarity DESC, node) AS INTEGER) AS rank FROM c WHERE k <= 10 AND fits)
SELECT situation, node, gate, similarity, rank, CASE WHEN node + 1 <= (SELECT max(p_partkey) FROM part) AND node >= 1 THEN 'COMPLEMENTS:' || least((node + 1)::VARCHAR, (node - 1)::VARCHAR) || ',COMPLEMENTS:' || greatest((node + 1)::VARCHAR, (node - 1)::VARCHAR) WHEN node >= 1 THEN 'COMPLEMENTS:' || (node - 1) ELSE 'COMPLEMENTS:' || (node + 1) END AS edges FROM r WHERE rank <= 3""")
def wisdom_cascade(spark, sf_dir):
    """Guidance for every twentieth part: routed by brand, gated by words, ranked by likeness, with
    its edges."""
    p = table(spark, sf_dir, "part")
    w = F.split("p_name", " ")[0]
    s = p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("situation"), "p_brand", F.array(w, F.upper(w)).alias("state"), F.col("p_size").alias("size"), F.when(F.col("p_size") % 3 == 0, "high").otherwise("low").alias("context"), F.when(F.col("p_size") % 7 == 0, "FAST").otherwise("STANDARD").alias("quality_tier"))
    n = p.select(F.col("p_partkey").alias("node"), "p_brand", F.array(w).alias("applies"), F.array("p_type").alias("anti"), "p_size", F.when(F.col("p_size") % 2 == 0, "high").alias("context"))
    edges = p.where("p_partkey > 0").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") - 1).alias("b"), F.lit("COMPLEMENTS").alias("kind"))
    out = patterns.cascade(s, n, ["p_brand"], 1 - F.abs(F.col("s.size") - F.col("n.p_size")) / 50.0, edges, 10, 3)
    return out.select("situation", "node", "gate", "similarity", "rank", F.array_join("edges", ",").alias("edges"))


@query("""SELECT p_brand AS hub, count(DISTINCT p_type) AS domains, count(DISTINCT p_partkey) AS nodes, count_if(l_shipdate >= TIMESTAMP '2001-06-01' - INTERVAL 90 DAY) AS recent, CASE WHEN count_if(l_shipdate >= TIMESTAMP '2001-06-01' - INTERVAL 90 DAY) < 3 THEN 'retire' WHEN count(DISTINCT p_type) >= 3 AND count(DISTINCT p_partkey) >= 10 THEN 'hub' ELSE 'candidate' END AS state FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def hub_states(spark, sf_dir):
    """Which brands are hubs by domains, nodes and uses in the last ninety days."""
    u = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("hub"), "p_type", "p_partkey", "l_shipdate")
    return patterns.hub_state(u, "hub", "p_type", "p_partkey", "l_shipdate", F.lit("2001-06-01").cast("timestamp_ntz"))


@query("""WITH t AS (SELECT user_id AS entry, count(DISTINCT event_type) AS tasks, max(value) AS c, min(ts) AS since, count_if(event_type = 'error' AND value > 100) AS open_n FROM events GROUP BY 1)
SELECT entry, tasks, entry % 2 = 0 AS approved FROM t WHERE c / 100 >= 0.8 AND since <= TIMESTAMP '2024-03-01' - INTERVAL 30 DAY AND tasks >= 5 AND open_n = 0""")
def graduates(spark, sf_dir):
    """Users ready to become rules, and which of them a person has approved."""
    e = table(spark, sf_dir, "events")
    entries = e.groupBy(F.col("user_id").alias("entry")).agg((F.max("value") / 100).alias("confidence"), F.min("ts").alias("active_since"))
    uses = e.select(F.col("user_id").alias("entry"), F.col("event_type").alias("task"))
    out = patterns.graduates(entries, uses, e.where("event_type = 'error' AND value > 100").select(F.col("user_id").alias("entry")), entries.where("entry % 2 = 0"), F.lit("2024-03-01").cast("timestamp_ntz"))
    return out.select("entry", "tasks", "approved")


@query("""SELECT 'kept' AS fate, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) UNION ALL SELECT 'archived', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)""")
def retired_entries(spark, sf_dir):
    """Parts that large lines use, and those that go to the archive."""
    log = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    kept, archived = patterns.never_used(table(spark, sf_dir, "part"), log, "p_partkey")
    return claims.row_counts({"kept": kept, "archived": archived}).withColumnRenamed("item", "fate")


@query("""WITH g AS (SELECT o_custkey AS label, count(DISTINCT o_orderpriority) AS documents, max(o_orderdate) AS last_seen FROM orders GROUP BY 1) SELECT label, documents, CASE WHEN documents >= 4 THEN 'promoted' WHEN last_seen < TIMESTAMP '2000-01-31' - INTERVAL 30 DAY THEN 'collected' ELSE 'pending' END AS fate FROM g""")
def ghost_fates(spark, sf_dir):
    """Customers as ghosts: promoted by evidence, collected when old, else pending."""
    g = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("label"), F.col("o_orderpriority").alias("doc_id"), F.col("o_orderdate").alias("seen_at"))
    return patterns.ghost_fate(g, F.lit("2000-01-31").cast("timestamp_ntz"), 4).select("label", "documents", "fate")


# ---------------------------------------------------------------- rules

SPEC = """
# orders as proposals
STATE_TRANSITION ship_open { ACTION: "O"; PRECONDITION: price > 1000; GOVERNED_BY: dear; }
STATE_TRANSITION ship_partly { ACTION: "P"; PRECONDITION: urgency != "5-LOW"; GOVERNED_BY: usual; }
GOVERNANCE_RULE dear { SCOPE: price > 200000; PREDICATE: urgency == "1-URGENT"; ENFORCEMENT_MODE: PROHIBIT; PRIORITY: 10; }
GOVERNANCE_RULE usual { SCOPE: price > 0; PREDICATE: price < 400000; ENFORCEMENT_MODE: PERMIT; PRIORITY: 5; }
SELF_REFERENCE_POINT rules { TARGET_TYPE: rule; CONTAINS: usual; }
MUTATION_RULE relax { TARGET_REFERENCE: rules; APPROVED_BY: people; }
RESOURCE_BOUND time { METRIC: seconds; THRESHOLD: 5; }
LEARNING_AXIOM learn { KNOWLEDGE_UPDATE_RULE: relax; CONSTRAINT_SET: time; }
"""


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus AS a, o_totalprice AS p, NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS u FROM orders),
t AS (SELECT *, a IN ('O', 'P') AS known, CASE a WHEN 'O' THEN p > 1000 WHEN 'P' THEN u <> '5-LOW' END AS pre FROM o),
v AS (SELECT *, CASE WHEN p > 200000 AND u IS NULL THEN 'UNKNOWN' WHEN p > 200000 AND u = '1-URGENT' THEN 'DENY' END AS dear, CASE WHEN p > 0 AND p < 400000 THEN 'ALLOW' END AS usual FROM t)
SELECT o_orderkey, CASE WHEN NOT known THEN 'DENY' WHEN pre THEN coalesce(dear, usual, 'DENY') WHEN pre IS NULL THEN 'UNKNOWN' ELSE 'DENY' END AS status, CASE WHEN known AND pre THEN CASE WHEN dear IS NOT NULL THEN 'dear' WHEN usual IS NOT NULL THEN 'usual' END END AS rule_id,
 CASE WHEN NOT known THEN 'no_matching_transition' WHEN pre IS NULL THEN NULL WHEN NOT pre THEN 'precondition_failed' WHEN coalesce(dear, usual) IS NULL THEN CASE WHEN p > 0 THEN 'no_rule_fired' ELSE 'no_matching_rule' END WHEN coalesce(dear, usual) = 'DENY' THEN 'prohibitive_rule_fired' END AS reason,
 CASE WHEN known AND ((pre AND dear = 'UNKNOWN') OR pre IS NULL) THEN 'urgency' END AS gap FROM v""")
def spec_reports(spark, sf_dir):
    """A loaded specification over all orders: verdict, rule, reason, missing observations."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("action"), F.col("o_totalprice").alias("price"), F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("urgency"))
    r = govern.evaluate(o, govern.load_spec(SPEC), "o_orderkey")
    return r.select("o_orderkey", "status", "rule_id", "reason", F.array_join("gap_report", ",").alias("gap"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice * 0.9::DOUBLE < o_totalprice AND o_orderstatus <> 'F' END AS verified FROM orders""")
def postconditions(spark, sf_dir):
    """Did a discount lower the price, and is the order not finished?"""
    rows = table(spark, sf_dir, "orders")
    state = lambda df: df.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    return govern.postconditions(state(rows), state(rows.where("o_orderpriority <> '5-LOW'")).withColumn("price", F.col("price") * 0.9), "o_orderkey", 'price < old_price AND status != "F"')


@query("""SELECT 'customers' AS validator, count_if(c_custkey IS NULL) AS failed, count(*) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'parts', count_if(p_partkey IS NULL), count(*) FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 40) ON l_partkey = p_partkey
UNION ALL SELECT 'keys', count_if(p_size >= 40), count(*) FROM part UNION ALL SELECT 'hash', 0, 1 UNION ALL SELECT 'schema', 0, 1""")
def reference_checks(spark, sf_dir):
    """References without a target, records without their keys, equal content, conforming columns."""
    p = table(spark, sf_dir, "part")
    named = lambda n, df: df.select(F.lit(n).alias("validator"), "failed", "total")
    one = govern.referential(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey")
    two = govern.referential(table(spark, sf_dir, "lineitem"), "l_partkey", p.where("p_size < 40"), "p_partkey")
    record = F.create_map(F.lit("a"), F.col("p_name"), F.lit("b"), F.when(F.col("p_size") < 40, F.col("p_brand")))
    keys = govern.validators(p, {"keys": govern.required_keys(record, ["a", "b"])})
    mixed = p.repartition(3, "p_size")
    same = p.agg(govern.content_hash(p).alias("a")).join(F.broadcast(mixed.agg(govern.content_hash(mixed).alias("b"))))
    hashes = same.select(F.lit("hash").alias("validator"), (F.col("a") != F.col("b")).cast("long").alias("failed"), F.lit(1).cast("long").alias("total"))
    fits = govern.conforms(p, p.select("p_name", "p_size").schema)
    schema = spark.createDataFrame([("schema", 0 if fits else 1, 1)], "validator string, failed long, total long")
    return named("customers", one).unionByName(named("parts", two)).unionByName(keys).unionByName(hashes).unionByName(schema)


@query("""SELECT o_orderpriority, o_orderstatus FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders) WHERE NOT (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH'))""")
def runs_to_do(spark, sf_dir):
    """Combinations that no finished run has, known by a fingerprint of canonical texts."""
    o = table(spark, sf_dir, "orders")
    mark = lambda tail: X.run_fingerprint(F.concat(F.col("o_orderpriority"), F.lit(tail)), F.col("o_orderstatus"))
    wanted = o.select("o_orderpriority", "o_orderstatus", mark("\r\nx \n").alias("fingerprint"))
    done = o.where("o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')").select(mark("\nx\n").alias("fingerprint"))
    return govern.not_run(wanted, done).select("o_orderpriority", "o_orderstatus")


# ---------------------------------------------------------------- alignment


@query("""WITH s AS (SELECT p_brand AS id, 'IS_A' AS slot, 'OR' AS op, list(DISTINCT p_type) AS f FROM part WHERE p_size > 48 GROUP BY 1 UNION ALL SELECT p_brand, 'HAS_PART', CASE WHEN p_brand < 'Brand#2' THEN 'AND' ELSE 'NOT' END, list(DISTINCT split_part(p_name, ' ', 2)) FROM part WHERE p_size > 49 GROUP BY 1 UNION ALL SELECT p_brand, 'HAS_ATTRIBUTE', 'XOR', list(DISTINCT split_part(p_name, ' ', 1)) FROM part WHERE p_size > 49 GROUP BY 1),
i AS (SELECT DISTINCT p_brand AS id FROM part), p AS (SELECT a.id AS l, b.id AS r FROM i a, i b WHERE a.id < b.id),
h AS (SELECT p.l, p.r, x.slot, CASE x.op WHEN 'OR' THEN n > 0 WHEN 'XOR' THEN n = 1 WHEN 'NOT' THEN n = 0 ELSE n = len(x.f) END AS holds FROM p JOIN s x ON x.id = p.l JOIN s y ON y.id = p.r AND y.slot = x.slot, LATERAL (SELECT len(list_intersect(x.f, y.f)) AS n)
 UNION ALL SELECT p.l, p.r, x.slot, CASE x.op WHEN 'OR' THEN n > 0 WHEN 'XOR' THEN n = 1 WHEN 'NOT' THEN n = 0 ELSE n = len(x.f) END FROM p JOIN s x ON x.id = p.r JOIN s y ON y.id = p.l AND y.slot = x.slot, LATERAL (SELECT len(list_intersect(x.f, y.f)) AS n)),
g AS (SELECT l, r, count(DISTINCT slot) AS checked, list_sort(list(DISTINCT slot) FILTER (NOT holds)) AS failed FROM h GROUP BY ALL)
SELECT p.l AS left_id, p.r AS right_id, coalesce(len(failed), 0) = 0 AND p.l <> 'Brand#1' AND p.r <> 'Brand#1' AS aligned, coalesce(checked, 0) AS checked, array_to_string(coalesce(failed, []), ',') AS failed FROM p LEFT JOIN g ON g.l = p.l AND g.r = p.r""")
def slot_alignment(spark, sf_dir):
    """Brands compared both ways over their filled slots by AND, OR, XOR and NOT; one is ungrounded."""
    p = table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    one = lambda where, slot, op, c: p.where(where).groupBy(F.col("p_brand").alias("id")).agg(F.collect_set(c).alias("fillers")).select("id", F.lit(slot).alias("slot"), op.alias("operator"), "fillers")
    slots = one("p_size > 48", "IS_A", F.lit("OR"), "p_type").unionByName(one("p_size > 49", "HAS_PART", F.when(F.col("id") >= "Brand#2", "NOT"), w[1])).unionByName(one("p_size > 49", "HAS_ATTRIBUTE", F.lit("XOR"), w[0]))
    ids = p.select(F.col("p_brand").alias("id")).distinct()
    every = ids.agg(F.collect_list("id").alias("all"))  # brands, a closed list
    pairs = ids.join(F.broadcast(every)).select(F.col("id").alias("left_id"), F.explode("all").alias("right_id")).where("left_id < right_id")
    out = align.align(slots, slots, pairs, True, ids.where("id <> 'Brand#1'"))
    return out.select("left_id", "right_id", "aligned", "checked", F.array_join("failed", ",").alias("failed"))


# ---------------------------------------------------------------- time and ranges


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_suppkey, epoch(l_shipdate) // 86400 AS s, epoch(l_shipdate) // 86400 + 1 + l_quantity::BIGINT % 5 AS e FROM lineitem)
SELECT a.l_suppkey, CASE WHEN a.s <= b.s AND b.e <= a.e THEN 'CONTAINS' ELSE 'OVERLAPS' END AS relation, count(*) AS n FROM i a JOIN i b ON a.l_suppkey = b.l_suppkey AND (a.l_orderkey, a.l_linenumber) < (b.l_orderkey, b.l_linenumber) AND a.s < b.e AND b.s < a.e GROUP BY ALL""")
def overlapping_windows(spark, sf_dir):
    """Delivery windows of one supplier that overlap, joined by buckets of time."""
    li = table(spark, sf_dir, "lineitem")
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("long")
    i = li.select("l_orderkey", "l_linenumber", "l_suppkey", day.alias("s"), (day + 1 + F.col("l_quantity").cast("long") % 5).alias("e"))
    pairs = claims.overlapping(i, i, "s", "e", 7, ["l_suppkey"]).where(F.struct("l.l_orderkey", "l.l_linenumber") < F.struct("r.l_orderkey", "r.l_linenumber"))
    relation = claims.interval_relation(F.col("l.s"), F.col("l.e"), F.col("r.s"), F.col("r.e"))
    return pairs.groupBy(F.col("l.l_suppkey").alias("l_suppkey"), relation.alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate <= TIMESTAMP '1998-06-01' AND l_shipdate > TIMESTAMP '1998-06-01' AND o_orderdate + INTERVAL 10 DAY <= TIMESTAMP '1998-05-25'""")
def bitemporal_known(spark, sf_dir):
    """Lines under way at one time, as far as they were recorded by an earlier one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("INTERVAL 10 DAYS")).alias("recorded_at"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("valid_until"))
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return claims.as_known(li.join(o, "l_orderkey"), at("1998-06-01"), at("1998-05-25")).select("l_orderkey", "l_linenumber")


@query("""WITH r AS (SELECT * FROM lineitem WHERE l_linenumber % 2 = 1 AND l_returnflag <> 'A' AND l_discount >= 0.02), k AS (SELECT l_partkey FROM r GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 1)
SELECT 'dropped' AS policy, count(*) AS claims FROM r JOIN k USING (l_partkey) UNION ALL SELECT 'settled', count(DISTINCT l_partkey) FROM r UNION ALL SELECT 'kept', count(*) FROM r""")
def trust_views(spark, sf_dir):
    """Direct claims that are no opinions, with contradictions dropped, settled or kept."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_partkey", F.col("l_linestatus").alias("value"), F.col("l_shipdate").alias("recorded_at"), F.col("l_discount").alias("confidence"), F.when(F.col("l_linenumber") % 2 == 1, "direct").otherwise("inferred").alias("derivation"), F.when(F.col("l_returnflag") == "A", "opinion").when(F.col("l_returnflag") == "R", "testimony").alias("kind"))
    seen = lambda how: claims.trust_lens(rows, min_confidence=0.02, derivations=["direct"], opinions=False, contradictions=how, key=["l_partkey"])
    return claims.row_counts({"dropped": seen("drop"), "settled": seen("latest"), "kept": seen("keep")}).select(F.col("item").alias("policy"), F.col("n").alias("claims"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN true ELSE p_size * 0.01::DOUBLE <= 0.2 END AND p_size * 0.02::DOUBLE >= 0.3 AS covers FROM part""")
def range_offers(spark, sf_dir):
    """Does the range each part offers, in centimetres, hold the one required in metres?"""
    lo = F.when(F.col("p_size") % 5 != 0, align.si_value(F.col("p_size").cast("double"), F.lit("cm")))
    hi = align.si_value(F.col("p_size") * 2.0, F.lit("cm"))
    return table(spark, sf_dir, "part").select("p_partkey", claims.range_covers(lo, hi, F.lit(0.2), F.lit(0.3)).alias("covers"))


@query("""SELECT predicate, CAST(count(DISTINCT event_id) AS INTEGER) AS size FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'u' || user_id ELSE event_type END AS predicate FROM events) GROUP BY 1 HAVING count(DISTINCT event_id) >= 2""")
def predicate_groups(spark, sf_dir):
    """Events that share a predicate: its id, else its lemma."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("u"), "user_id")).alias("cid"), F.col("event_type").alias("lemma"))
    return claims.shared_predicates(e, ["cid", "lemma"], "event_id").select("predicate", "size")


# ---------------------------------------------------------------- documents

# each part is a sentence, "<brand> 's <thing> works": a named owner, a noun, a verb
_TOKENS = """k AS (SELECT p_type || '_' || p_brand AS doc_id, CAST(p_partkey AS INT) AS sent, p_brand AS owner, split_part(p_name, ' ', 2) AS thing FROM part)"""


def _tokens(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    rows = [(F.col("p_brand"), "PROPN", "poss", 1, "ORG"), (w[1], "NOUN", "nsubj", 2, None), (F.lit("works"), "VERB", "ROOT", 2, None), (w[0], "ADJ", "acomp", 2, None)]
    one = lambda i, t, pos, dep, head, ent: F.struct(F.lit(i).alias("idx"), t.alias("text"), t.alias("lemma"), F.lit(pos).alias("pos"), F.lit(dep).alias("dep"), F.lit(head).alias("head"), F.lit(ent).cast("string").alias("ent_type"), F.lit(i * 10).alias("start"), F.lit(i * 10 + 9).alias("end"))
    return p.select(F.concat_ws("_", "p_type", "p_brand").alias("doc_id"), F.col("p_partkey").cast("int").alias("sent"), F.explode(F.array(*[one(i, *r) for i, r in enumerate(rows)])).alias("t")).select("doc_id", "sent", "t.*")


@query(f"""WITH {_TOKENS}, m AS (SELECT doc_id, lower(owner) AS norm_key, 'org' AS kind FROM k UNION ALL SELECT doc_id, thing, 'common' FROM k) SELECT doc_id, norm_key, kind, count(*) AS n_mentions FROM m GROUP BY ALL""")
def document_entities(spark, sf_dir):
    """Entities of parsed sentences with their mentions."""
    return documents.entities(documents.mentions(_tokens(spark, sf_dir))).select("doc_id", "norm_key", "kind", "n_mentions")


@query(f"WITH {_TOKENS} SELECT doc_id, sent, thing AS norm_key, lower(owner) AS possessor_key FROM k")
def possessive_chains(spark, sf_dir):
    """What belongs to a known entity."""
    t = _tokens(spark, sf_dir)
    return documents.possessive_chains(t, documents.mentions(t)).select("doc_id", "sent", "norm_key", "possessor_key")


@query(f"""WITH {_TOKENS}, f AS (SELECT doc_id, lower(owner) AS norm_key, min(sent) AS s FROM k GROUP BY ALL UNION ALL SELECT doc_id, thing, min(sent) FROM k GROUP BY ALL), x AS (SELECT doc_id, sent, 'the ' || thing AS t FROM k)
SELECT f.doc_id, norm_key, string_agg(t, ' ' ORDER BY sent) AS context FROM f JOIN x ON x.doc_id = f.doc_id AND abs(sent - s) <= 40 GROUP BY ALL""")
def mention_contexts(spark, sf_dir):
    """The sentences around each entity's longest mention."""
    t = _tokens(spark, sf_dir)
    sentences = t.where("idx = 1").select("doc_id", "sent", F.concat(F.lit(" the  "), "text").alias("text"))
    return documents.mention_context(documents.mentions(t), sentences, 40)


@query(f"""WITH {_TOKENS}, n AS (SELECT DISTINCT doc_id, thing AS norm_key FROM k), e(lemma, cid) AS (VALUES ('ring', 'en.ring'), ('bolt', 'en.bolt.1'), ('bolt', 'en.bolt.2'), ('cog', 'en.cog'), ('pole', 'en.pole')), a(norm_key, alias) AS (VALUES ('gear', 'cog'), ('bolt', 'pole'), ('rod', 'stick')),
o AS (SELECT lemma, min(cid) AS cid FROM e GROUP BY 1 HAVING count(*) = 1), b AS (SELECT n.*, x.cid AS c1, y.cid AS c2 FROM n LEFT JOIN o x ON x.lemma = norm_key LEFT JOIN a USING (norm_key) LEFT JOIN o y ON y.lemma = alias),
r AS (SELECT doc_id, norm_key, coalesce(c1, c2, 'doc.' || norm_key || '.unmapped.noun.docloc') AS canonical_id, CASE WHEN c1 IS NOT NULL THEN 1 WHEN c2 IS NOT NULL THEN 2 ELSE 4 END AS level, coalesce(c1, c2) IS NULL AS minted FROM b)
SELECT doc_id, norm_key, canonical_id, level, minted, CASE WHEN minted THEN 'custom' ELSE 'synapedia' END AS namespace, CASE WHEN minted THEN 'a kind of ' || norm_key END AS gloss FROM r""")
def entity_lookup(spark, sf_dir):
    """The sense of each noun of a document: by name, by alias, else minted and enriched."""
    found = documents.entities(documents.mentions(_tokens(spark, sf_dir))).where("kind = 'common'")
    entries = spark.createDataFrame([("ring", "en.ring"), ("bolt", "en.bolt.1"), ("bolt", "en.bolt.2"), ("cog", "en.cog"), ("pole", "en.pole")], "lemma string, canonical_id string")
    more = spark.createDataFrame([("gear", "cog"), ("bolt", "pole"), ("rod", "stick")], "norm_key string, alias string")
    names = found.select("doc_id", "ent_id", "norm_key", F.lit("NOUN").alias("pos"))
    out = documents.looked_up(names, entries, found.join(more, "norm_key").select("ent_id", "alias")).join(names.select("ent_id", "norm_key"), "ent_id")
    fresh = out.where("minted").select(F.col("norm_key").alias("lemma"), F.lit("NOUN").alias("pos"), "doc_id")
    told = documents.enriched(fresh, lambda asked: asked.select("lemma", "pos", F.concat(F.lit("a kind of "), "lemma").alias("gloss"), F.lit("entity").alias("parent")))
    space = documents.namespace(F.col("canonical_id"), F.lit(False), F.col("minted"))
    return out.join(told.select("doc_id", F.col("lemma").alias("norm_key"), "gloss"), ["doc_id", "norm_key"], "left").select("doc_id", "norm_key", "canonical_id", "level", "minted", space.alias("namespace"), "gloss")


@query(f"""WITH {_TOKENS} SELECT 'doc.' || thing || '.unmapped.noun.docloc' AS canonical_id, thing AS lemma, split_part(doc_id, '_', 1) AS corpus, count(DISTINCT doc_id) AS ref_count FROM k GROUP BY ALL""")
def custom_lexicon(spark, sf_dir):
    """Minted senses of documents as a project's own lexicon."""
    found = documents.entities(documents.mentions(_tokens(spark, sf_dir))).where("kind = 'common'").select("doc_id", "ent_id", "norm_key", F.lit("noun").alias("pos"))
    none = spark.createDataFrame([], "lemma string, canonical_id string")
    out = documents.looked_up(found, none, spark.createDataFrame([], "ent_id string, alias string"))
    return documents.custom_lexicon(out.join(found.select("ent_id", F.col("norm_key").alias("lemma")), "ent_id"))


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey % 50 AS a, l_partkey % 50 + 5 AS b, 'p' || (l_suppkey % 20) AS t FROM lineitem), u AS (SELECT doc_id, l_linenumber * 100 + row_number() OVER (PARTITION BY doc_id, l_linenumber ORDER BY a, t) AS span_id, a, b, t FROM s),
f(place, a, b, t, c, al) AS (VALUES (0, 3, 8, 'p1', 'P2', ['p3', 'P4']), (1, 10, 15, 'P5', 'p1', ['p6']), (2, 20, 25, 'p7', 'p3', ['p7']))
SELECT doc_id, span_id, arg_min('e' || place, place) AS ent_id FROM u JOIN f ON (u.a = f.a AND u.b = f.b) OR u.t = lower(f.t) OR u.t = lower(f.c) OR list_contains(list_transform(f.al, lambda x: lower(x)), u.t) GROUP BY ALL""")
def span_entities(spark, sf_dir):
    """The entity of each span: by place, by text, by name, by alias."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", (F.col("l_partkey") % 50).alias("start"), (F.col("l_partkey") % 50 + 5).alias("end"), F.concat(F.lit("p"), F.col("l_suppkey") % 20).alias("surface"))
    n = F.row_number().over(Window.partitionBy("doc_id", "l_linenumber").orderBy("start", "surface"))
    spans = li.withColumn("span_id", (F.col("l_linenumber") * 100 + n).cast("long")).drop("l_linenumber")
    known = spark.createDataFrame([("e0", 0, 0, 3, 8, "p1", "P2", ["p3", "P4"]), ("e1", 1, 0, 10, 15, "P5", "p1", ["p6"]), ("e2", 2, 0, 20, 25, "p7", "p3", ["p7"])], "ent_id string, ent_place int, mention_place int, start long, end long, surface string, canonical string, aliases array<string>")
    each = spans.select("doc_id").distinct().withColumn("_e", F.explode(F.array(*[F.lit(f"e{i}") for i in range(3)]))).join(F.broadcast(known), F.col("_e") == F.col("ent_id")).drop("_e")
    return documents.span_entities(spans, each)


@query(f"WITH {_TOKENS} SELECT doc_id, sent, i AS root, CASE i WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE i * 10 END AS start, CASE i WHEN 2 THEN 39 ELSE i * 10 + 9 END AS \"end\" FROM k, (SELECT unnest([0, 1, 2, 3])::INT AS i)")
def subtree_spans(spark, sf_dir):
    """What the subtree of each token covers."""
    return documents.subtree_spans(_tokens(spark, sf_dir))


@query("""SELECT o_orderkey AS synapse_id, 'order' AS verb, 'HAS_AGENT=c' || o_custkey || ',HAS_TIME=' || o_orderpriority || CASE WHEN o_orderstatus <> 'F' THEN ',HAS_ATTRIBUTE=' || o_orderstatus ELSE '' END AS spokes FROM orders""")
def shown_claims(spark, sf_dir):
    """Orders as claims with their spokes in order."""
    o = table(spark, sf_dir, "orders")
    s = o.select(F.col("o_orderkey").alias("synapse_id"), F.posexplode(F.array(*[F.struct(F.lit(r).alias("role"), v.alias("surface")) for r, v in (("HAS_AGENT", F.concat(F.lit("c"), "o_custkey")), ("HAS_TIME", F.col("o_orderpriority")), ("HAS_ATTRIBUTE", F.nullif(F.col("o_orderstatus"), F.lit("F"))))])).alias("place", "s")).select("synapse_id", "place", "s.*").where("surface IS NOT NULL")
    out = documents.show_claims(o.select(F.col("o_orderkey").alias("synapse_id"), F.lit("order").alias("verb")), s)
    return out.withColumn("spokes", F.array_join("spokes", ","))


@query("""SELECT o_orderpriority AS label, count(*) AS frequency, max(o_orderdate) AS last_seen, CASE WHEN o_orderpriority LIKE '%H%' THEN 'RESOLVED' ELSE 'PENDING' END AS state FROM orders GROUP BY 1""")
def ghost_list(spark, sf_dir):
    """Unresolved references by how often they were met."""
    g = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_orderdate").alias("seen_at"))
    return documents.ghost_list(g, g.where("label LIKE '%H%'"))


@query("""SELECT p_brand, CAST(sum(CASE WHEN p_size > 20 THEN 1 ELSE 0 END) AS BIGINT) AS spokes, count(*) AS claims, 'Red Ring' AS label FROM part GROUP BY 1""")
def rows_as_claims(spark, sf_dir):
    """Rows of a table as claims by a map of roles; empty cells make no spoke."""
    p = table(spark, sf_dir, "part").withColumn("t", F.when(F.col("p_size") > 20, F.col("p_type")).otherwise(" "))
    c = lexical.rows_as_claims(p, "sell", {"HAS_AGENT": "p_brand", "HAS_THEME": "t"}, ["p_partkey"])
    of = F.get("spokes", F.lit(0))["surface"]
    return c.groupBy(of.alias("p_brand")).agg(F.sum(F.size("spokes") - 1).alias("spokes"), F.count_distinct("synapse_id").alias("claims"), F.min(documents.group_label(F.lit("en.red_ring.x.noun"))).alias("label"))


# ---------------------------------------------------------------- answers and formats


@query("""SELECT p_partkey, 'RELATION_1' AS marker, p_name AS lemma, p_type || ' more text' AS gloss, CAST(p_size AS DOUBLE) AS size, CAST(floor(p_retailprice) AS BIGINT) AS price, p_size % 2 = 0 AS even, CAST(2 AS INTEGER) AS blocks, list_sort([p_brand, p_type]) AS tags FROM part""")
def kv_answers(spark, sf_dir):
    """Key-value blocks in an answer's envelope, with prose around them, read back with their types."""
    p = table(spark, sf_dir, "part")
    lines = [F.lit("Sure! <answer>here: prose\n\nRELATION_1\nLemma: "), "p_name", F.lit("\nGLOSS: "), "p_type", F.lit("\n more text\nsize: "), "p_size", F.lit("\nprice: "), "p_retailprice", F.lit("\neven: "), F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("off"), F.lit("\ntags: "), "p_type", F.lit(" ; "), "p_brand", F.lit(",\n\nnot in a block: x\nENTRY-2\na: b\n</answer> bye")]
    b = p.select("p_partkey", answers.kv_blocks(answers.envelope(F.concat(*lines))).alias("b"))
    one = F.get("b", F.lit(0))
    return b.select("p_partkey", one["_marker"].alias("marker"), one["lemma"].alias("lemma"), one["gloss"].alias("gloss"), X.as_float(one["size"]).alias("size"), X.as_int(one["price"]).alias("price"), X.as_bool(one["even"]).alias("even"), F.size("b").alias("blocks"), F.sort_array(X.as_list(one["tags"])).alias("tags"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_name || ',' || p_brand ELSE '' END AS lemmas FROM part""")
def compound_answers(spark, sf_dir):
    """Compounds of answers whose decision is yes."""
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("DECISION: "), F.when(F.col("p_size") % 3 != 0, "yes").otherwise("NO"), F.lit("\nCompound 1:\nnew_lemma: "), "p_name", F.lit("\nnoise: x\nCompound 2:\nNEW_LEMMA:"), "p_brand", F.lit("\nbow: a, b"))
    return p.select("p_partkey", F.array_join(F.transform(answers.compounds(text), lambda c: c["new_lemma"]), ",").alias("lemmas"))


@query("""SELECT p_partkey, split_part(p_name, ' ', 2) AS head, [split_part(p_name, ' ', 1)] AS modifier, [p_type, p_brand, 'thing'] AS is_a, 'to be sold' AS has_purpose FROM part""")
def slot_answers(spark, sf_dir):
    """The slots of ontology answers, with list marks and continued lines."""
    p = table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    text = F.concat(F.lit("Head:\n"), w[1], F.lit("\n - modifier: "), w[0], F.lit("\nIS_A: "), "p_type", F.lit(" | "), "p_brand", F.lit("\n thing;\nHAS_PURPOSE: to be\nsold"))
    return p.select("p_partkey", answers.ontology_slots(text).alias("s")).select("p_partkey", "s.head", "s.modifier", "s.is_a", "s.has_purpose")


@query("""SELECT p_partkey, p_partkey AS entry_id, p_name AS gloss, p_type || ':' || p_brand AS parents, 'sell/ALLEGED/HAS_AGENT=' || p_brand || ', ' || p_name AS event, 'event_1>PRECEDES>event_2' AS link FROM part""")
def entry_answers(spark, sf_dir):
    """Entries of tagged answers: glosses, parents, events with roles, links."""
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit('<answer entry_id="x">new_gloss: no</answer> <answer entry_id="'), "p_partkey", F.lit('">new_gloss: '), "p_name", F.lit("\nis_a_parents: "), "p_type", F.lit(': "'), "p_brand", F.lit('"\nevent_1:\nverb: sell\nepistemic_status: alleged\nHAS_AGENT: '), "p_brand", F.lit("\nhas_agent: "), "p_name", F.lit("\nlink_1:\nsource: event_1\nlink_type: PRECEDES\ntarget: event_2\nlink_2:\nsource: a\n</answer>"))
    e = p.select("p_partkey", F.explode(answers.entry_answers(text)).alias("e")).select("p_partkey", "e.*")
    parent, event, link = F.get("parents", F.lit(0)), F.get("events", F.lit(0)), F.get("links", F.lit(0))
    return e.where(F.size("links") == 1).select("p_partkey", "entry_id", F.col("fields")["new_gloss"].alias("gloss"), F.concat_ws(":", parent["lemma"], parent["gloss"]).alias("parents"), F.concat(event["verb"], F.lit("/"), event["epistemic_status"], F.lit("/HAS_AGENT="), event["roles"]["HAS_AGENT"]).alias("event"), F.concat_ws(">", link["source"], link["link_type"], link["target"]).alias("link"))


@query("""SELECT p_partkey, p_name || chr(10) || p_type AS name, p_size % 2 = 0 AS even, p_brand AS brand FROM part""")
def fenced_blocks(spark, sf_dir):
    """Fenced blocks written and read back: nulls left out, booleans, continued lines."""
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("noise\n"), blocks.block_text("part", {"name": F.concat("p_name", F.lit("\n"), "p_type"), "even": F.col("p_size") % 2 == 0, "none": F.lit(None).cast("string"), "brand": F.col("p_brand")}), F.lit("after"))
    b = p.select("p_partkey", F.get(blocks.blocks(text), F.lit(0)).alias("b"))
    return b.where("b['_kind'] = 'part' AND NOT map_contains_key(b, 'none')").select("p_partkey", F.col("b")["name"].alias("name"), X.as_bool(F.col("b")["even"]).alias("even"), F.col("b")["brand"].alias("brand"))


@query("""SELECT p_partkey AS k, p_name || chr(10) || '#' || p_brand AS name, CASE WHEN p_size % 2 = 0 THEN '' END AS gap, CAST(p_size AS BIGINT) AS size, p_size % 3 = 0 AS has_extra, 'base64' AS packed FROM part""")
def record_texts(spark, sf_dir):
    """Records written as text and read back: null, empty and missing apart, escapes, types, packed
    values, directives."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit("\n#"), "p_brand").alias("name"), F.when(F.col("p_size") % 2 == 0, "").alias("gap"), F.col("p_size").alias("size"), F.base64(F.lit("base64").cast("binary")).alias("packed"))
    body = rskv.lines(p).select(F.concat(F.lit("﻿#SET: part\n#SCHEMA: k:int, name:str, gap:str, size:int\n#ENCODE: packed:base64\n#INDEX: k\n"), "value", F.when(F.regexp_extract("value", r"(?m)^size: (\d+)$", 1).cast("int") % 3 == 0, F.lit("\nextra: 1\n#ENDSET")).otherwise(F.lit("\n#ENDSET"))).alias("t"))
    r = body.select(F.explode(rskv.parse_column(F.col("t"))).alias("r")).select("r.*").where("meta['index'] = 'k'")
    t = rskv.typed(r, {"k": "int", "name": "str", "gap": "str", "size": "int", "packed": "str"})
    return t.select("k", "name", "gap", "size", F.map_contains_key("record", F.lit("extra")).alias("has_extra"), "packed")


@query("""SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, strftime(o_orderdate, '%Y-%m-%d') AS day, list_distinct([lower(o_orderstatus), lower(o_orderpriority)]) IS NOT NULL AS ok, lower(o_orderstatus) || ',' || lower(o_orderpriority) || ',x' AS synonyms FROM orders""")
def scalar_coercions(spark, sf_dir):
    """Seconds, days and synonym lists from JSON; malformed JSON gives none."""
    o = table(spark, sf_dir, "orders")
    js = F.to_json(F.array(F.col("o_orderstatus"), F.lower("o_orderstatus"), F.to_json(F.struct(F.concat(F.lit(" "), "o_orderpriority").alias("synonym"))), F.lit("X "), F.lit("")))
    bad = (F.size(X.synonym_list(F.lit("[oops"))) == 0) & X.json_list(F.lit("{")).isNull()
    return o.select("o_orderkey", X.epoch_seconds(F.col("o_orderdate")).alias("seconds"), X.iso_day(F.col("o_orderdate")).alias("day"), bad.alias("ok"), F.array_join(X.synonym_list(js), ",").alias("synonyms"))


# ---------------------------------------------------------------- exports


@query("""WITH n AS (SELECT 'r' || r_regionkey AS id, 'Region' AS label, r_name AS name, 0 AS priority FROM region UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name, 1 FROM nation UNION ALL SELECT 'lit.' || v, 'Literal', v, 3 FROM (SELECT DISTINCT 'y' || (s_suppkey % 7) AS v FROM supplier) UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name, 2 FROM supplier) SELECT * FROM n""")
def graph_nodes(spark, sf_dir):
    """Nodes of a graph from several tables; the first table's definition of an id wins."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    node = lambda df, p, k, label, name: df.select(F.concat(F.lit(p), k).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"))
    lits = s.select(F.concat(F.lit("y"), F.col("s_suppkey") % 7).alias("name")).select(F.concat(F.lit("lit."), "name").alias("id"), F.lit("Literal").alias("label"), "name")
    again = node(r, "r", "r_regionkey", "Other", "r_name")
    return lexical.node_union({"regions": node(r, "r", "r_regionkey", "Region", "r_name"), "nations": node(n, "n", "n_nationkey", "Nation", "n_name"), "suppliers": node(s, "s", "s_suppkey", "Supplier", "s_name"), "literals": lits.unionByName(again)})


@query("""SELECT 'n' || n_nationkey AS src, 'IS_A' AS type, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'HAS_LOCATION', 'n' || s_nationkey FROM supplier UNION ALL SELECT 's' || s_suppkey, 'HAS_ATTRIBUTE', 'lit.y' || (s_suppkey % 7) FROM supplier WHERE s_suppkey % 7 < 5""")
def graph_edges(spark, sf_dir):
    """Edges of a graph from several tables; those without a known end are dropped."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    y = F.concat(F.lit("y"), F.col("s_suppkey") % 7)
    target = lambda kind, lit, cid: lexical.edge_target(F.lit(kind), F.lit(None).cast("string"), lit, cid, F.lit(None).cast("string"))
    spokes = s.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.lit("HAS_LOCATION").alias("type"), target("LEXICON_ENTRY", y, F.concat(F.lit("n"), "s_nationkey")).alias("dst"))
    more = s.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.lit("HAS_ATTRIBUTE").alias("type"), target("TYPED_LITERAL", y, F.lit("x")).alias("dst"))
    lost = s.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.lit("HAS_THEME").alias("type"), target("GHOST", y, F.lit(None).cast("string")).alias("dst"))
    up = n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    nodes = graph_nodes(spark, sf_dir).where("NOT (label = 'Literal' AND name >= 'y5')")
    return lexical.edge_union({"IS_A": up, "spokes": spokes.unionByName(more).unionByName(lost)}, nodes)


@query("""SELECT 'syn:en_' || n_nationkey || ' sgf:in syn:r_' || n_regionkey || ' .' AS value FROM nation UNION ALL SELECT 'syn:en_' || n_nationkey || ' rdfs:label "' || n_name || '" .' FROM nation UNION ALL SELECT 'syn:en_' || n_nationkey || ' a syn:BFO_0000029 .' FROM nation""")
def turtle_lines(spark, sf_dir):
    """Nations as triples: relations, labels, classes of an upper ontology; read back from the INSERT
    statements that carry them."""
    n = table(spark, sf_dir, "nation").withColumn("src", F.concat(F.lit("en."), "n_nationkey"))
    none = F.lit(None).cast("string")
    edges = n.select("src", F.lit("sgf:in").alias("predicate"), F.concat(F.lit("r."), "n_regionkey").alias("dst"), none.alias("literal"))
    edges = edges.unionByName(n.select("src", F.lit("rdfs:label").alias("predicate"), none.alias("dst"), F.col("n_name").alias("literal")))
    edges = edges.unionByName(n.select("src", F.lit("a").alias("predicate"), lexical.upper_class(F.lit("GPE")).alias("dst"), none.alias("literal")))
    statements = lexical.sparql_insert(lexical.triples(edges), 20)
    return statements.select(F.explode(F.split(F.regexp_replace("value", r"^INSERT DATA \{\n|\n\}$", ""), "\n")).alias("value"))
