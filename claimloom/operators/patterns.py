"""Pattern queries over claims and the wisdom store: matching with kinds of fillers, thresholds,
provenance, hops, conflicts, applicability, retrieval by classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.model import tier_rank
from claimloom.operators import classes, graph, retrieval

# Strength of modal verbs, and what a frame demands of its answer.
MODALITY = {"may": 1, "can": 1, "should": 2, "will": 3, "shall": 4, "must": 4}
PLANES = ["claim", "frame", "governance", "wisdom"]


def _listed(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(default))


# ---------------------------------------------------------------- patterns


def kinds_of(fillers: DataFrame, is_a: DataFrame, depth: int = 3) -> DataFrame:
    """(asked, target): each asked filler and all its kinds, down to ``depth`` steps.  ``fillers``: asked.
    ``is_a``: src (kind), dst (more general)."""
    down = graph.ancestors(is_a.select(F.col("dst").alias("src"), F.col("src").alias("dst")), fillers.select(F.col("asked").alias("node")), depth)
    return down.select(F.col("origin").alias("asked"), F.col("node").alias("target"))


def match(spokes: DataFrame, filled: dict[str, DataFrame], open_roles: list[str], claim: str = "synapse_id") -> DataFrame:
    """Claims that hold, for each filled role, one of the given targets (a table with a column target),
    with all targets of the open roles (sorted arrays).  One semi join for each filled role."""
    hits = spokes.select(claim).distinct()
    for role, targets in filled.items():
        held = spokes.where(F.col("role") == role).join(targets.select(F.col("target").alias("target_id")).distinct(), "target_id", "left_semi").select(claim).distinct()
        hits = hits.join(held, claim, "left_semi")
    rest = spokes.where(F.col("role").isin(open_roles)).join(hits, claim, "left_semi")
    return rest.groupBy(claim).agg(*[F.sort_array(F.collect_set(F.when(F.col("role") == r, F.col("target_id")))).alias(r) for r in open_roles])


def wildcard(pattern: str) -> str:
    """A pattern of dotted parts in which "any" stands for any part, as a regular expression."""
    return "^" + r"\.".join("[^.]+" if p == "any" else _plain(p) for p in pattern.split(".")) + "$"


def _plain(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)


def certain_enough(claims: DataFrame, tier: str = "definition_tier", least: str = "INFERRED") -> DataFrame:
    """Claims at or above a tier; ghosts never take part in reasoning."""
    return claims.where((tier_rank(F.col(tier)) <= tier_rank(F.lit(least))) & (F.col(tier) != "GHOST"))


def on_plane(rows: DataFrame, plane: str = "claim") -> DataFrame:
    """Rows of one plane; questions of fact read claims only."""
    if plane not in PLANES:
        raise ValueError(f"no plane {plane}")
    return rows.where(F.col("plane") == plane)


def permitted(questions: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Questions that the rules allow."""
    return questions.join(verdicts.where("verdict = 'ALLOW'").select(key).distinct(), key, "left_semi")


def with_source(hits: DataFrame, claims: DataFrame, claim: str, fields: list[str]) -> DataFrame:
    """Each hit with the place it comes from: a struct of document, section, sentence and so on."""
    return hits.join(claims.select(claim, F.struct(*fields).alias("source_span")), claim, "left")


def hops(starts: DataFrame, links: DataFrame, steps: int) -> DataFrame:
    """(origin, claim, steps): claims reached over links (source, target) in at most ``steps``."""
    found = graph.ancestors(links.select(F.col("source").alias("src"), F.col("target").alias("dst")), starts, steps)
    return found.select("origin", F.col("node").alias("claim"), F.col("depth").alias("steps")).where("steps > 0")


def missing_branches(required: DataFrame, offered: DataFrame, by: list[str]) -> DataFrame:
    """Required sections that the offer lacks altogether."""
    return required.join(offered.select(*by).distinct(), by, "left_anti")


def modality_meets(required: Column, offered: Column) -> Column:
    """Does an offer bind at least as strongly as the requirement?"""
    return _listed(MODALITY, F.lower(offered), 0) >= _listed(MODALITY, F.lower(required), 0)


def decision(score: Column, complies: Column, conditional: Column, binding: Column, high: float = 0.95, low: float = 0.6) -> Column:
    """ACCEPT, CONDITIONAL, CLARIFY, ESCALATE or REJECT: a binding requirement that is not met goes to a
    person, what is moderately sure asks back."""
    return (
        F.when(complies & conditional, "CONDITIONAL").when(complies & (score >= high), "ACCEPT").when(~complies & binding & (score >= low), "ESCALATE").when(score >= low, "CLARIFY").otherwise("REJECT")
    )


# ---------------------------------------------------------------- wisdom


def applicability(state: Column, applies: Column, anti: Column, clauses: Column | None = None) -> Column:
    """APPLIES, BLOCKED or UNCERTAIN.  Keywords first: those for and those against; both at once is
    uncertain, and so is a compiled clause that lacks an observation."""
    yes, no = F.arrays_overlap(state, applies), F.arrays_overlap(state, anti)
    yes, no = F.coalesce(yes, F.lit(False)) | (F.size(applies) == 0), F.coalesce(no, F.lit(False))
    words = F.when(yes & no, "UNCERTAIN").when(no | ~yes, "BLOCKED").otherwise("APPLIES")
    if clauses is None:
        return words
    return F.when(words != "APPLIES", words).when(clauses.isNull(), "UNCERTAIN").when(clauses, "APPLIES").otherwise("BLOCKED")


def conflicts(nodes: DataFrame, exclusive: DataFrame) -> DataFrame:
    """(left_id, right_id, kind) among nodes of one problem: id, problem, actions, desired_state,
    triggers, anti_triggers (arrays), cognitive_order.  ``exclusive``: a, b (states that exclude each
    other).

    action_inversion: reversed actions, or the same first action and a second one that the other
    forbids, or an equal first half with excluding goals.  state_exclusion: excluding goals.
    trigger_contradiction: each one's triggers meet the other's anti-triggers."""
    both = exclusive.unionByName(exclusive.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().groupBy("a").agg(F.collect_set("b").alias("excludes"))
    n = nodes.join(both.withColumnRenamed("a", "desired_state"), "desired_state", "left")
    # nodes alike in all but their id meet others once; every kind is the same from both sides
    held = classes.classes(n, "id", "ids").withColumn("_order", F.struct(F.array_min("ids").alias("least"), F.xxhash64(*[c for c in n.columns if c != "id"]).alias("h")))
    l, r = classes.dealt(held, held, ["problem"])
    l, r = l.alias("l"), r.alias("r")
    pairs = l.join(r, (F.col("l.problem") == F.col("r.problem")) & (F.col("l._salt") == F.col("r._salt")) & (F.col("l._order") <= F.col("r._order")))
    c = lambda x: (F.col(f"l.{x}"), F.col(f"r.{x}"))
    (la, ra), (lt, rt), (lx, rx) = c("actions"), c("triggers"), c("anti_triggers")
    goals = F.coalesce(F.array_contains(F.col("l.excludes"), F.col("r.desired_state")), F.lit(False))
    half = F.ceil(F.least(F.size(la), F.size(ra)) / 2).cast("int")
    inverted = (F.size(la) > 1) & (la == F.reverse(ra)) & (la != ra)
    leading = (F.get(la, F.lit(0)) == F.get(ra, F.lit(0))) & (F.array_contains(rx, F.get(la, F.lit(1))) | F.array_contains(lx, F.get(ra, F.lit(1))))
    tail = (half > 0) & (F.slice(la, F.lit(1), half) == F.slice(ra, F.lit(1), half)) & goals
    crossed = F.arrays_overlap(lt, rx) & F.arrays_overlap(rt, lx)
    kinds = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in (("action_inversion", inverted | leading | tail), ("state_exclusion", goals), ("trigger_contradiction", crossed))]))
    found = pairs.select(F.col("l.ids").alias("_l"), F.col("r.ids").alias("_r"), (F.col("l._order") == F.col("r._order")).alias("_own"), kinds.alias("_kinds")).where(F.size("_kinds") > 0)
    each = found.select(F.explode("_l").alias("_a"), "_r", "_own", "_kinds").select("_a", F.explode("_r").alias("_b"), "_own", "_kinds")
    each = each.where(F.when(F.col("_own"), F.col("_a") < F.col("_b")).otherwise(F.col("_a") != F.col("_b")))
    return each.select(F.least("_a", "_b").alias("left_id"), F.greatest("_a", "_b").alias("right_id"), F.explode("_kinds").alias("kind"))


def by_classes(situations: DataFrame, bindings: DataFrame, most_classes: int = 5, k: int = 30) -> DataFrame:
    """Entries for each situation through the classes it is recognised as: situation, entry, strength,
    rank.  ``situations``: situation, class, weight.  ``bindings``: entry, class, strength.  At most
    ``most_classes`` classes of a situation count and ``k`` entries come back."""
    few = retrieval.top_k(situations, ["situation"], "weight", "class", most_classes).select("situation", "class")
    hits = few.join(bindings, "class").groupBy("situation", "entry").agg(F.round(F.sum("strength"), 6).alias("strength"))
    return retrieval.top_k(hits, ["situation"], "strength", "entry", k)


def cascade(situations: DataFrame, nodes: DataFrame, route: list[str], similarity: Column, edges: DataFrame, near: int = 50, k: int = 20) -> DataFrame:
    """Guidance for each situation: situation, node, similarity, rank, edges (sorted kind:other).

    Fast situations skip the store.  The others are routed by equal ``route`` fields, pass the gate of
    applicability (uncertain ones stay, marked), keep the ``near`` most similar, lose those of another
    context, and the best ``k`` come with their edges.  ``similarity`` compares fields of ``s`` and ``n``
    other than their ids: situations and nodes that are alike meet once."""
    alike = [c for c in situations.columns if c != "situation"]
    asked = classes.classes(situations.where("quality_tier <> 'FAST'"), "situation", "_asked")
    asked = asked.withColumn("_least", F.array_min("_asked")).withColumn("_h", F.xxhash64(*alike))
    # of nodes alike in all but the id, which are equally similar, only the first can be among the near
    same = [c for c in nodes.columns if c != "node"]
    first = nodes.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy(F.asc("node")))).where(F.col("_n") <= near)
    first = first.groupBy(*same).agg(F.collect_list(F.struct("node")).alias("_nodes"))
    s, n = classes.dealt(asked.drop("_asked"), first, route)
    s, n = s.alias("s"), n.alias("n")
    on = F.col("s._salt") == F.col("n._salt")
    for f in route:
        on = on & (F.col(f"s.{f}") == F.col(f"n.{f}"))
    met = s.join(n, on).withColumn("gate", applicability(F.col("s.state"), F.col("n.applies"), F.col("n.anti"))).where("gate <> 'BLOCKED'")
    scored = met.select("s._least", "s._h", F.inline("n._nodes").alias("node"), "gate", F.round(similarity, 6).alias("similarity"), (F.col("n.context").isNull() | (F.col("n.context") == F.col("s.context"))).alias("fits"))
    most = retrieval.top_k(scored, ["_least", "_h"], "similarity", "node", near).drop("rank")
    keys = asked.select(F.col("_least").alias("_l"), F.col("_h").alias("_g"), "_asked")
    each = most.join(keys, (F.col("_h") == F.col("_g")) & F.col("_least").eqNullSafe(F.col("_l"))).select(F.explode("_asked").alias("situation"), "node", "gate", "similarity", "fits")
    # once more by situation, whose id may stand on rows of several classes
    close = retrieval.top_k(each, ["situation"], "similarity", "node", near).where("fits").drop("rank", "fits")
    best = retrieval.top_k(close, ["situation"], "similarity", "node", k)
    tied = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind")).groupBy(F.col("a").alias("node")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "b"))).alias("edges"))
    return best.join(tied, "node", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<string>")))


def hub_state(uses: DataFrame, hub: str, domain: str, node: str, used: str, now: Column, days: int = 90) -> DataFrame:
    """Lifecycle of hubs: hub with three domains and ten nodes, retire with fewer than three uses in the
    last ``days``, else candidate."""
    recent = F.count_if(F.col(used) >= now - F.expr(f"INTERVAL {days} DAYS"))
    g = uses.groupBy(hub).agg(F.count_distinct(domain).alias("domains"), F.count_distinct(node).alias("nodes"), recent.alias("recent"))
    return g.withColumn("state", F.when(F.col("recent") < 3, "retire").when((F.col("domains") >= 3) & (F.col("nodes") >= 10), "hub").otherwise("candidate"))


def graduates(entries: DataFrame, uses: DataFrame, open_conflicts: DataFrame, approved: DataFrame, now: Column) -> DataFrame:
    """Entries ready to become rules: 30 days active, five distinct tasks, confidence .8, no open
    conflict; ``approved`` tells those that a person has let through.  ``entries``: entry, confidence,
    active_since.  ``uses``: entry, task."""
    tasks = uses.groupBy("entry").agg(F.count_distinct("task").alias("tasks"))
    ready = entries.where((F.col("confidence") >= 0.8) & (F.col("active_since") <= now - F.expr("INTERVAL 30 DAYS"))).join(tasks.where("tasks >= 5"), "entry").join(open_conflicts.select("entry").distinct(), "entry", "left_anti")
    return ready.join(approved.select("entry", F.lit(True).alias("approved")).distinct(), "entry", "left").withColumn("approved", F.coalesce("approved", F.lit(False)))


def never_used(entries: DataFrame, log: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): entries that were retrieved, and those that never were."""
    used = log.select(key).distinct()
    return entries.join(used, key, "left_semi"), entries.join(used, key, "left_anti")


def ghost_fate(ghosts: DataFrame, now: Column, documents: int = 2, days: int = 30) -> DataFrame:
    """Ghosts (label, doc_id, seen_at): promoted with evidence in enough documents, collected after
    ``days`` without it, else pending."""
    g = ghosts.groupBy("label").agg(F.count_distinct("doc_id").alias("documents"), F.max("seen_at").alias("last_seen"))
    return g.withColumn("fate", F.when(F.col("documents") >= documents, "promoted").when(F.col("last_seen") < now - F.expr(f"INTERVAL {days} DAYS"), "collected").otherwise("pending"))
