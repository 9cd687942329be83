"""Relation graphs: bounded walks, reach, cycles.  Loops join one hop at a time; each hop is
checkpointed, so lineage stays short."""

from __future__ import annotations

import graphlib
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


_OWN: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Ends lineage in the folder that the cluster names for checkpoints; a folder of its own only on
    a local master, where driver and executors share their disk."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _OWN.append(tempfile.mkdtemp(prefix="claimloom-"))
            named = _OWN[-1]
        sc.setCheckpointDir(named)
    return df.checkpoint()


def ancestors(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(origin, node, depth): all nodes within ``depth`` hops of each start, least depth; each
    node is visited once per origin.  ``edges``: src, dst.  ``start``: node."""
    frontier = start.select(F.col("node").alias("origin"), "node").distinct().withColumn("depth", F.lit(0))
    seen = frontier
    links = edges.select("src", "dst").where("dst IS NOT NULL").distinct()
    for hop in range(1, depth + 1):
        step = frontier.join(links, frontier["node"] == links["src"]).select("origin", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("depth", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def reach(edges: DataFrame, roots: DataFrame, most: int = 100) -> DataFrame:
    """Nodes from which a root can be reached (roots included): reverse walk until no growth."""
    seen = frontier = cut(roots.select("node").distinct())
    links = edges.select("src", "dst").distinct()
    for _ in range(most):
        step = links.join(frontier, links["dst"] == frontier["node"]).select(F.col("src").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti"))
        if not frontier.limit(1).count():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError("reach did not settle")


def cyclic_core(edges: DataFrame, most: int = 100) -> DataFrame:
    """Edges that remain after nodes without incoming edges are peeled off, again and again; no
    rows mean that the graph has no cycle."""
    left = cut(edges.select("src", "dst").distinct())
    size = left.count()
    for _ in range(most):
        kept = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        now = kept.count()
        if now == size:
            return kept
        left, size = kept, now
    raise RuntimeError("peeling did not settle")


def closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """Transitive pairs (src, dst) of one relation type, by doubling."""
    pairs = cut(edges.select("src", "dst").distinct())
    size = pairs.count()
    for _ in range(most):
        more = pairs.alias("a").join(pairs.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        pairs = cut(pairs.union(more).distinct())
        now = pairs.count()
        if now == size:
            return pairs
        size = now
    raise RuntimeError("closure did not settle")


def chains(edges: DataFrame, start: DataFrame, goals: DataFrame, depth: int) -> DataFrame:
    """The shortest path from each start to a goal: origin, path; ties by path."""
    links = edges.select("src", "dst").distinct()
    front = start.select(F.col("node").alias("origin"), "node", F.array("node").alias("path")).distinct()
    found = front
    for _ in range(depth):
        step = front.join(links, front["node"] == links["src"]).where(~F.array_contains("path", F.col("dst")))
        step = step.select("origin", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        front = cut(step.groupBy("origin", "node").agg(F.min("path").alias("path")))
        found = found.unionByName(front)
    at_goal = found.join(goals.select("node").distinct(), "node", "left_semi")
    return at_goal.groupBy("origin").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("best")).select("origin", "best.path")


def same_events(events: DataFrame) -> DataFrame:
    """Pairs of events with the same hub, time and place whose shared roles have the same fillers.
    ``events``: event_id, hub, time, place, roles (map)."""
    a, b = events.alias("a"), events.alias("b")
    keys = (F.col("a.hub") == F.col("b.hub")) & F.col("a.time").eqNullSafe(F.col("b.time")) & F.col("a.place").eqNullSafe(F.col("b.place"))
    pairs = a.join(b, keys & (F.col("a.event_id") < F.col("b.event_id")))
    shared = F.array_intersect(F.map_keys("a.roles"), F.map_keys("b.roles"))
    return pairs.where(F.forall(shared, lambda r: F.col("a.roles")[r] == F.col("b.roles")[r])).select(F.col("a.event_id").alias("left_id"), F.col("b.event_id").alias("right_id"))


def walks(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(origin, node, depth): every step of every path from each start within ``depth`` hops; a node
    reached in two ways stands twice."""
    front = start.select(F.col("node").alias("origin"), "node").distinct().withColumn("depth", F.lit(0))
    links = edges.select("src", "dst").where("dst IS NOT NULL")
    out = None
    for hop in range(1, depth + 1):
        front = front.join(links, front["node"] == links["src"]).select("origin", F.col("dst").alias("node"), F.lit(hop).alias("depth"))
        out = front if out is None else out.unionByName(front)
    return out


def minimal_events(events: DataFrame, node: str, lemma: str, event: str) -> DataFrame:
    """(node, event, necessary): an event is necessary when, without it, the node's events are those of
    another node of its lemma.  One set for each node and left-out event meets the whole sets by
    equality, so no pairs of nodes arise."""
    sets = events.groupBy(lemma, node).agg(F.sort_array(F.collect_set(event)).alias("_all"))
    less = sets.select(lemma, node, F.explode("_all").alias(event), "_all").select(lemma, node, event, F.array_except("_all", F.array(event)).alias("_rest"))
    others = sets.select(F.col(lemma).alias("_l"), F.col(node).alias("_n"), F.col("_all").alias("_s"))
    met = less.join(others, (F.col(lemma) == F.col("_l")) & (F.col("_rest") == F.col("_s")) & (F.col(node) != F.col("_n")), "left_semi")
    return less.select(node, event).join(met.select(node, event, F.lit(True).alias("necessary")), [node, event], "left").withColumn("necessary", F.coalesce("necessary", F.lit(False)))


def inherited_events(edges: DataFrame, own: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(node, hub, event, source): for each node and verb hub the event that holds: the node's own, else
    that of the ancestor deepest in the hierarchy, then of the newest; a manual choice goes over all.
    ``edges``: src, dst (parent).  ``own``: node, hub, event, manual.  ``nodes``: node, depth, created."""
    above = ancestors(edges, nodes.select("node"), depth).select(F.col("origin").alias("node"), F.col("node").alias("source"), F.col("depth").alias("far"))
    facts = own.select(F.col("node").alias("source"), "hub", "event", "manual").join(nodes.select(F.col("node").alias("source"), F.col("depth").alias("deep"), "created"), "source")
    w = Window.partitionBy("node", "hub").orderBy(F.desc("manual"), (F.col("far") > 0).cast("int"), F.desc("deep"), F.desc("created"), "source", "event")
    return above.join(facts, "source").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("node", "hub", "event", "source")


def stage_order(needs: dict[str, list[str]]) -> list[str]:
    """Stages of a plan in an order that respects their needs, alike on every run; a cycle raises."""
    sorter = graphlib.TopologicalSorter(needs)
    sorter.prepare()
    out: list[str] = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out += ready
        sorter.done(*ready)
    return out
