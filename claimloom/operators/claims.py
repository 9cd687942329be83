"""The claim store: groups, links, patterns, trust, time, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_groups(members: DataFrame, key: str, member: str, least: int = 2) -> DataFrame:
    """Groups of members that share a key: key, members (sorted array), size."""
    grouped = members.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(member)).alias("members"))
    return grouped.withColumn("size", F.size("members")).where(F.col("size") >= least)


def discourse_buckets(rows: DataFrame, doc: str, sentence: str, member: str, width: int = 3) -> DataFrame:
    """Members whose sentences fall into the same run of ``width``."""
    bucket = F.floor(F.col(sentence) / width).cast("long")
    return rows.withColumn("bucket", bucket).groupBy(doc, "bucket").agg(F.count(member).alias("size"), F.min(member).alias("first"), F.max(member).alias("last")).where("size >= 2")


def precedes(rows: DataFrame, within: list[str], order: list[str], member: str) -> DataFrame:
    """Links from each member to the next of its group."""
    nxt = F.lead(member).over(Window.partitionBy(*within).orderBy(*order))
    return rows.select(*within, F.col(member).alias("source"), nxt.alias("target")).where("target IS NOT NULL").withColumn("link_type", F.lit("PRECEDES"))


def context(rows: DataFrame, within: list[str], order: str, text: str, reach: int = 1) -> Column:
    """The texts around a row, joined by blanks."""
    w = Window.partitionBy(*within).orderBy(order).rowsBetween(-reach, reach)
    return F.array_join(F.collect_list(text).over(w), " ")


def preferred(rows: DataFrame, within: list[str], score: str, tie: str) -> DataFrame:
    """Flags the best row of each group."""
    return rows.withColumn("preferred", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(score), tie)) == 1)


def match_pattern(spokes: DataFrame, filled: dict[str, list], open_roles: list[str], claim: str = "synapse_id") -> DataFrame:
    """Claims whose filled roles hold one of the given targets, with the targets of open roles.
    ``spokes``: claim, role, target_id.  One aggregate over the spokes of the wanted roles replaces
    a join for each role."""
    wanted = [*filled, *open_roles]
    held = [F.max(F.when((F.col("role") == r) & F.col("target_id").isin(v), 1).otherwise(0)).alias(f"_{i}") for i, (r, v) in enumerate(filled.items())]
    picked = [F.min(F.when(F.col("role") == r, F.col("target_id"))).alias(r) for r in open_roles]
    grouped = spokes.where(F.col("role").isin(wanted)).groupBy(claim).agg(*held, *picked)
    for i in range(len(filled)):
        grouped = grouped.where(F.col(f"_{i}") == 1)
    return grouped.select(claim, *open_roles)


def gap_report(patterns: DataFrame, claims: DataFrame, roles: list[str], claim: str, keep: int = 2) -> DataFrame:
    """For each pattern the ``keep`` claims that agree on most roles, and the roles that differ.
    Candidates share at least one filler, found by joins on (role, filler) rather than a product."""
    long = lambda df, key: df.select(key, F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).cast("string").alias("filler")) for r in roles])).alias("s")).select(key, "s.*").where("filler IS NOT NULL")
    p, c = long(patterns, "query_id"), long(claims, claim)
    agree = p.join(c, ["role", "filler"]).groupBy("query_id", claim).agg(F.count(F.lit(1)).alias("agreed"), F.sort_array(F.collect_set("role")).alias("same"))
    asked = p.groupBy("query_id").agg(F.sort_array(F.collect_set("role")).alias("asked"))
    best = Window.partitionBy("query_id").orderBy(F.desc("agreed"), claim)
    ranked = agree.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    return ranked.join(asked, "query_id").withColumn("missing", F.array_except("asked", "same"))


def participants(members: DataFrame, entity: str, claim: str, least: int = 2) -> DataFrame:
    return members.groupBy(entity).agg(F.count_distinct(claim).alias("events")).where(F.col("events") >= least)


def as_of(rows: DataFrame, at: Column, start: str = "valid_from", stop: str = "valid_until") -> DataFrame:
    """Rows valid at a time; intervals are half open and a null end is open."""
    return rows.where((F.col(start) <= at) & (F.col(stop).isNull() | (at < F.col(stop))))


def trust_lens(
    rows: DataFrame,
    most_rank: int = 7,
    min_confidence: float | None = None,
    classes: list[str] | None = None,
    statuses: list[str] | None = None,
    horizon: Column | None = None,
    derivations: list[str] | None = None,
    opinions: bool = True,
    testimony: bool = True,
    contradictions: str = "keep",
    key: list[str] | None = None,
    value: str = "value",
) -> DataFrame:
    """Claims as a reader trusts them: by source class, epistemic status, derivation, tier, confidence,
    time, with or without opinions and testimony (column kind), each only when asked.  Contradictions,
    several values of one ``key``, are kept, dropped, or settled for the latest."""
    for column, wanted in (("source_class", classes), ("status", statuses), ("derivation", derivations)):
        if wanted:
            rows = rows.where(F.col(column).isin(wanted))
    for kind, allowed in (("opinion", opinions), ("testimony", testimony)):
        if not allowed:
            rows = rows.where(F.coalesce(F.col("kind") != kind, F.lit(True)))
    if min_confidence is not None:
        rows = rows.where(F.col("confidence") >= min_confidence)
    if horizon is not None:
        rows = rows.where(F.col("recorded_at") >= horizon)
    if "tier_rank" in rows.columns:
        rows = rows.where(F.col("tier_rank") <= most_rank)
    if contradictions == "keep":
        return rows
    several = rows.groupBy(*key).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).where("_a <> _b").select(*key)
    if contradictions == "drop":
        return rows.join(several, key, "left_anti")
    if contradictions != "latest":
        raise ValueError(f"contradictions are kept, dropped or settled, not {contradictions}")
    return resolve_conflicts(rows, key, [F.desc("recorded_at"), F.asc(value)])


def resolve_conflicts(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One claim for each key by recency, authority or consensus, as ``order`` says."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def nearest_preceding(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """As-of join: for each left row the latest right value of its key strictly before.  One pass
    over the union, so no product of rows arises."""
    both = left.select(key, at, F.lit(1).alias("_side"), *[F.col(c) for c in left.columns if c not in (key, at)], F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    both = both.unionByName(right.select(key, at, F.lit(0).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def decayed(value: Column, age_days: Column, half_life: float) -> Column:
    return value * F.exp(-F.log(F.lit(2.0)) * age_days / half_life)


def latest_version(edges: DataFrame, most: int = 64) -> DataFrame:
    """Follow SUPERSEDED-BY links (old, new) to the end by doubling: old, latest.  Each round is cut off
    from the one before, so the plan stays as long as one round."""
    from claimloom.operators.graph import cut

    now = cut(edges.select("old", F.col("new").alias("latest")))
    for _ in range(most):
        step = cut(now.alias("a").join(now.alias("b"), F.col("a.latest") == F.col("b.old"), "left").select(F.col("a.old").alias("old"), F.coalesce("b.latest", "a.latest").alias("latest"), F.col("b.old").isNotNull().alias("moved")))
        if not step.where("moved").limit(1).count():
            return now
        now = step.select("old", "latest")
    raise RuntimeError("a chain of versions has a cycle")


def shared_predicates(claims: DataFrame, predicate: list[str], member: str, least: int = 2) -> DataFrame:
    """Groups of claims with one predicate: the first of ``predicate`` that is there (id, then lemma)."""
    return shared_groups(claims.withColumn("predicate", F.coalesce(*predicate)), "predicate", member, least)


def group_signals(groups: DataFrame, signal: str) -> DataFrame:
    return groups.groupBy(signal).agg(F.count(F.lit(1)).alias("groups"))


def as_known(rows: DataFrame, valid: Column, known: Column, start: str = "valid_from", stop: str = "valid_until", recorded: str = "recorded_at", withdrawn: str | None = None) -> DataFrame:
    """Rows valid at one time as they were known at another: both axes half open, null ends open."""
    out = as_of(rows, valid, start, stop).where(F.col(recorded) <= known)
    return out.where(F.col(withdrawn).isNull() | (known < F.col(withdrawn))) if withdrawn else out


def overlapping(left: DataFrame, right: DataFrame, start: str, stop: str, width: int, by: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose half-open intervals (numbers) overlap, each once, as columns l and r.  Every
    interval goes into the buckets of ``width`` that it touches, rows meet bucket by bucket, and a pair
    counts in the bucket where the later one starts."""
    by = by or []
    spread = lambda df, name: df.where(F.col(stop) > F.col(start)).select(F.struct(*df.columns).alias(name), *[F.col(c).alias(f"_{c}") for c in by], F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width))).alias("_b"))
    both = spread(left, "l").join(spread(right, "r"), ["_b", *[f"_{c}" for c in by]])
    met = (F.col(f"l.{start}") < F.col(f"r.{stop}")) & (F.col(f"r.{start}") < F.col(f"l.{stop}"))
    return both.where(met & (F.col("_b") == F.floor(F.greatest(f"l.{start}", f"r.{start}") / width))).select("l", "r")


def interval_relation(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """How one half-open interval stands to another: BEFORE, AFTER, CONTAINS or OVERLAPS."""
    return F.when(a_stop <= b_start, "BEFORE").when(b_stop <= a_start, "AFTER").when((a_start <= b_start) & (b_stop <= a_stop), "CONTAINS").otherwise("OVERLAPS")


def range_covers(offered_lo: Column, offered_hi: Column, required_lo: Column, required_hi: Column) -> Column:
    """Does an offered range contain the required one?  A null bound is open."""
    low = offered_lo.isNull() | (required_lo.isNotNull() & (offered_lo <= required_lo))
    return low & (offered_hi.isNull() | (required_hi.isNotNull() & (offered_hi >= required_hi)))


def last_values(rows: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last values of each key of an event store."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*key, "_v.*")


def coverage(rows: DataFrame, by: list[str], matched: Column, snapped: Column, most_oov: float = 0.02) -> DataFrame:
    """For each group: total, matched, minted, snapped, the share out of vocabulary, and whether that
    halts it."""
    oov = F.count_if(~matched) / F.count(F.lit(1))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(matched).alias("matched"), F.count_if(~matched).alias("minted"), F.count_if(F.coalesce(snapped, F.lit(False))).alias("snapped"), F.round(oov, 6).alias("oov"), (oov > most_oov).alias("halts"))


def bridged(classes: DataFrame, key: str, sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Sources tagged with the classes of one closed vocabulary, joined through it: how many rows of each
    source a class has; classes that a source lacks are left out."""
    for name, (df, column) in sources.items():
        classes = classes.join(df.groupBy(F.col(column).alias(key)).agg(F.count(F.lit(1)).alias(name)), key)
    return classes


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows each table has: item, n."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def discovered(pairs: DataFrame, left: str, right: str, context: str, propose: int = 5, promote: int = 10) -> DataFrame:
    """Edges that turn up in enough distinct contexts, and whether in enough to be promoted."""
    n = pairs.groupBy(left, right).agg(F.count_distinct(context).alias("contexts")).where(F.col("contexts") >= propose)
    return n.withColumn("promoted", F.col("contexts") >= promote)


def vault_tier(confidence: Column, age_days: Column) -> Column:
    """Tiers by confidence; candidates expire after 90 days."""
    return F.when(confidence >= 0.7, "canonical").when(confidence >= 0.5, "provisional").when(age_days <= 90, "candidate").otherwise("expired")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Last write wins for each key."""
    return resolve_conflicts(old.unionByName(new), keys, [F.desc(at)])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``new`` whose key is absent, each key once."""
    return resolve_conflicts(new.join(old.select(*keys).distinct(), keys, "left_anti"), keys, [F.asc(order)])
