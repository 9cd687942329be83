"""Mixing sources to target weights by systematic sampling.

A source's target is its weight's share of the wanted total, held at ``cap`` times its size; the
excess is shared again by weight until no source is above.  Each document of a source expects
target / size copies; the prefix sums of these, shifted by one random offset per source, emit a
document once per integer crossed.  Documents stand by size within their source, so neighbours
that swap places differ little and the words taken stay near the target.

Ranks within a source come from a range-partitioned sort and counts by partition, so a source
that holds a third of all rows is spread over many tasks.

Edges: a null or blank text has size 0 and adds nothing; null is a source of its own, last;
repeated rows count each; an empty table gives no rows; further columns stay out.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import _common as C

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = 2026
WORD = r"[^\x20\x09-\x0D]+"


def offset_of(source: str | None, seed: int = SEED) -> float:
    named = f"{seed}:null" if source is None else f"{seed}:s{source}"
    return int(hashlib.md5(named.encode()).hexdigest()[:8], 16) / 4294967296.0


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> dict[str | None, float]:
    """Water-filling: sources in order of cap over weight fill up first."""
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ordered)}
    wanted = share * sum(sizes.values())
    held, open_w = 0, sum(weight.values())
    out: dict[str | None, float] = {}
    by_ratio = sorted(ordered, key=lambda s: (cap * sizes[s] / weight[s], ordered.index(s)))
    for i, s in enumerate(by_ratio):
        level = (wanted - held) / open_w
        if level * weight[s] < cap * sizes[s]:
            for t in by_ratio[i:]:
                out[t] = min(level * weight[t], float(cap * sizes[t]))
            break
        out[s] = float(cap * sizes[s])
        held += cap * sizes[s]
        open_w -= weight[s]
    return out


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """Columns doc_id, size, source, source_size, target, copies; and ``row_col`` where one is named."""
    spark = docs.sparkSession
    own = [row_col] if row_col else []
    sized = docs.select(F.col(id_col), *own, F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = C.written(sized, "sizes")  # words are counted once; sampling and sorting read the counts
    ranked, rows = C.group_ranks(sized, "source", ["size", id_col, *own], "mix")
    C.dropped(sized)
    # a row for each source: sources are what the weights name, a list held by people
    sizes = {r["source"]: int(r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goal = targets(sizes, weights, share, cap) if sizes else {}
    lines = [(s, sizes[s], goal[s], goal[s] / sizes[s] if sizes[s] else 0.0, offset_of(s, seed)) for s in sizes]
    plan = spark.createDataFrame(lines, "s string, source_size long, target double, each double, first double")
    crossed = F.floor(F.col("first") + F.col("each") * (F.col("rank") + 1)) - F.floor(F.col("first") + F.col("each") * F.col("rank"))
    # rank * each loses its last bits at very large ranks, which must not lift a document above the cap
    copies = F.least(F.greatest(crossed, F.lit(0)), F.lit(cap))
    return ranked.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(id_col, *own, "size", "source", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents themselves, each as many times as the mix takes it; columns of the input.
    Copies meet their row by a number of its own, so null and repeated ids gather nowhere."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), F.struct(*[c for c in docs.columns if c != text_col]).alias("row"))
    rows = C.one_per_row(base, "id", "own")
    copies = C.written(mix(rows, id_col="id", row_col="own", **how).where("copies > 0").select("own", F.col("copies").cast("int").alias("n")), "copies")
    # the plan is the same at every size: texts move once, and only the copies are held for the join
    joined = rows.drop("id", "source").join(copies.hint("shuffle_hash"), "own")
    many = joined.select("row", "text", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return many.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("copies").cast("long").alias("copies"))


OP9_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
      row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
o AS (SELECT *, coalesce(sum(2 * source_size) OVER before, 0) AS held, (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER before, 0) AS open_w,
      row_number() OVER (ORDER BY 2.0 * source_size / weight, place) AS i FROM w
      WINDOW before AS (ORDER BY 2.0 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, ((SELECT CAST(1.5 AS DOUBLE) * sum(source_size) FROM s) - CAST(held AS DOUBLE)) / CAST(open_w AS DOUBLE) AS level FROM o),
f AS (SELECT min(i) AS i FROM l WHERE level * weight < 2 * source_size),
t AS (SELECT l.source, l.source_size, CASE WHEN f.i IS NULL OR l.i < f.i THEN CAST(2 * l.source_size AS DOUBLE)
      ELSE least((SELECT level FROM l, f WHERE l.i = f.i) * l.weight, CAST(2 * l.source_size AS DOUBLE)) END AS target,
      CAST(CAST('0x' || substr(md5(CASE WHEN l.source IS NULL THEN '{SEED}:null' ELSE '{SEED}:s' || l.source END), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS first FROM l, f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.first, CASE WHEN t.source_size = 0 THEN CAST(0 AS DOUBLE) ELSE t.target / CAST(t.source_size AS DOUBLE) END AS each,
      row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS n FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(floor(first + each * (n + 1)) - floor(first + each * n) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
