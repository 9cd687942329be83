"""Alignment of concepts slot by slot: results, metric constraints, traces and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.model import CONFIDENCE, ROLES

# Factors to SI units.
UNITS = {
    "m": ("length", 1.0), "mm": ("length", 0.001), "cm": ("length", 0.01), "km": ("length", 1000.0), "in": ("length", 0.0254), "ft": ("length", 0.3048),
    "kg": ("mass", 1.0), "g": ("mass", 0.001), "t": ("mass", 1000.0), "lb": ("mass", 0.45359237),
    "s": ("time", 1.0), "min": ("time", 60.0), "h": ("time", 3600.0), "d": ("time", 86400.0),
    "Pa": ("pressure", 1.0), "kPa": ("pressure", 1000.0), "MPa": ("pressure", 1000000.0), "bar": ("pressure", 100000.0),
}


def si_value(value: Column, unit: Column) -> Column:
    table = F.create_map(*[x for k, (_, f) in UNITS.items() for x in (F.lit(k), F.lit(f))])
    return value * table[unit]


def dimension(unit: Column) -> Column:
    table = F.create_map(*[x for k, (d, _) in UNITS.items() for x in (F.lit(k), F.lit(d))])
    return table[unit]


def meets(required: Column, operator: Column, tolerance: Column, offered: Column) -> Column:
    """Does an offered SI value meet a requirement?  Null when either is unknown."""
    room = F.coalesce(tolerance, F.lit(0.0))
    return (
        F.when(operator == ">=", offered >= required - room)
        .when(operator == "<=", offered <= required + room)
        .when(operator == ">", offered > required - room)
        .when(operator == "<", offered < required + room)
        .otherwise(F.abs(offered - required) <= room)
    )


def compare_slots(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left_id, right_id, slot, result, score): slots of ``left`` against those of ``right`` for the
    pairs asked.  Inputs: id, slot, fillers (array of string).  A slot that only the left has is a
    GAP; score is the share of its fillers that the right has."""
    l = pairs.join(left.select(F.col("id").alias("left_id"), "slot", F.col("fillers").alias("need")), "left_id")
    r = right.select(F.col("id").alias("right_id"), "slot", F.col("fillers").alias("have"))
    both = l.join(r, ["right_id", "slot"], "left")
    score = F.when(F.size("need") == 0, 1.0).otherwise(F.size(F.array_intersect("need", F.coalesce("have", F.array().cast("array<string>")))) / F.size("need"))
    return both.withColumn("score", score).withColumn("result", F.when(F.col("have").isNull(), "GAP").when(F.col("score") >= 1, "MATCH").when(F.col("score") > 0, "PARTIAL").otherwise("MISMATCH")).select("left_id", "right_id", "slot", "result", "score")


def confidence(score: Column) -> Column:
    out = F.lit(CONFIDENCE[0])
    for name, least in zip(CONFIDENCE[1:], (0.2, 0.4, 0.6, 0.8, 1.0)):
        out = F.when(score >= least, name).otherwise(out)
    return out


def report(slots: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Per pair: overall score, verdict, proof trace of all slots, gaps below the threshold."""
    row = F.struct("slot", "result", "score")
    grouped = slots.groupBy("left_id", "right_id").agg(F.avg("score").alias("overall"), F.bool_and(F.col("score") >= threshold).alias("complies"), F.sort_array(F.collect_list(row)).alias("trace"))
    return grouped.withColumn("gaps", F.transform(F.filter("trace", lambda s: s["score"] < threshold), lambda s: s["slot"])).withColumn("confidence", confidence(F.col("overall")))


#: The 18 slots of a concept: what it is, what it consists of, its roles, and its constraints.
SLOTS = ["IS_A", "HAS_PART", *ROLES, "HAS_CONSTRAINT"]


def slot_holds(operator: Column, need: Column, have: Column) -> Column:
    """Does a slot's logical expression hold over the fillers on the other side?  AND is the default;
    XOR wants exactly one, NOT none."""
    hits = F.size(F.array_intersect(need, have))
    return F.when(operator == "OR", hits > 0).when(operator == "XOR", hits == 1).when(operator == "NOT", hits == 0).otherwise(hits == F.size(F.array_distinct(need)))


def align(left: DataFrame, right: DataFrame, pairs: DataFrame, both_ways: bool = False, grounded: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id, aligned, checked, failed): concepts (id, slot, operator, fillers) that agree.

    Only slots that both sides fill must agree, and only the 18 known ones count; ``both_ways`` asks the
    same from right to left; with ``grounded`` (id) a pair aligns only where both are grounded."""

    def one_way(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
        l = pairs.join(a.where(F.col("slot").isin(SLOTS)).select(F.col("id").alias(x), "slot", F.col("operator").alias("_o"), F.col("fillers").alias("_need")), x)
        r = b.where(F.size("fillers") > 0).select(F.col("id").alias(y), "slot", F.col("fillers").alias("_have"))
        return l.where(F.size("_need") > 0).join(r, [y, "slot"]).select("left_id", "right_id", "slot", slot_holds(F.coalesce("_o", F.lit("AND")), F.col("_need"), F.col("_have")).alias("holds"))

    held = one_way(left, right, "left_id", "right_id")
    if both_ways:
        held = held.unionByName(one_way(right, left, "right_id", "left_id"))
    rows = held.groupBy("left_id", "right_id").agg(F.count_distinct("slot").alias("checked"), F.array_sort(F.collect_set(F.when(~F.col("holds"), F.col("slot")))).alias("failed"))
    out = pairs.join(rows, ["left_id", "right_id"], "left").withColumn("checked", F.coalesce("checked", F.lit(0))).withColumn("failed", F.coalesce("failed", F.array().cast("array<string>")))
    out = out.withColumn("aligned", F.size("failed") == 0)
    for side in ("left_id", "right_id") if grounded is not None else ():
        known = grounded.select(F.col("id").alias(side), F.lit(True).alias("_g")).distinct()
        out = out.join(known, side, "left").withColumn("aligned", F.col("aligned") & F.coalesce("_g", F.lit(False))).drop("_g")
    return out.select("left_id", "right_id", "aligned", "checked", "failed")
