"""Closed vocabularies and table shapes of the engine, and checks of data against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vocabularies whose members must be exactly these.
ROLES = [
    "HAS_AGENT", "HAS_PATIENT", "HAS_THEME", "HAS_EXPERIENCER", "HAS_RECIPIENT", "HAS_BENEFICIARY", "HAS_TIME", "HAS_LOCATION",
    "HAS_SOURCE", "HAS_DESTINATION", "HAS_MANNER", "HAS_INSTRUMENT", "HAS_CAUSE", "HAS_REASON", "HAS_ATTRIBUTE",
]
LINK_TYPES = ["PRECEDES", "CAUSES", "ENABLES", "SUPPORTS", "CONTRADICTS", "ELABORATES", "SUPERSEDES", "DEPENDS_ON"]
RELATION_TYPES = ["is_a", "has_part", "has_member", "has_instance", "antonym_of", "derivation"]
TIERS = {
    "CORE_ONTOLOGY": (1, 0.15), "CORE_KNOWLEDGE": (2, 0.10), "LEXICAL_EXTENSION": (3, 0.05), "CLAIMED": (4, 0.0),
    "INFERRED": (5, -0.05), "PROVISIONAL": (6, -0.10), "GHOST": (7, -0.20),
}
LEGACY_TIERS = {"raw": 99, "provisional": 6, "embedded_v1": 5, "embedded_v2": 4, "improved": 3, "clustered": 2, "related": 1}
TARGET_TYPES = ["TYPED_LITERAL", "LEXICON_ENTRY", "INSTANCE", "DOCUMENT_ENTITY", "GHOST"]
CONFIDENCE = ["NONE", "WEAK", "MODERATE", "STRONG", "VERY STRONG", "EXACT"]
POLICIES = {
    "snap_to_standard": {"min_tier": "LEXICAL_EXTENSION"},
    "snap_to_neutral": {"min_tier": "CLAIMED"},
    "preserve_register": {"min_tier": "INFERRED"},
    "research_unfiltered": {"min_tier": "GHOST"},
}

SPOKE = T.StructType([T.StructField(n, T.StringType()) for n in ("role", "target_id", "target_type", "surface")])
ENTRY = T.StructType(
    [
        T.StructField("entry_id", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("lemma", "pos_ud", "gloss", "microgloss", "canonical_id", "source_type", "definition_tier")],
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("improved_at", T.TimestampType()),
    ]
)
RELATION = T.StructType(
    [
        T.StructField("src_id", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("rel_type", "dst_lemma", "dst_cid")],
        T.StructField("match_score", T.DoubleType()),
        T.StructField("valid_from", T.TimestampType()),
        T.StructField("valid_until", T.TimestampType()),
    ]
)
SYNAPSE = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("synapse_id", "doc_id")],
        *[T.StructField(n, T.IntegerType()) for n in ("sentence", "clause")],
        *[T.StructField(n, T.StringType()) for n in ("verb_lemma", "verb_cid", "polarity")],
        T.StructField("spokes", T.ArrayType(SPOKE)),
    ]
)


def _lookup(values: dict, key: Column, default) -> Column:
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(table[key], F.lit(default))


def tier_rank(tier: Column) -> Column:
    """Rank of a tier name, current or legacy; 99 when unknown."""
    return _lookup({k: r for k, (r, _) in TIERS.items()} | LEGACY_TIERS, tier, 99)


def tier_bonus(tier: Column) -> Column:
    return _lookup({k: b for k, (_, b) in TIERS.items()}, tier, 0.0)


def unknown_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values of a column outside a closed vocabulary, with how often each occurs."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def not_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur on more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows that refer to a key which the target table lacks."""
    return df.where(F.col(column).isNotNull()).join(target.select(F.col(key).alias(column)).distinct(), column, "left_anti")
