"""A corpus pipeline: reject toxic documents, keep one of each near-duplicate group, cut repeated
passages, mix sources to target weights, and pack the tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents.  All but the last return the columns of documents.  A
stage deletes the tables that earlier stages left in the shared folder, so write a stage's result
before the next one begins.

Edges: null ids, null and empty texts, repeated rows and empty tables pass through every stage as
its operator defines it; rows of one id with different texts are documents of their own, and so is
each row with a null id, after all others: near_dedup judges all of them by their texts; a text that
is cut to nothing stays as an empty document; further columns are kept.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import _common as C
from claimloom.llm import mixing, neardup, packing, suffixdedup, toxicity

#: 34 bands of 5 miss a pair at 0.8 with probability (1 - 0.8^5)^34 = 1.4e-6.
BANDS = 34


_LEFT: set[str] = set()


def _stage(function):
    """A stage's input is a written table: what earlier stages left in the shared folder goes when a
    stage begins that does not read it."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _LEFT
        C.small_batches(spark)
        _LEFT = C.drop_unread(docs, _LEFT)
        before = C.tables()
        out = function(spark, docs, sf_dir)
        _LEFT |= C.tables() - before
        return out

    return run_stage


@_stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, does not reject."""
    model = toxicity.fit(docs, toxicity.toxic_labels(C.read_table(spark, sf_dir, "labels")))
    return toxicity.clean_documents(docs, model)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that shares 80 % of its 5-word shingles.  Texts move once, into
    buckets of the document's number; sets and decisions come to them."""
    base = docs.select(F.col("doc_id").alias("id"), "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))
    held = C.bucketed(C.one_per_document(base, "id", "text", "doc"), "doc", "docs")
    found = neardup.near_duplicates(held, k=5, percent=80, bands=BANDS, id_col="doc")
    ids = C.written(found.where("kept").groupBy("doc").agg(F.count(F.lit(1)).alias("rows")), "kept")
    out = held.join(ids.hint("shuffle_hash"), "doc")
    once = out.where("rows = 1").select("row", "text")
    if ids.where("rows > 1").limit(1).count():
        # equal rows of one document: the first by its other columns stays
        alike = out.where("rows > 1").groupBy("doc").agg(F.min_by(F.struct("row", "text"), F.to_json("row")).alias("r"))
        once = once.unionByName(alike.select("r.*"))
    return once.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


@_stage
def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier; characters that the cut
    leaves incomplete go as well."""
    columns, types = docs.columns, docs.schema

    def run(batches):
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            null = batch.column("no_text").to_numpy(zero_copy_only=False)
            texts = [None if n else x.as_py().decode("utf-8", "ignore") for n, x in zip(null, batch.column("kept"))]
            row = batch.column("row")
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield C.record([(c, new[c] if c in new else row.field(c)) for c in columns])

    marked = docs.withColumn("_no_text", F.col("text").isNull())
    cut = suffixdedup.cut_repeats(marked).withColumn("no_text", F.col("row._no_text"))
    return cut.select("row", "kept", "no_text").mapInArrow(C.lean(run), types)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", near_dedup),
    ("suffix_dedup", cut_passages),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: A fitted model, sketches and tokens are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    global _LEFT
    docs = C.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, C.written(stage(spark, docs, sf_dir), f"stage-{name}", free=True, keep=True)
        C.dropped(before)
    _LEFT = C.drop_unread(docs, _LEFT)
    return docs
