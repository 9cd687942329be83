"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and word pairs (letters and digits, A-Z folded) are hashed into ``buckets``.  Counts over
all target documents and over all documents give two smoothed multinomial models; a document's
log weight is the sum over its n-grams of log p_target - log p_raw.  Adding Gumbel noise, drawn
from the seed and the id, and taking the k largest keys samples k documents without replacement
in proportion to their weights.

k defaults to the share of target documents among the labelled ones, of all documents.  The k-th
key is found by distributed ranks; what reaches the driver is one count for each bucket.

Edges: null and empty texts weigh 0 (ratio one); labels that are null are neither target nor not;
without targets all weights are 0; equal keys go by id; rows that repeat an id draw the same
noise; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import _common as C
from claimloom.llm import textkernel as K

BUCKETS = 10_000
SEED = 17
SLICE = 2 << 20


def gram_buckets(data: np.ndarray, offs: np.ndarray, buckets: int):
    """Bucket and text of every word and every pair of neighbouring words."""
    h, _, _, first = K.words(data, offs, between=K.PUNCTUATED)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    pair = C.mix64(h[:-1] * np.uint64(3) + h[1:], 7)[doc[1:] == doc[:-1]] if len(h) else h
    both = np.concatenate([h, pair])
    docs = np.concatenate([doc, doc[1:][doc[1:] == doc[:-1]]]) if len(h) else doc
    return (both % np.uint64(buckets)).astype(np.int64), docs


def models(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of target and of all documents.  ``target``: distinct ids in ``id_col``."""
    flagged = docs.select(id_col, text_col).join(target.select(F.col(id_col), F.lit(1).alias("_target")).hint("shuffle_hash"), id_col, "left").select("_target", text_col)

    def run(batches):
        raw, own = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            hit = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            data, offs = C.col_bytes(batch.column(1))
            for lo, hi in C.byte_slices(offs, SLICE):
                b, d = gram_buckets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], buckets)
                raw += np.bincount(b, minlength=buckets)
                own += np.bincount(b[hit[lo:hi][d]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield C.record([("bucket", pa.array(some)), ("raw", pa.array(raw[some])), ("own", pa.array(own[some]))])

    counts = flagged.mapInArrow(C.lean(run), "bucket long, raw long, own long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("own").alias("own")).collect()  # at most ``buckets`` rows
    raw, own = np.zeros(buckets), np.zeros(buckets)
    for r in counts:
        raw[r["bucket"]], own[r["bucket"]] = r["raw"], r["own"]
    return own, raw


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    u = (C.mix64(ids.view(np.uint64), seed) >> np.uint64(11)).astype(float)
    return -np.log(-np.log((u + 0.5) / float(1 << 53)))


def resample(docs: DataFrame, target: DataFrame, share: float, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, log_weight, sample_key, sample_rank (from 1), kept."""
    own, raw = models(docs, target, buckets, id_col, text_col)
    if own.sum():
        ratio = np.log((own + 1) / (own.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    else:
        ratio = np.zeros(buckets)

    def run(batches):
        for batch in batches:
            data, offs = C.col_bytes(batch.column(1))
            ids = batch.column(0).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            weight = np.zeros(batch.num_rows)
            for lo, hi in C.byte_slices(offs, SLICE):
                b, d = gram_buckets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], buckets)
                weight[lo:hi] = np.bincount(d, weights=ratio[b], minlength=hi - lo)
            key = weight + gumbel(np.ascontiguousarray(ids), seed)
            yield C.record([(id_col, batch.column(0)), ("log_weight", pa.array(weight)), ("sample_key", pa.array(key)), ("_down", pa.array(-key)), ("_all", pa.array(np.zeros(len(ids), np.int64)))])

    kind = dict(docs.dtypes)[id_col]
    keyed = docs.select(id_col, text_col).mapInArrow(C.lean(run), f"`{id_col}` {kind}, log_weight double, sample_key double, _down double, _all long")
    keyed = C.written(keyed, "keys")
    ranked, rows = C.group_ranks(keyed, "_all", ["_down", id_col], "ranks")
    k = int(round(share * rows.count()))
    return ranked.select(id_col, "log_weight", "sample_key", (F.col("rank") + 1).alias("sample_rank"), (F.col("rank") < k).alias("kept"))


def op4_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.read_table(spark, sf_dir, "documents"), C.read_table(spark, sf_dir, "labels")
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("quality") >= 1, 1).otherwise(0)).alias("good")).first()
    return resample(docs, known.where("quality >= 1").select("doc_id"), n["good"] / n["n"] if n["n"] else 0.0)
