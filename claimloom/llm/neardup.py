"""MinHash near-duplicate detection by fast similarity sketching.

1. Each text becomes its set of k-word shingles (64-bit hashes).  Equal sets form a class, whose
   smallest document stands for it; only these go on.
2. A sketch of t coordinates is filled in rounds: in round i every element is thrown into one bin
   with a value in [i, i+1); after t rounds bin i-t takes what is left, so every coordinate is
   filled after 2t rounds at most and its minimum agrees between two sets with the probability of
   their Jaccard similarity, with the concentration of t independent samples.
3. Bands of the sketch give candidate components.  A component's sets are dealt to blocks of bounded
   size, so one that holds a third of all rows is spread over many tasks.  Each block is linked by
   itself, together with the component's smallest document; only where several groups remain do its
   blocks meet in pairs.
4. Within a group the sketches screen pairs of different components, and full sets decide.  Only
   the links that join components leave the task: a spanning forest says as much as all pairs.
5. Components of the links are found by star rounds over written tables.

Recall: with t = 125 in 25 bands of 5, a pair at similarity 0.85 is missed with probability 4e-7
by the bands and below 1e-6 by the screen (cut 5.5 standard deviations below the threshold).

Edges: null, empty and blank texts have no shingles and stand alone; fewer words than k make one
shingle of the whole sequence; repeated rows share a class; a row with a null id stands for none: it
belongs to the documents with its very set, and without such it has no component and is kept (the
pipeline numbers such rows first, so that they are judged like any other); further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import _common as C
from claimloom.llm import textkernel as K

BANDS, ROWS = 25, 5
SLICE = 1 << 20
BLOCK_DOCS = 1500
SALTS = 16
BLOCK_SHINGLES = 2_000_000


def sketches(values: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, a row of t values for each set (all ones for an empty set)."""
    n = len(first) - 1
    out = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    sizes = np.diff(first)
    doc = np.repeat(np.arange(n), sizes)
    active = sizes > 0
    for i in range(2 * t):
        if not len(values):
            break
        h = C.mix64(values, 1000 + i)
        value = (np.uint64(i) << np.uint64(55)) | (h >> np.uint64(9))
        if i < t:
            bin_of = (((h & np.uint64(0xFFFFFFFF)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64)
        else:
            bin_of = np.full(len(values), i - t, np.int64)
        np.minimum.at(out, doc * t + bin_of, value)
        full = (out.reshape(n, t) != np.iinfo(np.uint64).max).all(axis=1)
        still = active & ~full
        if not still.any():
            break
        keep = still[doc]
        if not keep.all():
            values, doc = values[keep], doc[keep]
        active = still
    return out.reshape(n, t)


def _sets(data: np.ndarray, offs: np.ndarray, k: int):
    h, _, _, first = K.words(data, offs)
    s, docs = K.shingles(h, first, k)
    return K.distinct(s, docs, len(offs) - 1)


def fingerprints(docs: DataFrame, k: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, n_shingles, set_a, set_b, bands): a 128-bit digest of the set, band hashes."""

    def run(batches):
        for batch in batches:
            data, offs = C.col_bytes(batch.column(1))
            for lo, hi in C.byte_slices(offs, SLICE):
                values, first = _sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], k)
                n = hi - lo
                sizes = np.diff(first)
                digest = []
                for seed in (11, 12):
                    total = np.zeros(len(values) + 1, np.uint64)
                    np.cumsum(C.mix64(values, seed), out=total[1:])
                    digest.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                sk = sketches(values, first, bands * rows).reshape(n, bands, rows)
                band = np.zeros((n, bands), np.uint64)
                for j in range(rows):
                    band = C.mix64(band + sk[:, :, j], j)
                band = C.mix64(band + np.arange(bands, dtype=np.uint64), 50).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(band.reshape(-1)))
                yield C.record([(id_col, batch.column(0).slice(lo, n)), ("n_shingles", pa.array(sizes)), ("set_a", pa.array(digest[0])), ("set_b", pa.array(digest[1])), ("bands", lists)])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(C.lean(run), f"`{id_col}` {kind}, n_shingles long, set_a long, set_b long, bands array<long>")


def _member_sets(members: DataFrame, k: int, t: int) -> DataFrame:
    """(component, blocks, id, text) to rows with the sorted set and a 16-bit sketch."""

    def run(batches):
        for batch in batches:
            data, offs = C.col_bytes(batch.column("text"))
            for lo, hi in C.byte_slices(offs, SLICE):
                values, first = _sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], k)
                sk = (C.mix64(sketches(values, first, t), 9) >> np.uint64(48)).astype(np.uint16)
                yield C.record(
                    [(c, batch.column(c).slice(lo, hi - lo)) for c in ("component", "blocks", "id")]
                    + [("shingles", C.binary_rows(values, first)), ("sketch", C.binary_rows(sk.reshape(-1), np.arange(hi - lo + 1) * t))]
                )

    return members.select("component", "blocks", "id", "text").mapInArrow(C.lean(run), "component long, blocks long, id long, shingles binary, sketch binary")


def forest(ids: np.ndarray, side: np.ndarray, label: np.ndarray, sets: list[np.ndarray], sketch: np.ndarray, percent: int, cut: float):
    """Links of a spanning forest over pairs at or above the threshold.  Pairs of one ``label``, or
    joined by links found before, need no check; with two sides only pairs across them are looked at."""
    m, t = sketch.shape
    sizes = np.array([len(s) for s in sets])
    lab = np.unique(label, return_inverse=True)[1]
    links = []
    across = side.min() != side.max()
    least = math.ceil(cut * t)
    for lo in range(0, m, 64):
        hi = min(m, lo + 64)
        agree = (sketch[lo:hi, None, :] == sketch[None, :hi, :]).sum(axis=2, dtype=np.int16)
        for x in range(lo, hi):
            near = np.flatnonzero(agree[x - lo, :x] >= least)
            if across:
                near = near[side[near] != side[x]]
            near = near[lab[near] != lab[x]]
            if not len(near):
                continue
            small, large = np.minimum(sizes[near], sizes[x]), np.maximum(sizes[near], sizes[x])
            near = near[100 * small >= percent * large]
            near = near[np.argsort(-agree[x - lo, near], kind="stable")]
            while len(near):
                y = near[0]
                a, b = (sets[x], sets[y]) if sizes[x] <= sizes[y] else (sets[y], sets[x])
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum())
                if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                    links.append((ids[x], ids[y]))
                    lab[lab == lab[y]] = lab[x]
                    near = near[lab[near] != lab[x]]
                else:
                    near = near[1:]
    return links


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Two documents are linked when 100 * |A & B| >= percent * |A | B| on their full shingle sets.
    """
    t = bands * rows
    level = percent / 100
    cut = max(0.0, level - 5.5 * math.sqrt(level * (1 - level) / t))
    spark = docs.sparkSession
    prints = C.written(fingerprints(docs, k, bands, rows, id_col, text_col), "prints", free=True)
    classes = prints.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min(id_col).alias("rep"))
    reps = prints.join(classes.select(F.col("rep").alias(id_col)), id_col, "left_semi").where("n_shingles > 0")
    in_bands = reps.select(F.col(id_col).alias("id"), "n_shingles", F.explode("bands").alias("band"))
    buckets = in_bands.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    edges = in_bands.join(buckets, "band").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    parts = C.min_components(edges, "candidates")
    weighed = parts.join(reps.select(F.col(id_col).alias("id"), "n_shingles"), "id").groupBy("component").agg(F.countDistinct("id").alias("docs"), F.sum("n_shingles").alias("shingles"))
    blocks = weighed.select("component", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.lit(1)).cast("long").alias("blocks"))
    members = parts.join(blocks, "component")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # members are the smaller side whatever the size of the corpus: texts are never sorted for this join
    held = C.written(_member_sets(texts.join(members.hint("shuffle_hash"), "id"), k, t).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks"))), "sets", free=True)
    keys = ["component", "i", "j"]

    def link(batches):
        for group in C.key_runs(batches, keys):
            ids = group.column("id").to_numpy()
            fresh = np.concatenate([[True], ids[1:] != ids[:-1]])
            if not fresh.all():  # one id on several rows
                group = group.filter(pa.array(fresh))
                ids = ids[fresh]
            if len(ids) < 2:
                continue
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("shingles")]
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(len(ids), t)
            found = forest(ids, group.column("side").to_numpy(), group.column("label").to_numpy(), sets, sketch, percent, cut)
            if found:
                a, b = zip(*found)
                yield C.record([("a", pa.array(a, pa.int64())), ("b", pa.array(b, pa.int64()))])

    def links_in(groups: DataFrame) -> DataFrame:
        laid = groups.repartition(C.shuffle_parts(spark), *keys).sortWithinPartitions(*keys, "id")
        return laid.mapInArrow(C.lean(link), "a long, b long")

    # first each block by itself, together with the component's smallest document: a family of near
    # copies joins through it, and its blocks need not meet in pairs
    fields = ["component", "i", "j", "side", "label", "id", "shingles", "sketch"]
    hub = held.where("id = component AND blocks > 1").withColumn("i", F.explode(F.expr("sequence(0L, blocks - 1)"))).where("i <> own")
    inside = held.withColumn("i", F.col("own")).unionByName(hub).withColumn("j", F.col("i")).withColumn("side", F.lit(0)).withColumn("label", F.col("id"))
    first = C.written(links_in(inside.select(*fields)), "links")
    links = C.written(C.min_components(first, "links"), "links")
    # then pairs of blocks, where a candidate component still falls into several groups
    own = members.where("blocks > 1").join(links.withColumnRenamed("component", "label"), "id", "left").select("id", "component", F.coalesce("label", "id").alias("label"))
    apart = own.groupBy("component").agg(F.min("label").alias("one"), F.max("label").alias("two")).where("one < two").select("component")
    apart = C.written(own.join(apart, "component").select("id", "label"), "apart")
    if apart.limit(1).count():
        again = held.join(apart, "id").withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).where("other <> own")
        again = again.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", (F.col("own") == F.col("j")).cast("int"))
        links = C.written(C.min_components(first.unionByName(links_in(again.select(*fields))), "links"), "links")
    C.dropped(held)
    # only sets with copies need the join; these are salted, for one set may hold a third of all rows
    key = ["set_a", "set_b", "n_shingles"]
    copied = prints.where("n_shingles > 0").groupBy(*key).agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copied = copied.select(*key, "rep", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    own = prints.select(id_col, *key, F.pmod(F.xxhash64(id_col), F.lit(SALTS)).alias("salt")).join(copied, [*key, "salt"], "left")
    own = own.withColumn("rep", F.coalesce("rep", F.when(F.col("n_shingles") > 0, F.col(id_col))))
    out = own.join(links, own["rep"] == links["id"], "left")
    component = F.coalesce("component", "rep", F.col(id_col))
    return out.select(id_col, "n_shingles", component.alias("component_id"), F.coalesce(F.col(id_col) == component, component.isNull()).alias("kept"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read_table(spark, sf_dir, "documents"), k=3, percent=85)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP6_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+'), []) AS t FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(t) < 3 THEN array_to_string(t, ' ') ELSE array_to_string(t[i:i + 2], ' ') END AS g
      FROM (SELECT doc_id, t, unnest(generate_series(1, greatest(len(t) - 2, 1))) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
