"""Hybrid retrieval: vectors, policies, lexical scores over candidates, fusion, structure."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions.text import search_tokens
from claimloom.model import tier_bonus, tier_rank


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v)) + F.lit(1e-12)
    return F.transform(v, lambda x: x.cast("double") / norm)


def top_k(scored: DataFrame, by: list[str], score: str, tie: str, k: int, pinned: str | None = None) -> DataFrame:
    """The k best rows of each group, ties by ``tie``; rows marked by ``pinned`` stay in any case."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    keep = F.col("rank") <= k
    return ranked.where(keep | F.col(pinned)) if pinned else ranked.where(keep)


def with_policy(hits: DataFrame, min_tier: int = 7, lemma: Column | None = None, pos: Column | None = None, lemma_bonus: float = 0.20, pos_bonus: float = 0.10) -> DataFrame:
    """Adds policy_score: cosine plus bonuses; drops senses below the tier floor."""
    bonus = tier_bonus(F.col("definition_tier"))
    if lemma is not None:
        bonus = bonus + F.when(F.coalesce(lemma, F.lit(False)), lemma_bonus).otherwise(0.0)
    if pos is not None:
        bonus = bonus + F.when(F.coalesce(pos, F.lit(False)), pos_bonus).otherwise(0.0)
    return hits.where(tier_rank(F.col("definition_tier")) <= min_tier).withColumn("policy_score", F.round(F.col("cosine") + bonus, 6))


def restrict_or_all(hits: DataFrame, by: list[str], wanted: Column) -> DataFrame:
    """Rows that meet a restriction; a group without any keeps all its rows."""
    some = F.max(wanted.cast("int")).over(Window.partitionBy(*by))
    return hits.withColumn("_some", F.coalesce(some, F.lit(0))).where(wanted | (F.col("_some") == 0)).drop("_some")


def minmax(score: Column, by: list[str]) -> Column:
    """Scores of a group brought to 0..1; ones where all are equal."""
    w = Window.partitionBy(*by)
    return scaled(score, F.min(score).over(w), F.max(score).over(w))


def margin(scored: DataFrame, by: list[str], score: str) -> DataFrame:
    """Top-1 minus top-2 of normalised scores; 1 for a single row."""
    scaled = scored.select(*by, minmax(F.col(score), by).alias("_s"))
    order = Window.partitionBy(*by).orderBy(F.desc("_s"))
    two = scaled.withColumn("_n", F.row_number().over(order)).where("_n <= 2")
    return two.groupBy(*by).agg((F.max(F.when(F.col("_n") == 1, F.col("_s"))) - F.coalesce(F.max(F.when(F.col("_n") == 2, F.col("_s"))), F.lit(0.0))).alias("margin"))


def diverges(candidates: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """Does any axis take two values or more among a group's candidates (null is a value)?"""
    out = F.lit(False)
    for a in axes:
        out = out | (F.count_distinct(F.coalesce(F.col(a).cast("string"), F.lit("\0"))) > 1)
    return candidates.groupBy(*by).agg(out.alias("diverges"))


def should_fire(mode: Column, margin_: Column, threshold: float, diverges_: Column) -> Column:
    tight = margin_ < threshold
    return F.when(mode == "always", True).when(mode == "when_tight", tight).when(mode == "when_tight_divergent", tight & diverges_).otherwise(False)


def bm25_over_candidates(candidates: DataFrame, query: str, doc: str, query_text: Column, text: Column, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 with the statistics of each query's own candidates; rows (query, doc, bm25).  Every text is
    split once; terms of a document meet those of a query only in the pairs that are candidates."""
    pairs = candidates.select(query, doc)
    asked = candidates.select(F.col(query), query_text.alias("_x")).dropDuplicates([query]).select(query, F.explode(search_tokens(F.col("_x"))).alias("_term")).groupBy(query, "_term").agg(F.count(F.lit(1)).alias("_qtf"))
    tokens = candidates.select(F.col(doc), text.alias("_x")).dropDuplicates([doc]).select(doc, search_tokens(F.col("_x")).alias("_t")).withColumn("_size", F.size("_t").cast("double"))
    words = tokens.select(doc, F.explode("_t").alias("_term")).join(asked.select("_term").distinct(), "_term", "left_semi").groupBy(doc, "_term").agg(F.count(F.lit(1)).alias("_tf"))
    sized = pairs.join(tokens.select(doc, "_size"), doc)
    stats = sized.groupBy(query).agg(F.count(F.lit(1)).alias("_n"), F.avg("_size").alias("_mean"))
    held = sized.join(words, doc).join(asked, [query, "_term"])
    df = held.groupBy(query, "_term").agg(F.count(F.lit(1)).alias("_df"))
    full = held.join(df, [query, "_term"]).join(stats, query)
    idf = F.log((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1)
    part = F.col("_qtf") * idf * (F.col("_tf") * (k1 + 1)) / (F.col("_tf") + k1 * (1 - b + b * F.col("_size") / F.col("_mean")))
    scores = full.groupBy(query, doc).agg(F.sum(part).alias("bm25"))
    return pairs.join(scores, [query, doc], "left").select(query, doc, F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


def bm25(queries: DataFrame, docs: DataFrame, query: str, doc: str, query_text: Column, text: Column, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 of every query over the documents that hold one of its terms, with the statistics of all
    documents: rows (query, doc, bm25).  Each document is split once into its counts of asked terms;
    pairs of query and document arise only where they share a term."""
    asked = queries.select(F.col(query), F.explode(search_tokens(query_text)).alias("_term")).groupBy(query, "_term").agg(F.count(F.lit(1)).alias("_qtf"))
    tokens = docs.select(F.col(doc), search_tokens(text).alias("_t"))
    n, mean = tokens.agg(F.count(F.lit(1)), F.avg(F.size("_t").cast("double"))).first()
    words = tokens.select(doc, F.size("_t").alias("_size"), F.explode("_t").alias("_term"))
    held = words.join(asked.select("_term").distinct(), "_term", "left_semi").groupBy(doc, "_size", "_term").agg(F.count(F.lit(1)).alias("_tf"))
    df = held.groupBy("_term").agg(F.count(F.lit(1)).alias("_df"))
    idf = F.log((F.lit(n) - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1)
    weighed = asked.join(df, "_term").select(query, "_term", (F.col("_qtf") * idf).alias("_w"))
    part = F.col("_w") * (F.col("_tf") * (k1 + 1)) / (F.col("_tf") + k1 * (1 - b + b * F.col("_size") / F.lit(float(mean or 1.0))))
    return held.join(weighed, "_term").groupBy(query, doc).agg(F.round(F.sum(part), 6).alias("bm25"))


def half_up(x: np.ndarray) -> np.ndarray:
    """Rounded to 6 places as Spark and SQL round."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x)


def best_places(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best finite scores of each row, ties by the smaller id."""
    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    row, col = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def in_blocks(queries: DataFrame, rows: DataFrame, schema: str, reduce, block: int = 4096) -> DataFrame:
    """All queries (with qv) against all rows (with vec_id, embedding): blocks of both meet in cells, one
    matrix product each.  ``reduce(queries, rows, cosines)``, pandas frames and inner products rounded
    to 6 places, gives the columns that leave a cell, so what moves on follows the queries."""
    high, wide = (max(1, -(-x.count() // block)) for x in (queries, rows))

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        place = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        return df.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).groupBy("_high", "_wide")

    def run(q, x):
        if not len(q) or not len(x):
            return pd.DataFrame(columns=names)
        y, z = (np.stack(v.to_numpy()).astype(float) for v in (q["qv"], x["embedding"]))
        return pd.DataFrame(reduce(q, x, half_up(y @ z.T)), columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return dealt(queries, "query_id", "_high", high, "_wide", wide).cogroup(dealt(rows, "vec_id", "_wide", wide, "_high", high)).applyInPandas(run, schema)


def scaled(score: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi - lo < 1e-12, 1.0).otherwise((score - lo) / (hi - lo))


def fused(prior: Column, lexical: Column, alpha: float = 0.7, restricted: bool = False, sequential: bool = False) -> Column:
    """The weighted sum of two scores from 0 to 1.  A lemma restriction lowers the weight of the prior to
    one half; a sequential stage ranks by the lexical score alone."""
    share = 0.0 if sequential else min(alpha, 0.5) if restricted else alpha
    return share * prior + (1 - share) * lexical


def fuse(scored: DataFrame, by: list[str], prior: str, lexical: str, alpha: float = 0.7, **how) -> DataFrame:
    """Adds fused, after min-max normalisation within ``by``.  Bounds come from an aggregate, so that no
    group is gathered."""
    ends = scored.groupBy(*by).agg(*[f(c).alias(f"_{n}_{c}") for c in (prior, lexical) for n, f in (("lo", F.min), ("hi", F.max))])
    one = lambda c: scaled(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"))
    return scored.join(ends, by).withColumn("fused", fused(one(prior), one(lexical), alpha, **how)).select(*scored.columns, "fused")


def centroids(rows: DataFrame, vec: str, label: str) -> DataFrame:
    """(label, centroid) by averages of each dimension; as many rows as there are classes."""
    long = rows.where(F.col(vec).isNotNull()).select(label, F.posexplode(vec).alias("_i", "_v"))
    mean = long.groupBy(label, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return mean.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias("centroid"))


def clusters(rows: DataFrame, id_col: str, vec: str, k: int, seed: int = 1) -> DataFrame:
    """(id, cluster): a first division of untagged vectors into ``k`` classes, by distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = rows.where(F.col(vec).isNotNull()).select(id_col, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, predictionCol="cluster").fit(x)
    return model.transform(x).select(id_col, "cluster")


def nearest_centroid(rows: DataFrame, id_col: str, vec: str, label: str) -> DataFrame:
    """(id, label, score): the class of the nearest centroid for every row, ties to the smaller class.
    All centroids travel as one array beside each row; classes are a closed vocabulary."""
    lines = centroids(rows, vec, label).agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("l"), F.col("centroid").alias("c")))).alias("_all"))
    scored = rows.where(F.col(vec).isNotNull()).select(id_col, vec).join(F.broadcast(lines))
    each = F.transform("_all", lambda x: F.struct((-F.round(dot(F.col(vec), x["c"]), 6)).alias("s"), x["l"].alias("l")))
    best = scored.select(id_col, F.array_min(each).alias("_b"))
    return best.select(id_col, F.col("_b.l").alias(label), (-F.col("_b.s")).alias("score"))


def lookup_level(exact_senses: Column, cosine: Column, rerank: Column) -> Column:
    """Which step of the lookup cascade decides: 1 unique exact lemma, 2 cosine, 3 rerank, 4 mint."""
    return F.when(exact_senses == 1, 1).when(cosine >= 0.80, 2).when((rerank >= 0.65) | (cosine >= 0.65), 3).otherwise(4)


def best_or_empty(queries: DataFrame, hits: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """Batch search: the best hit of each query; queries without one stay, with nulls."""
    best = top_k(hits, [key], score, tie, 1).drop("rank")
    return queries.join(best, key, "left")


def known_compounds(queries: DataFrame, key: str, text: Column, lemmas: DataFrame, lemma: str) -> DataFrame:
    """Contiguous word pairs and triples of a query that are known lemmas."""
    words = search_tokens(text)
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    both = F.array_distinct(F.concat(grams(2), grams(3)))
    found = queries.select(key, F.explode(both).alias("compound")).where(F.contains("compound", F.lit(" ")))
    return found.join(lemmas.select(F.lower(F.col(lemma)).alias("compound")).distinct(), "compound", "left_semi").select(key, "compound")


def resolve_forms(forms: DataFrame, ranks: DataFrame) -> DataFrame:
    """Lemmas of a form: the form itself first, then by frequency rank (missing is last)."""
    joined = forms.join(ranks, "lemma", "left").withColumn("_r", F.coalesce("frequency_rank", F.lit(1_000_000_000)))
    order = Window.partitionBy("form").orderBy((F.col("form") != F.col("lemma")).cast("int"), "_r", "lemma")
    return joined.withColumn("preference", F.row_number().over(order)).drop("_r")


def slot_overlap(query_head: Column, query_isa: Column, query_parts: Column, query_modifiers: Column, lemma: Column, isa: Column, parts: Column) -> Column:
    """Weighted overlap of slots: head .5, is-a .3, parts .2 over the slots that are filled, plus
    .05 for each matching modifier up to .1; at most 1, rounded to 4 places."""
    lemma, head = F.lower(lemma), F.lower(F.coalesce(query_head, F.lit("")))  # a null lemma holds no head
    has_head, n_isa, n_parts = head != "", F.size(query_isa), F.size(query_parts)
    head_hit = F.contains(lemma, head) | F.contains(head, lemma) | F.array_contains(isa, head)
    hits = lambda a, b: F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    score = F.when(has_head & head_hit, 0.5).otherwise(0.0) + F.when(n_isa > 0, hits(query_isa, isa) / n_isa * 0.3).otherwise(0.0) + F.when(n_parts > 0, hits(query_parts, parts) / n_parts * 0.2).otherwise(0.0)
    weight = F.when(has_head, 0.5).otherwise(0.0) + F.when(n_isa > 0, 0.3).otherwise(0.0) + F.when(n_parts > 0, 0.2).otherwise(0.0)
    bonus = F.least(0.05 * F.size(F.filter(query_modifiers, lambda m: F.contains(lemma, m) | F.array_contains(isa, m))), F.lit(0.1))
    return F.round(F.least(score / F.greatest(weight, F.lit(0.01)) + bonus, F.lit(1.0)), 4)


def fingerprints(rows: DataFrame, id_col: str, vec_col: str, bits: int = 516, seed: int = 42) -> DataFrame:
    """Signs against seeded hyperplanes: words (array of long, 9 for 516 bits) and Base64URL text."""

    def run(batches):
        for pdf in batches:
            x = np.array([np.asarray(v, float) for v in pdf[vec_col]])
            if not len(x):
                continue
            planes = np.random.default_rng(seed).standard_normal((x.shape[1], bits))
            sign = (x @ planes >= 0).astype(np.uint8)
            packed = np.packbits(np.pad(sign, ((0, 0), (0, -bits % 64))), axis=1)
            words = packed.view(">u8").astype(np.uint64).view(np.int64)
            text = [base64.urlsafe_b64encode(p[: -(-bits // 8)].tobytes()).decode().rstrip("=")[: -(-bits // 6)] for p in packed]
            yield pd.DataFrame({id_col: pdf[id_col], "words": list(words), "fingerprint": text})

    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("fingerprint", T.StringType())])
    return rows.where(F.col(vec_col).isNotNull()).select(id_col, vec_col).mapInPandas(run, schema)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming_join(prints: DataFrame, id_col: str, most: int, bits: int = 516) -> DataFrame:
    """All pairs (left_id, right_id, distance) at Hamming distance ``most`` or less, for ``most`` below the
    number of whole 16-bit pieces, of which one must then agree.  Only ids meet by pieces; a pair's words
    are fetched once.  Beyond that use ``hamming_search``."""
    whole = bits // 64  # the last word is padded with zeros, which always agree
    if most >= 4 * whole:
        raise ValueError(f"pieces find all pairs only below {4 * whole} bits; ask hamming_search")
    pieces = F.flatten(F.transform(F.slice("words", 1, whole), lambda w: F.array(*[F.shiftrightunsigned(w, 16 * i).bitwiseAND(F.lit(65535)) for i in range(4)])))
    keyed = prints.select(F.col(id_col), F.posexplode(pieces).alias("place", "piece"))
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.place") == F.col("b.place")) & (F.col("a.piece") == F.col("b.piece")) & (F.col(f"a.{id_col}") < F.col(f"b.{id_col}")))
    pairs = met.select(F.col(f"a.{id_col}").alias("left_id"), F.col(f"b.{id_col}").alias("right_id")).distinct()
    words = lambda side: prints.select(F.col(id_col).alias(f"{side}_id"), F.col("words").alias(f"_{side}"))
    near = pairs.join(words("left"), "left_id").join(words("right"), "right_id")
    return near.select("left_id", "right_id", hamming(F.col("_left"), F.col("_right")).alias("distance")).where(F.col("distance") <= most)


def hamming_search(queries: DataFrame, prints: DataFrame, id_col: str, most: int, bits: int = 516) -> DataFrame:
    """(query_id, id, distance): all fingerprints within ``most`` bits of each query's, the query itself
    left out, at any distance: queries against all rows in blocks, as products of signs."""

    def near(q, x, agree):
        distance = np.rint((bits - agree) / 2).astype(np.int64)
        i, j = np.nonzero((distance <= most) & (q["query_id"].to_numpy()[:, None] != x["vec_id"].to_numpy()))
        return {"query_id": q["query_id"].to_numpy()[i], id_col: x["vec_id"].to_numpy()[j], "distance": distance[i, j]}

    bit = lambda i: F.call_function("shiftrightunsigned", F.element_at("words", F.floor(i / 64).cast("int") + 1), (63 - i % 64).cast("int")).bitwiseAND(F.lit(1))
    signs = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: (2 * bit(i) - 1).cast("float"))
    asked = queries.select(F.col(id_col).alias("query_id"), signs.alias("qv"))
    return in_blocks(asked, prints.select(F.col(id_col).alias("vec_id"), signs.alias("embedding")), f"query_id long, {id_col} long, distance long", near)
