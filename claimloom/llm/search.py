"""Exact BM25 top-k search: an inverted index in shards, block-max WAND, and an exact merge.

Terms are runs of ASCII letters, digits and other characters, A-Z folded.

``build_index`` splits each text once: a shard (a slice of whole documents, in the order of their ids)
holds the posting lists of all its terms with term frequencies, and the lengths of its documents.  The
index is a table; it knows nothing of any query and serves as many searches as one likes.

A search reads the global statistics (number of documents, mean length, document frequency of each
query term) from the index, and then each shard by itself.  A query keeps one cursor for each of its
terms.  Cursors stand in the order of their documents; the pivot is the first document at which the
terms' largest impacts together reach the least score that still counts.  If the largest impacts of
the block in which the pivot stands do not reach it, the cursors leap beyond; else the documents from the
pivot to the end of its block are scored in one go.  What still counts is the k-th best score that the
task has seen for the query; the block with the largest bound of a shard is scored first, so that it is
high early.  Nothing that could be among the best k is ever left out.

The shards' lists are merged by rank over (score, id).  Scores are rounded to 6 places before ranking,
so that equal scores tie alike everywhere; ties go to the smaller id, a null id first.

Edges: a null or blank text counts as a document of length 0; a query without terms, or without a
document that has one of them, gives no rows; repeated documents rank each; repeated terms of a
query count repeatedly; queries go through in blocks of ``QUERIES``, which bounds what the driver holds;
further columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm import _common as C
from claimloom.llm import textkernel as K

TOP_K = 10
K1, B = 1.5, 0.75
BLOCK = 64
SLICE = 4 << 20
QUERIES = 5000


def term_hashes(data: np.ndarray, offs: np.ndarray):
    h, _, _, first = K.words(data, offs, between=K.PUNCTUATED)
    return h, first


def _in_vocabulary(vocabulary: np.ndarray, h: np.ndarray):
    at = np.searchsorted(vocabulary, h)
    at[at == len(vocabulary)] = 0
    hit = np.flatnonzero(vocabulary[at] == h) if len(vocabulary) else np.zeros(0, np.int64)
    return at[hit], hit


# ---------------------------------------------------------------- index


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each shard: ids, sizes (terms of each document), terms (distinct hashes in order),
    starts (of their lists), places and times (documents of a list, and how often each has the term)."""
    kind = docs.schema[id_col].dataType
    binary = [T.StructField(n, T.BinaryType()) for n in ("sizes", "terms", "starts", "places", "times")]
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), *binary])

    def run(batches):
        for batch in batches:
            data, offs = C.col_bytes(batch.column(1))
            for lo, hi in C.byte_slices(offs, SLICE):
                n = hi - lo
                ids = batch.column(0).slice(lo, n)
                order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy().astype(np.int64)
                place = np.empty(n, np.int64)
                place[order] = np.arange(n)
                h, first = term_hashes(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                doc = np.repeat(place, np.diff(first))
                by = np.lexsort((doc, h))
                h, doc = h[by], doc[by]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(h))).astype("<u4")
                h, doc = h[new], doc[new].astype("<u4")
                starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                cells = [np.diff(first)[order].astype("<u4"), h[starts], np.append(starts, len(h)).astype("<u4"), doc, times]
                lists = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids.take(pa.array(order)))
                yield C.record([("ids", lists), *((f.name, pa.array([x.tobytes()], pa.binary())) for f, x in zip(binary, cells))])

    return C.written(docs.select(id_col, text_col).mapInArrow(C.lean(run), schema), "index")


def statistics(index: DataFrame, vocabulary: np.ndarray):
    """(documents, terms in all, document frequency of each vocabulary term) of an index."""

    def run(batches):
        n, total, df = 0, 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for size, terms, starts in zip(*(batch.column(c) for c in ("sizes", "terms", "starts"))):
                size, terms, starts = np.frombuffer(size.as_buffer(), "<u4"), np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(starts.as_buffer(), "<u4")
                n += len(size)
                total += int(size.sum(dtype=np.int64))
                at, hit = _in_vocabulary(terms, vocabulary)
                df[hit] += np.diff(starts.astype(np.int64))[at]
        some = np.flatnonzero(df)
        yield C.record([("term", pa.array(np.concatenate([[-2, -1], some]))), ("n", pa.array(np.concatenate([[n, total], df[some]])))])

    n, total, df = 0, 0, np.zeros(len(vocabulary), np.int64)
    counts = index.select("sizes", "terms", "starts").mapInArrow(C.lean(run), "term long, n long")
    for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of a block of queries
        if r["term"] == -2:
            n = r["n"]
        elif r["term"] == -1:
            total = r["n"]
        else:
            df[r["term"]] = r["n"]
    return n, total, df


# ---------------------------------------------------------------- search


class Shard:
    """Posting lists of a shard's asked terms under the global statistics, with the largest score of each
    term in each block of ``BLOCK`` documents."""

    def __init__(self, first: np.ndarray, docs: np.ndarray, scores: np.ndarray, n_docs: int):
        """``first``: where each term's list begins in ``docs`` and ``scores``, and the end of the last."""
        self.first, self.docs, self.scores, self.n = first, docs, scores, n_docs
        self.blocks = -(-n_docs // BLOCK)
        term = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.keys = term * (n_docs + 1) + docs  # in order, so one search serves many cursors
        cell = term * self.blocks + docs // BLOCK
        new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        tops = np.zeros((len(first) - 1) * self.blocks)
        if len(new):
            tops[cell[new]] = np.maximum.reduceat(scores, new)
        self.block_tops = tops.reshape(-1, self.blocks)
        self.tops = self.block_tops.max(1, initial=0.0)


class Best:
    """The k best scores of a query so far; ``least`` is what a document must reach to count."""

    def __init__(self, k: int):
        self.k, self.top, self.least = k, np.zeros(0), -np.inf

    def add(self, scores: np.ndarray) -> None:
        self.top = np.sort(np.concatenate([self.top, scores]))[-self.k :]
        if len(self.top) == self.k:
            self.least = self.top[0] - 1e-5  # rounding must not lose a tie


def wand(shard: Shard, terms: np.ndarray, weights: np.ndarray, best: Best) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that reach ``best.least``, and their scores, by block-max WAND."""
    none = np.zeros(0, np.int64), np.zeros(0)
    block_tops = shard.block_tops[terms] * weights[:, None]
    bound = block_tops.sum(0)
    if not len(bound) or bound.max() < best.least:
        return none
    tops, base, ends = shard.tops[terms] * weights, terms * (shard.n + 1), shard.first[terms + 1]

    def scored(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from lo to hi that have a term, and their scores."""
        a, e = np.searchsorted(shard.keys, base + lo), np.searchsorted(shard.keys, base + hi)
        size = e - a
        at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        doc = shard.docs[at] - lo
        out = np.bincount(doc, weights=np.repeat(weights, size) * shard.scores[at], minlength=hi - lo)
        which = np.flatnonzero(np.bincount(doc, minlength=hi - lo))
        return which + lo, np.round(out[which], 6)

    seen = int(bound.argmax())
    lo, hi = seen * BLOCK, min(shard.n, (seen + 1) * BLOCK)
    found, scores = scored(lo, hi)
    best.add(scores)
    out_d, out_s = [found], [scores]
    at = shard.first[terms].copy()
    now = shard.docs[at]

    def leap(which: np.ndarray, to: int) -> None:
        """Cursors go to their first documents from ``to`` on."""
        at[which] = np.searchsorted(shard.keys, base[which] + to)
        live = at[which] < ends[which]
        now[which] = np.where(live, shard.docs[np.minimum(at[which], len(shard.docs) - 1)], shard.n)

    while True:
        order = np.argsort(now, kind="stable")
        standing = now[order]
        reach = np.cumsum(np.where(standing < shard.n, tops[order], 0.0))
        p = int(np.searchsorted(reach, best.least))
        if p >= len(order) or standing[p] >= shard.n:
            break
        pivot = int(standing[p])
        block = pivot // BLOCK
        if block == seen or bound[block] < best.least:
            # no document of this block can count any more: on to the next block where one can
            open_ = np.flatnonzero(bound[block + 1 :] >= best.least) + block + 1
            open_ = open_[open_ != seen]
            if not len(open_):
                break
            to = int(open_[0]) * BLOCK
            leap(order[standing < to], to)
            continue
        ahead = order[: int(np.searchsorted(standing, pivot, side="right"))]
        if block_tops[ahead, block].sum() < best.least:
            rest = int(standing[len(ahead)]) if len(ahead) < len(order) else shard.n
            leap(ahead, max(pivot + 1, min((block + 1) * BLOCK, rest)))
        else:  # from the pivot to the end of its block in one go
            end = min(shard.n, (block + 1) * BLOCK)
            found, scores = scored(pivot, end)
            some = scores >= best.least
            if some.any():
                out_d.append(found[some])
                out_s.append(scores[some])
                best.add(scores[some])
            leap(order[standing < end], end)
    found, scores = np.concatenate(out_d), np.concatenate(out_s)
    keep = np.lexsort((found, -scores))[: best.k]
    keep = keep[scores[keep] >= best.least]
    return found[keep], scores[keep]


def search_index(index: DataFrame, queries: list[tuple], k: int = TOP_K, k1: float = K1, b: float = B) -> DataFrame:
    """Rows query_id, doc_id, score of a bounded list of queries (id, text): each shard's best."""
    data, offs = C.col_bytes(pa.array([t for _, t in queries], pa.string()))
    h, first = term_hashes(data, offs)
    vocabulary = np.unique(h)
    wanted = []
    for q in range(len(queries)):
        terms, times = np.unique(np.searchsorted(vocabulary, h[first[q] : first[q + 1]]), return_counts=True)
        wanted.append((terms, times.astype(float)))
    names = pa.array([i for i, _ in queries], pa.int64())
    n, total, df = statistics(index, vocabulary)
    mean = total / n if total else 1.0
    idf = np.log((n - df + 0.5) / (df + 0.5) + 1)

    def run(batches):
        best = [Best(k) for _ in wanted]
        for batch in batches:
            for row in range(batch.num_rows):
                sizes, terms, starts, places, times = (np.frombuffer(batch.column(c)[row].as_buffer(), np.uint64 if c == "terms" else "<u4") for c in ("sizes", "terms", "starts", "places", "times"))
                at, hit = _in_vocabulary(terms, vocabulary)
                if not len(hit):
                    continue
                # posting lists of the asked terms that the shard has, one after the other
                own = np.full(len(vocabulary), -1)
                own[hit] = np.arange(len(hit))
                size = np.diff(starts.astype(np.int64))[at]
                lists = np.concatenate([[0], np.cumsum(size)])
                take = np.repeat(starts[at].astype(np.int64) - lists[:-1], size) + np.arange(lists[-1])
                doc, tf = places[take].astype(np.int64), times[take].astype(float)
                shard = Shard(lists, doc, np.repeat(idf[hit], size) * (tf * (k1 + 1)) / (tf + (k1 * (1 - b + b * sizes / mean))[doc]), len(sizes))
                rows = []
                for q, (ask, count) in enumerate(wanted):
                    terms = own[ask]
                    have = terms >= 0
                    if have.any():
                        found, score = wand(shard, terms[have], count[have], best[q])
                        rows.append((np.full(len(found), q), found, score))
                if rows:
                    q, found, score = (np.concatenate(x) for x in zip(*rows))
                    ids = batch.column("ids")[row].values.take(pa.array(found))
                    yield C.record([("query_id", names.take(pa.array(q))), ("doc_id", ids), ("score", pa.array(score))])

    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())])
    return index.mapInArrow(C.lean(run), schema)


def top_k(docs: DataFrame, queries: DataFrame, k: int = TOP_K, k1: float = K1, b: float = B, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """Columns query_id, rank (from 1), doc_id, score; ``index`` saves building one."""
    index = index if index is not None else build_index(docs, id_col, text_col)
    asked = queries.select(F.col(query_col).cast("long"), query_text).where(F.col(query_col).isNotNull())
    found = None
    for block in itertools.batched(((r[0], r[1]) for r in asked.toLocalIterator()), QUERIES):
        part = search_index(index, list(block), k, k1, b)
        found = part if found is None else C.written(found, "hits").unionByName(C.written(part, "hits"))
    if found is None:
        found = index.select(F.lit(None).cast("long").alias("query_id"), F.get("ids", F.lit(0)).alias("doc_id"), F.lit(0.0).alias("score")).where("false")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def op7_bm25_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(C.read_table(spark, sf_dir, "documents"), C.read_table(spark, sf_dir, "benchmark"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_TERMS}, []) AS terms FROM documents),
l AS (SELECT count(*) AS n, sum(len(terms)) / CAST(count(*) AS DOUBLE) AS mean FROM d),
q AS (SELECT item_id, term, CAST(count(*) AS DOUBLE) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, size, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, len(terms) AS size, unnest(terms) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT q.item_id AS query_id, p.doc_id, round(sum(q.times * ln((l.n - f.df + 0.5) / (f.df + 0.5) + 1) * (p.tf * 2.5) / (p.tf + 1.5 * (0.25 + 0.75 * p.size / l.mean))), 6) AS score
      FROM q JOIN p USING (term) JOIN f USING (term), l GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= {TOP_K}
"""
