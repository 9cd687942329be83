"""Suffix-array deduplication of repeated byte strings.

Every byte covered by an n-byte string that also starts earlier (smaller id, or same document and
earlier start) is removed; strings are judged on the input.

The suffix array is built by the difference-cover method (sort sampled triples, name them,
recurse on names, merge the remaining suffixes, compare adjacent prefixes), distributed like this:

1. *Anchors.*  Every n-byte window has an anchor, the place of its least c-byte hash.  The rule
   looks at nothing but the window's own bytes, so equal windows have equal anchors: windows need
   be compared only with those of the same anchor hash.  Consecutive windows of one anchor make a
   segment.  An anchor hash that occurs once ends there, so unique text is never sorted.
2. Segments of one anchor hash whose own 64-bit hashes are equal as well are collapsed to the
   earliest; the windows of the others all start earlier there.
3. The remaining, different segments of an anchor hash are the text to be sorted.  They go to the
   partition of their hash, where the difference-cover suffix array of whole groups is built and
   adjacent suffixes are compared over n bytes; in each run of equal windows all but the earliest
   are covered.
4. A hash with very many different segments is salted over several partitions; the windows that
   survive there meet by their digest in an aggregate, so no hash gathers in one task.

Covered windows return to their documents in blobs by document bucket.  Rows move as packed
blobs, so the JVM handles few of them.

Edges: a null text is empty; texts shorter than n lose nothing; rows that repeat an id and its text
hold the same document, so neither starts earlier; an id that repeats with another text makes
documents in the order of a hash of the texts; each row with a null id is a document of its own,
after all others; an empty table gives no rows; all columns travel in ``row``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm import _common as C
from claimloom.llm import textkernel as K

N_BYTES = 100
CONTEXT = 32
CHUNK = 1 << 19
SEND_ROWS = 1 << 18
SORT_BYTES = 1 << 19
SALT_SEGMENTS = 20_000

ANCHOR = np.dtype([("h", "<u8"), ("nh", "<u8"), ("doc", "<i8"), ("lo", "<i4"), ("n", "<u2")])
RANGE = np.dtype([("doc", "<i8"), ("lo", "<i4"), ("n", "<i4")])
WANT = np.dtype([("doc", "<i8"), ("h", "<u8"), ("lo", "<i4"), ("n", "<u2"), ("salts", "<u2")])
SEGMENT = np.dtype([("h", "<u8"), ("doc", "<i8"), ("lo", "<i4"), ("n", "<u2"), ("salts", "<u2")])


# ---------------------------------------------------------------- suffix array


def _pack(a: np.ndarray, b: np.ndarray, top_b: int) -> np.ndarray:
    """One integer for each pair, in the order of pairs."""
    if int(a.max(initial=0)) >= (1 << 62) // (top_b + 1):
        a = np.unique(a, return_inverse=True)[1]
    return a.astype(np.int64) * (top_b + 1) + b


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` (integers from 1) in order, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    top = int(s.max())
    p = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    # sort and name the sampled triples
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    triple = _pack(_pack(p[sample], p[sample + 1], top), p[sample + 2], top)
    order = np.argsort(triple, kind="stable")
    fresh = np.ones(len(order), np.int64)
    fresh[1:] = triple[order[1:]] != triple[order[:-1]]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(fresh)
    if int(fresh.sum()) < len(order):  # equal names: recurse on them
        order = suffix_array(names)
        names[order] = np.arange(1, len(order) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    sampled = sample[order]
    sampled = sampled[sampled < n]
    # merge the remaining suffixes: each counts the sampled ones before it
    most = len(sample) + 1
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(_pack(p[zero], rank[zero + 1], most), kind="stable")]
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    both = np.concatenate([first, zero])
    key = _pack(p[both], rank[both + 1], most)
    before = np.searchsorted(key[: len(first)], key[len(first) :])
    both = np.concatenate([second, zero])
    key = _pack(_pack(p[both], p[both + 1], top), rank[both + 2], most)
    before += np.searchsorted(key[: len(second)], key[len(second) :])
    out = np.full(n, -1, np.int64)
    out[np.arange(len(zero)) + before] = zero
    out[out < 0] = sampled
    return out


def equal_runs(data: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """For suffixes in order: does each agree with the one before over n bytes?"""
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    same = np.zeros(len(order), bool)
    live = np.arange(1, len(order))
    steps = [*range(0, n - 7, 8)]
    if n >= 8 and n % 8:
        steps.append(n - 8)
    if n < 8:
        for j in range(n):
            live = live[raw[order[live] + j] == raw[order[live - 1] + j]]
        same[live] = True
        return same
    for j in steps:
        live = live[words[order[live] + j] == words[order[live - 1] + j]]
    same[live] = True
    return same


# ---------------------------------------------------------------- anchors


def anchors(data: np.ndarray, offs: np.ndarray, n: int, c: int):
    """Segments of all texts: (text, lo, windows, h, nh); lo counts from the text's start."""
    size = np.diff(offs)
    end_of = offs[1:]
    for begin in range(0, len(data), CHUNK):
        part = data[begin : begin + CHUNK + n - 1]
        m = len(part)
        if m < n:
            break
        up, down = K._powers(m)
        sums = np.zeros(m + 1, np.uint64)
        np.cumsum(K._codes(False)[part] * up[:m], out=sums[1:])
        gram = (sums[c:] - sums[:-c]) * down[: m - c + 1]
        gram *= np.uint64(0xD6E8FEB86659FD93)
        gram ^= gram >> np.uint64(32)
        gram *= np.uint64(0x9E3779B97F4A7C15)
        key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        w, step = n - c + 1, 1
        while 2 * step <= w:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if w > step:
            key = np.minimum(key[: len(key) - (w - step)], key[w - step :])
        place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the window's anchor
        starts = begin + np.arange(len(place))
        text = np.searchsorted(end_of, starts, side="right")
        ok = starts + n <= end_of[text]
        starts, text, place = starts[ok], text[ok], place[ok]
        if not len(starts):
            continue
        cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
        windows = np.diff(np.append(cut, len(starts)))
        lo = starts[cut] - begin
        hi = lo + windows - 1 + n
        p = place[cut]
        nh = C.mix64(((sums[hi] - sums[lo]) * down[lo]) ^ C.mix64(((p - lo) * 65536 + windows).astype(np.uint64)))
        yield text[cut], (starts[cut] - offs[text[cut]]).astype(np.int64), windows, C.mix64(gram[p]), nh


def _blobs(rows: np.ndarray, bucket: np.ndarray, keys: np.ndarray):
    """(key of the bucket, bytes) of the rows of each bucket."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(rows) else []
    return [(int(keys[bucket[a]]), rows[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]


def _doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    x = doc.astype(np.int64)
    return (x ^ (x >> 17) ^ (x >> 31)) % n


def _doc_bucket_col(doc: Column, keys: np.ndarray) -> Column:
    n = F.lit(len(keys))
    at = F.pmod(doc.bitwiseXOR(F.shiftright(doc, 17)).bitwiseXOR(F.shiftright(doc, 31)), n)
    return F.get(F.lit(keys.tolist()), at.cast("int")).cast("long")


MOVED = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("blob", T.BinaryType())])


def _moved(items) -> pa.RecordBatch:
    """items: (bucket, kind, bytes)."""
    b, k, x = zip(*items)
    return C.record([("bucket", pa.array(b, pa.int64())), ("kind", pa.array(k, pa.int32())), ("blob", pa.array(x, pa.binary()))])


def _send(items):
    """Batches of bounded size."""
    held, size = [], 0
    for x in items:
        held.append(x)
        size += len(x[2])
        if size > 16 << 20 or len(held) >= 4096:
            yield _moved(held)
            held, size = [], 0
    if held:
        yield _moved(held)


def _buckets(batches):
    """(bucket, [(kind, blob), ...]) from rows sorted by bucket and kind."""
    now, held = None, []
    for batch in batches:
        for b, k, x in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob")):
            if b != now:
                if held:
                    yield now, held
                now, held = b, []
            held.append((k, x.as_buffer()))
    if held:
        yield now, held


def _spans(lo: np.ndarray, windows: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs from ranges of covered windows."""
    order = np.argsort(lo, kind="stable")
    a, b = lo[order].astype(np.int64), np.minimum(lo[order].astype(np.int64) + windows[order] - 1 + n, size)
    keep = a < b
    a, b = a[keep], b[keep]
    if not len(a):
        return a, b
    reach = np.maximum.accumulate(b)
    new = np.concatenate([[True], a[1:] > reach[:-1]])
    starts = np.flatnonzero(new)
    return a[starts], reach[np.append(starts[1:], len(a)) - 1]


def _sort_groups(seg: np.ndarray, texts: list, n: int):
    """The difference-cover suffix array over whole groups.  ``seg``: SEGMENT rows, ``texts``:
    their bytes.  Yields (covered windows as RANGE rows, surviving windows of salted groups)."""
    order = np.argsort(seg["h"], kind="stable")
    sizes = np.array([len(x) for x in texts], np.int64)[order]
    h = seg["h"][order]
    ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
    begin = 0
    total = np.concatenate([[0], np.cumsum(sizes)])
    for i, e in enumerate(ends):
        if total[e] - total[begin] < SORT_BYTES and i + 1 < len(ends):
            continue
        take = order[begin:e]
        begin = int(e)
        rows = seg[take]
        size = np.array([len(texts[j]) for j in take], np.int64) + 1
        at = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"\0".join(bytes(texts[j]) for j in take) + b"\0", np.uint8)
        s = data.astype(np.int64) + 1 + len(rows)
        s[at[1:] - 1] = np.arange(1, len(rows) + 1)  # segments end in marks of their own
        of = np.repeat(np.arange(len(rows)), size)
        inner = np.arange(len(data)) - at[of]
        start = inner < rows["n"][of]
        sa = suffix_array(s)
        sa = sa[start[sa]]
        if not len(sa):
            continue
        same = equal_runs(data, sa, n)
        doc = np.unique(rows["doc"], return_inverse=True)[1]
        key = (doc[of[sa]] << 32) + rows["lo"][of[sa]] + inner[sa]
        cls = np.flatnonzero(~same)
        least = np.repeat(np.minimum.reduceat(key, cls), np.diff(np.append(cls, len(sa))))
        covered = np.zeros(len(data), bool)
        covered[sa[key > least]] = True
        run = np.flatnonzero(covered & ~np.concatenate([[False], covered[:-1]]))
        stop = np.flatnonzero(covered & ~np.concatenate([covered[1:], [False]]))
        out = np.zeros(len(run), RANGE)
        out["doc"], out["lo"], out["n"] = rows["doc"][of[run]], rows["lo"][of[run]] + inner[run], stop - run + 1
        left = None
        salted = rows["salts"][of[sa]] > 1
        alive = sa[(key == least) & salted]
        if len(alive):
            up, down = K._powers(len(data))
            digest = []
            for fold in (3, 4):
                sums = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(C.mix64(np.arange(256, dtype=np.uint64), fold)[data] * up[: len(data)], out=sums[1:])
                digest.append(C.mix64((sums[alive + n] - sums[alive]) * down[alive]).view(np.int64))
            left = (digest[0], digest[1], rows["doc"][of[alive]], rows["lo"][of[alive]].astype(np.int64) + inner[alive])
        yield out, left


# ---------------------------------------------------------------- operator


def cut_repeats(docs: DataFrame, n: int = N_BYTES, context: int = CONTEXT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns row (struct of the input's columns but the text), n_bytes, spans
    (array of struct(start, stop), the maximal removed runs), kept (binary)."""
    spark = docs.sparkSession
    parts = C.shuffle_parts(spark)
    keys = C.even_keys(spark, parts)  # one bucket for each partition, of hashes as of documents
    rest = [c for c in docs.columns if c != text_col]
    row = F.struct(*rest).cast(T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields if f.name != text_col]))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row.alias("row"))
    base = C.one_per_document(rows, "id", "text", "number").select(F.col("number").alias("id"), "text", "row")

    def send_anchors(held: list):
        if held:
            rows = np.concatenate(held)
            yield from _send((b, 0, x) for b, x in _blobs(rows, (rows["h"] % np.uint64(parts)).astype(np.int64), keys))

    def to_anchors(batches):
        for batch in batches:
            ids = C.long_col(batch, "id")
            data, offs = C.col_bytes(batch.column("text"))
            held, size = [], 0
            for text, lo, windows, h, nh in anchors(data, offs, n, context):
                rows = np.empty(len(h), ANCHOR)
                rows["h"], rows["nh"], rows["doc"], rows["lo"], rows["n"] = h, nh, ids[text], lo, windows
                held.append(rows)
                size += len(rows)
                if size > SEND_ROWS:
                    yield from send_anchors(held)
                    held, size = [], 0
            yield from send_anchors(held)

    def collapse(batches):
        for _, blobs in _buckets(batches):
            rows = np.concatenate([np.frombuffer(x, ANCHOR) for _, x in blobs])
            h = np.sort(rows["h"])
            twice = np.unique(h[1:][h[1:] == h[:-1]])
            if not len(twice):
                continue
            at = np.searchsorted(twice, rows["h"])
            at[at == len(twice)] = 0
            rows = rows[twice[at] == rows["h"]]
            rows = rows[np.lexsort((rows["lo"], rows["doc"], rows["nh"], rows["h"]))]
            new_h = np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]])
            new = new_h | np.concatenate([[True], rows["nh"][1:] != rows["nh"][:-1]])
            firsts = np.flatnonzero(new)
            rep = rows[np.repeat(firsts, np.diff(np.append(firsts, len(rows))))]
            later = (rows["doc"] != rep["doc"]) | (rows["lo"] != rep["lo"])
            group = np.cumsum(new_h) - 1
            kinds = np.bincount(group, weights=new)[group]
            gone = np.zeros(int(later.sum()), RANGE)
            for f in ("doc", "lo", "n"):
                gone[f] = rows[f][later]
            asked = new & (kinds > 1)
            want = np.zeros(int(asked.sum()), WANT)
            for f in ("doc", "h", "lo", "n"):
                want[f] = rows[f][asked]
            want["salts"] = np.minimum(1 + kinds[asked].astype(np.int64) // SALT_SEGMENTS, 65535)
            yield from _send((b, 0, x) for b, x in _blobs(gone, _doc_bucket(gone["doc"], parts), keys))
            yield from _send((b, 1, x) for b, x in _blobs(want, _doc_bucket(want["doc"], parts), keys))

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")

    # written before the texts are dealt out, so that the shuffle of anchors can go first
    found = C.written(by_bucket(base.select("id", "text").mapInArrow(C.lean(to_anchors), MOVED)).mapInArrow(C.lean(collapse), MOVED), "found", free=True)

    row_type = base.schema["row"].dataType
    empty = lambda kind: F.lit(None).cast(kind)
    both = T.StructType([*MOVED.fields, T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", row_type)])

    def meet(texts: DataFrame, moved: DataFrame) -> DataFrame:
        """Texts after the blobs of their bucket; an open text brings its own ranges as a blob."""
        rows = texts.select(_doc_bucket_col(F.col("id"), keys).alias("bucket"), F.lit(9).alias("kind"), "blob", "id", "text", "row")
        sent = moved.select("bucket", "kind", "blob", empty("long").alias("id"), empty("string").alias("text"), empty(row_type).alias("row"))
        return rows.to(both).unionByName(sent.to(both)).repartition(parts, "bucket").sortWithinPartitions("bucket", "kind", "id")

    result = T.StructType([T.StructField("row", row_type), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))), T.StructField("kept", T.BinaryType())])
    opened = T.StructType([*MOVED.fields, T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", row_type), *result.fields[1:]])

    def walk(batches):
        """(batch, rows of texts in it, gone, want): the blobs of the bucket come first."""
        now, gone, want = None, [], []
        for batch in batches:
            bucket, kind = C.long_col(batch, "bucket"), C.long_col(batch, "kind")
            edges = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | ((kind[1:] == 9) != (kind[:-1] == 9))])) if len(bucket) else []
            for a, b in zip(edges, [*edges[1:], len(bucket)]):
                if bucket[a] != now:
                    now, gone, want, ready = bucket[a], [], [], None
                if kind[a] != 9:
                    for i in range(a, b):
                        (gone if kind[i] == 0 else want).append(batch.column("blob")[i].as_buffer())
                    ready = None
                    continue
                if ready is None:
                    g = np.concatenate([np.frombuffer(x, RANGE) for x in gone]) if gone else np.zeros(0, RANGE)
                    w = np.concatenate([np.frombuffer(x, WANT) for x in want]) if want else np.zeros(0, WANT)
                    ready = g[np.argsort(g["doc"], kind="stable")], w[np.argsort(w["doc"], kind="stable")]
                yield batch.slice(a, b - a), *ready

    def finish(batch: pa.RecordBatch, lists: list, texts: tuple, which: np.ndarray):
        """Result columns of the rows ``which``; lists: (lo, windows) of each."""
        data, offs = texts
        starts, stops, count, kept = [], [], [0], []
        for i in which.tolist():
            size = int(offs[i + 1] - offs[i])
            a, b = _spans(*lists[i], n, size)
            starts.append(a)
            stops.append(b)
            count.append(count[-1] + len(a))
            text = data[offs[i] : offs[i + 1]]
            if len(a):
                mark = np.zeros(size + 1, np.int8)
                mark[a] += 1
                mark[b] -= 1
                text = text[np.cumsum(mark[:-1]) == 0]
            kept.append(text.tobytes())
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate(starts) if starts else np.zeros(0, np.int64)), pa.array(np.concatenate(stops) if stops else np.zeros(0, np.int64))], names=["start", "stop"])
        return [
            ("row", batch.column("row").take(pa.array(which))),
            ("n_bytes", pa.array((offs[1:] - offs[:-1])[which])),
            ("spans", pa.ListArray.from_arrays(pa.array(np.array(count, np.int32)), spans)),
            ("kept", pa.array(kept, pa.binary())),
        ]

    def ranges(batch: pa.RecordBatch, gone: np.ndarray, own: bool):
        ids = C.long_col(batch, "id")
        a, b = np.searchsorted(gone["doc"], ids, side="left"), np.searchsorted(gone["doc"], ids, side="right")
        out = []
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            lo, windows = gone["lo"][x:y], gone["n"][x:y]
            if own and (blob := batch.column("blob")[i]).is_valid:
                extra = np.frombuffer(blob.as_buffer(), RANGE)
                lo, windows = np.concatenate([lo, extra["lo"]]), np.concatenate([windows, extra["n"]])
            out.append((lo, windows))
        return out

    def pad(columns: list, size: int) -> pa.RecordBatch:
        have = dict(columns)
        return C.record([(f.name, have[f.name] if f.name in have else pa.nulls(size, pa_type(f.name))) for f in opened.fields])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {f.name: to_arrow_type(f.dataType) for f in opened.fields}

    def pa_type(name: str):
        return kinds[name]

    def open_texts(batches):
        """Texts that no open question touches are finished; the others go on with the ranges
        found so far, and their segments go to the partition of their hash."""
        for batch, gone, want in walk(batches):
            ids = C.long_col(batch, "id")
            texts = data, offs = C.col_bytes(batch.column("text"))
            lists = ranges(batch, gone, False)
            a, b = np.searchsorted(want["doc"], ids, side="left"), np.searchsorted(want["doc"], ids, side="right")
            done, wait = np.flatnonzero(a == b), np.flatnonzero(a != b)
            for lo in range(0, len(done), 2000):
                which = done[lo : lo + 2000]
                yield pad([("kind", pa.array(np.full(len(which), 0, np.int32))), *finish(batch, lists, texts, which)], len(which))
            if not len(wait):
                continue
            blobs = []
            for i in wait.tolist():
                x = np.zeros(len(lists[i][0]), RANGE)
                x["doc"], x["lo"], x["n"] = ids[i], *lists[i]
                blobs.append(x.tobytes())
            which = pa.array(wait)
            yield pad([("kind", pa.array(np.full(len(wait), 1, np.int32))), ("blob", pa.array(blobs, pa.binary())), *((c, batch.column(c).take(which)) for c in ("id", "text", "row"))], len(wait))
            seen = np.concatenate([[True], ids[wait][1:] != ids[wait][:-1]])  # a repeated id asks once
            rows, place = [], []
            for i in wait[seen].tolist():
                w = want[a[i] : b[i]]
                w = w[w["lo"].astype(np.int64) + w["n"] - 1 + n <= offs[i + 1] - offs[i]]
                rows.append(w)
                place.append(offs[i] + w["lo"].astype(np.int64))
            w, place = np.concatenate(rows), np.concatenate(place)
            seg = np.zeros(len(w), SEGMENT)
            for f in ("h", "doc", "lo", "n", "salts"):
                seg[f] = w[f]
            salt = C.mix64(w["doc"].view(np.uint64)) % np.maximum(w["salts"], 1).astype(np.uint64)
            bucket = ((w["h"] + salt * np.uint64(7919)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1], [True]])) if len(order) else np.zeros(1, int)
            out = []
            for x, y in zip(cuts[:-1], cuts[1:]):
                take = order[x:y]
                length = w["n"][take].astype(np.int64) - 1 + n
                index = np.repeat(place[take] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
                out.append((int(keys[bucket[take[0]]]), len(take).to_bytes(8, "little") + seg[take].tobytes() + data[index].tobytes()))
            for lo in range(0, len(out), 2000):
                some = out[lo : lo + 2000]
                yield pad([("kind", pa.array(np.full(len(some), 2, np.int32))), ("bucket", pa.array([x for x, _ in some], pa.int64())), ("blob", pa.array([x for _, x in some], pa.binary()))], len(some))

    stage = C.written(meet(base.withColumn("blob", empty("binary")), found).mapInArrow(C.lean(open_texts), opened), "opened", free=True)
    C.dropped(found)

    def send_ranges(held: list):
        if held:
            gone = np.concatenate(held)
            yield from _send((b, 0, x) for b, x in _blobs(gone, _doc_bucket(gone["doc"], parts), keys))

    def sort_segments(batches):
        for _, blobs in _buckets(batches):
            seg, texts = [], []
            for _, x in blobs:
                x = memoryview(x)
                m = int.from_bytes(x[:8], "little")
                rows = np.frombuffer(x[8 : 8 + m * SEGMENT.itemsize], SEGMENT)
                seg.append(rows)
                at = 8 + m * SEGMENT.itemsize + np.concatenate([[0], np.cumsum(rows["n"].astype(np.int64) - 1 + n)])
                texts += [x[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            held, size = [], 0
            for gone, left in _sort_groups(np.concatenate(seg), texts, n):
                held.append(gone)
                size += len(gone)
                if size > 1 << 20:
                    yield from send_ranges(held)
                    held, size = [], 0
                if left is not None:
                    rows = np.zeros(len(left[0]), LEFT)
                    for f, x in zip(("a", "b", "doc", "start"), left):
                        rows[f] = x
                    yield _moved([(-1, 5, rows.tobytes())])
            yield from send_ranges(held)

    sorted_out = C.written(by_bucket(stage.where("kind = 2").select("bucket", "kind", "blob")).mapInArrow(C.lean(sort_segments), MOVED), "sorted", free=True)
    sent = sorted_out.where("kind = 0")
    if sorted_out.where("kind = 5").limit(1).count():

        def unpack(batches):
            for batch in batches:
                for x in batch.column("blob"):
                    rows = np.frombuffer(x.as_buffer(), LEFT)
                    yield C.record([(f, pa.array(np.ascontiguousarray(rows[f]))) for f in LEFT.names])

        windows = sorted_out.where("kind = 5").select("blob").mapInArrow(C.lean(unpack), "a long, b long, doc long, start long")
        least = windows.groupBy("a", "b").agg(F.min(F.struct("doc", "start")).alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1")
        late = windows.join(least, ["a", "b"]).where(F.struct("doc", "start") > F.col("least")).select("doc", "start")

        def repack(batches):
            for batch in batches:
                gone = np.zeros(batch.num_rows, RANGE)
                gone["doc"], gone["lo"], gone["n"] = C.long_col(batch, "doc"), C.long_col(batch, "start"), 1
                yield from _send((b, 0, x) for b, x in _blobs(gone, _doc_bucket(gone["doc"], parts), keys))

        sent = sent.unionByName(late.mapInArrow(C.lean(repack), MOVED))

    def close_texts(batches):
        for batch, gone, _ in walk(batches):
            texts = C.col_bytes(batch.column("text"))
            lists = ranges(batch, gone, True)
            for lo in range(0, batch.num_rows, 2000):
                which = np.arange(lo, min(lo + 2000, batch.num_rows))
                yield C.record(finish(batch, lists, texts, which))

    late_texts = meet(stage.where("kind = 1").select("blob", "id", "text", "row"), sent).mapInArrow(C.lean(close_texts), result)
    return stage.where("kind = 0").select(*result.names).unionByName(late_texts)


LEFT = np.dtype([("a", "<i8"), ("b", "<i8"), ("doc", "<i8"), ("start", "<i8")])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(C.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 100)) AS i FROM d WHERE len(h) >= 200)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 100 THEN 0 ELSE 1 END AS fresh FROM r WHERE k > 1 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
c AS (SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM n GROUP BY ALL),
e AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY lo DESC) AS last FROM c),
k AS (SELECT e.doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (lo - before) AS BIGINT)), '' ORDER BY lo) || max(CASE WHEN last = 1 THEN substr(h, CAST(2 * hi + 1 AS BIGINT)) END) AS kept
      FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
