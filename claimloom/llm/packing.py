"""Best-fit packing by exact-complement hashing.

Texts become token pieces of at most ``limit`` tokens; how many pieces have each length is all
that a packing plan needs, so the plan is made on the driver from at most ``limit`` counts,
whatever the size of the corpus:

1. single, pair and triple sums of available lengths are indexed; a length takes partners that
   fill its gap exactly, as many times as the counts allow;
2. what is left goes best-fit decreasing, still by counts.

A plan line says "the pieces of length l with ranks lo to hi go to sequences s, s+1, ... at
offset o".  Every piece finds its line by its length and its rank among pieces of that length;
ranks come from counts by task and length, so no length is gathered anywhere.

Edges: a null text is empty and gives the end token alone; repeated rows are packed each on its
own; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm import _common as C

LIMIT = 1024
END_ID = 2


# ---------------------------------------------------------------- tokens


class WordTokens:
    """Byte-level BPE ids of many texts at once.

    The merges of this kind of tokenizer never cross its pre-tokens, so a text's ids are those of
    its pre-tokens in turn.  Pre-token borders are found for all texts together with NumPy (the
    class of a code point is asked of the tokenizer's own pre-tokenizer when first met); each
    distinct pre-token is encoded by the tokenizer's model once and kept in a direct-mapped table.
    Added tokens (such as an end mark) that a text spells out get their own id, as the tokenizer does.
    """

    SLOTS = 1 << 19
    POOL = 1 << 21

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        # strings that the tokenizer takes out of a text before anything else, the longest first
        self.added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut_at = re.compile("|".join(map(re.escape, longest))) if longest else None
        self.cls = np.full(0x110000, 255, np.uint8)
        self.codes = C.mix64(np.arange(0x110000, dtype=np.uint64), 5) | np.uint64(1)

        # the byte alphabet of such tokenizers: visible Latin-1 stands for itself, the rest from 256 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(visible)))}
        self._reset()

    def word_ids(self, word: str) -> list[int]:
        """Ids of one pre-token, from the tokenizer's own model."""
        if word in self.added:
            return [self.added[word]]
        return [x.id for x in self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))]

    def _reset(self):
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.at = np.zeros(self.SLOTS, np.int64)
        self.len = np.zeros(self.SLOTS, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _classify(self, cps: np.ndarray):
        pre = self.tok.pre_tokenizer
        for c in cps.tolist():
            ch = chr(c)
            self.cls[c] = next((k for k, lead in ((1, "a"), (2, "1"), (0, "!")) if len(pre.pre_tokenize_str(lead + ch)) == 1), 3)

    def borders(self, cp: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Start of every pre-token.  Kinds: 1 letters, 2 numbers, 0 others, 3 white space."""
        kind = self.cls[cp]
        if (kind == 255).any():
            self._classify(np.unique(cp[kind == 255]))
            kind = self.cls[cp]
        n = len(cp)
        first = np.zeros(n + 1, bool)
        first[offs] = True
        st = np.zeros(n + 1, bool)
        st[1:n] = kind[1:] != kind[:-1]
        st |= first
        # the last white space before a word stands alone, or leads the word if it is a blank
        white = kind == 3
        q = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n])
        st[q] = True
        blank = q[cp[q] == 0x20]
        st[blank + 1] = False
        # 's 't 'm 'd 're 've 'll after a lone apostrophe that no blank leads
        i = np.flatnonzero(cp[:-1] == 0x27)
        i = i[st[i] & (kind[i + 1] == 1) & ~first[i + 1]] if len(i) else i
        if len(i):
            c1 = cp[i + 1]
            c2 = np.where((i + 2 < n) & ~first[np.minimum(i + 2, n)], cp[np.minimum(i + 2, n - 1)], 0)
            one = np.isin(c1, [ord(x) for x in "stmd"])
            two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
            for hit, width in ((one, 1), (two & ~one, 2)):
                st[i[hit] + 1] = False
                st[i[hit] + 1 + width] = True
        return np.flatnonzero(st[:n])

    def added_places(self, text: str, co: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of added tokens; none spans two texts."""
        found, at = [], 0
        while self.cut_at and (m := self.cut_at.search(text, at)):
            a, b = m.span()
            inside = np.searchsorted(co, a, side="right") == np.searchsorted(co, b, side="left")
            if inside:
                found.append((a, b))
            at = b if inside else a + 1
        both = np.array(found, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and their offsets in it."""
        text = data.tobytes().decode("utf-8")
        cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        if len(cp) == len(data):
            co = offs
        else:
            lead = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
            co = lead[offs]
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        a, b = self.added_places(text, co)
        if len(a):  # each stands alone, and what is between is split like a text of its own
            start = self.borders(cp, np.unique(np.concatenate([co, a, b])))
            last = np.searchsorted(a, start, side="right") - 1
            start = start[(last < 0) | (start >= b[last]) | (start == a[last])]
        else:
            start = self.borders(cp, co)
        end = np.append(start[1:], len(cp))
        from claimloom.llm.textkernel import _powers

        up, down = _powers(len(cp))
        sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(self.codes[cp] * up[: len(cp)], out=sums[1:])
        h = C.mix64(((sums[end] - sums[start]) * down[start]) ^ (end - start).astype(np.uint64)) | np.uint64(1)
        if self.used > self.POOL:
            self._reset()
        slot = (h >> np.uint64(45)).astype(np.int64)
        at, ln = self.at[slot], self.len[slot]
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            u, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            word = miss[where]
            s, e = start[word].tolist(), end[word].tolist()
            ids = [self.word_ids(text[a:b]) for a, b in zip(s, e)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for y in ids for x in y), np.uint32, int(sizes.sum()))
            places = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            need = self.used + len(flat)
            if need > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(need, 2 * len(self.pool)) - self.used, np.uint32)])
            self.pool[self.used : need] = flat
            self.used = need
            us = (u >> np.uint64(45)).astype(np.int64)
            self.keys[us], self.at[us], self.len[us] = u, places, sizes
            at[miss], ln[miss] = places[back], sizes[back]
        tops = np.zeros(len(ln) + 1, np.int64)
        np.cumsum(ln, out=tops[1:])
        ids = self.pool[np.repeat(at - tops[:-1], ln) + np.arange(tops[-1])]
        return ids, tops[np.searchsorted(start, co)]


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, pid, at): ``at`` counts pieces of one length
    within the task ``pid`` that made them."""
    path = tokenizer

    def cut(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        tok = word_tokens(path or default_tokenizer())
        seen = np.zeros(limit + 1, np.int64)
        for batch in batches:
            data, offs = C.col_bytes(batch.column(1))
            for lo, hi in C.byte_slices(offs, 2 << 20):
                ids, tops = tok.encode(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                ids = np.insert(ids, tops[1:], np.uint32(end_id)).astype("<u4")
                tops = tops + np.arange(len(tops))
                size = np.diff(tops)
                n = -(-size // limit)
                doc = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = size - limit * (n - 1)
                begin = np.where(piece == 0, 0, head[doc] + limit * (piece - 1))
                length = np.where(piece == 0, head[doc], limit)
                raw = memoryview(ids.tobytes())
                a = (tops[doc] + begin) * 4
                crc = [zlib.crc32(raw[x : x + 4 * y]) for x, y in zip(a.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                sl = length[order]
                run = np.searchsorted(sl, sl)
                at = np.empty(len(order), np.int64)
                at[order] = np.arange(len(sl)) - run + seen[sl]
                seen += np.bincount(length, minlength=limit + 1)
                yield C.record(
                    [
                        (id_col, batch.column(0).take(pa.array(doc + lo))),
                        ("piece", pa.array(piece.astype(np.int32))),
                        ("start", pa.array(begin)),
                        ("length", pa.array(length)),
                        ("ids_crc32", pa.array(np.array(crc, np.int64))),
                        ("pid", pa.array(np.full(len(doc), pid, np.int64))),
                        ("at", pa.array(at)),
                    ]
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(C.lean(cut), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, pid long, at long")


# ---------------------------------------------------------------- plan


def packing_plan(counts: np.ndarray, limit: int = LIMIT):
    """``counts[l]`` pieces of each length l from 1 to ``limit``.  Returns lines (length, lo, hi,
    sequence, offset) as five arrays sorted by length and lo, and the number of sequences."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    patterns: list[tuple[tuple[int, ...], int]] = []

    def take(parts: tuple[int, ...]) -> int:
        kinds, times = np.unique(parts, return_counts=True)
        n = int((left[kinds] // times).min())
        if n:
            left[kinds] -= n * times
            patterns.append((parts, n))
        return n

    def pairs(total: int, top: int) -> np.ndarray:
        """Available a >= b with a + b == total, a <= top; largest a first."""
        a = np.arange(min(top, total - 1), (total + 1) // 2 - 1, -1)
        if not len(a):
            return a
        return a[(left[a] > 0) & (left[total - a] > 0)]

    for x in range(limit, 0, -1):
        if not left[x]:
            continue
        gap = limit - x
        if not gap:
            take((x,))
            continue
        if left[gap]:
            take((x, gap))
        for a in pairs(gap, x).tolist():
            if not left[x]:
                break
            if left[a] and left[gap - a]:
                take((x, a, gap - a))
        if left[x]:
            for a in range(min(x, gap - 2), 0, -1):
                if not left[x]:
                    break
                if not left[a]:
                    continue
                for b in pairs(gap - a, a).tolist():
                    if not left[x] or not left[a]:
                        break
                    if left[b] and left[gap - a - b]:
                        take((x, a, b, gap - a - b))
    # best fit, longest first, over groups of equal bins
    bins: dict[int, list[list]] = {}  # room -> [parts, how many]
    for x in range(limit, 0, -1):
        c = int(left[x])
        while c:
            room = next((r for r in range(x, limit) if bins.get(r)), None)
            if room is None:
                k = limit // x
                if c >= k:
                    bins.setdefault(limit - k * x, []).append([(x,) * k, c // k])
                    c %= k
                elif c:
                    bins.setdefault(limit - c * x, []).append([(x,) * c, 1])
                    c = 0
                continue
            parts, n = bins[room].pop()
            used = min(n, c)
            if n > used:
                bins[room].append([parts, n - used])
            bins.setdefault(room - x, []).append([(*parts, x), used])
            c -= used
        left[x] = 0
    patterns += [(parts, n) for groups in bins.values() for parts, n in groups]
    lines, sequence, next_rank = [], 0, np.zeros(limit + 1, np.int64)
    for parts, n in patterns:
        offset = 0
        for x in parts:
            lines.append((x, next_rank[x], next_rank[x] + n, sequence, offset))
            next_rank[x] += n
            offset += x
        sequence += n
    table = np.array(sorted(lines), np.int64).reshape(-1, 5)
    return table, sequence


def pack(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = C.written(token_pieces(docs, tokenizer, limit, end_id, id_col, text_col), "pieces")
    by_task = pieces.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(limit + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``limit`` rows
        counts[row["length"]] = row["n"]
    table, _ = packing_plan(counts, limit)
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(offsets, ["pid", "length"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("at") + F.col("earlier")).alias("rank"))
    shift = np.int64(1 << 50)

    def place(batches):
        key = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            length, rank = C.long_col(batch, "length"), C.long_col(batch, "rank")
            line = np.searchsorted(key, length * shift + rank, side="right") - 1
            sequence = table[line, 3] + rank - table[line, 1] if len(line) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(table[line, 4])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = dict(docs.dtypes)[id_col]
    return ranked.mapInArrow(C.lean(place), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.read_table(spark, sf_dir, "documents"))
