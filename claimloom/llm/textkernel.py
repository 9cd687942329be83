"""Vectorised word and shingle hashing over the bytes of many texts at once.

A word is a maximal run of bytes outside space and 0x09-0x0D; A-Z may be folded to a-z.  Both
rules act on single bytes that never occur inside a multi-byte UTF-8 character, so bytes and
characters give the same words.
"""

from __future__ import annotations

import functools

import numpy as np

from claimloom.llm._common import mix64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII but letters and digits, for words without their punctuation.
PUNCTUATED = np.zeros(256, bool)
PUNCTUATED[:128] = [not chr(c).isalnum() for c in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


@functools.cache
def _codes(fold: bool) -> np.ndarray:
    """A pseudo-random 64-bit value for each byte."""
    codes = mix64(np.arange(256, dtype=np.uint64), 77) | np.uint64(1)
    return codes[_LOWER] if fold else codes


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for places 0 to n."""
    have = _POWERS.get("up")
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 21)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, x in (("up", _BASE), ("down", inverse)):
            out = np.ones(size, np.uint64)
            done, factor = 1, x
            while done < size:
                step = min(done, size - done)
                out[done : done + step] = out[:step] * np.uint64(factor)
                factor = (factor * factor) & 0xFFFFFFFFFFFFFFFF
                done += step
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


def words(data: np.ndarray, offs: np.ndarray, fold: bool = True, between: np.ndarray = _SPACE):
    """Hashes of all words: (hash, start, end, first) where ``first[d]`` is the number of words
    before text ``d`` (so ``first`` has one entry more than there are texts).  ``between`` marks the
    bytes that stand between words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[0], edge[n] = inside[0], inside[-1]
    joint = offs[(offs > 0) & (offs < n)]
    joint = joint[inside[joint] & inside[joint - 1]]  # a word ends and another begins where texts meet
    marks = np.flatnonzero(edge)
    if len(joint):
        joint = np.unique(joint)
        marks = np.sort(np.concatenate([marks, joint, joint]))
    start, end = marks[0::2], marks[1::2]
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_codes(fold)[data] * up[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    h = mix64(h ^ (end - start).astype(np.uint64))
    return h, start, end, np.searchsorted(start, offs)


def prefixes(data: np.ndarray, start: np.ndarray, end: np.ndarray, sizes, fold: bool = True):
    """(k, hashes, which) of the k-byte prefixes of the words longer than k bytes."""
    if not len(data):
        return
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_codes(fold)[data] * up[: len(data)], out=sums[1:])
    for k in sizes:
        which = np.flatnonzero(end - start > k)
        s = start[which]
        yield k, mix64(((sums[s + k] - sums[s]) * down[s]) ^ np.uint64(1_000_003 * (k + 1))), which


def shingles(h: np.ndarray, first: np.ndarray, k: int):
    """Hashes of k-word shingles with the text of each; a text with 1 to k-1 words has its whole
    sequence as its one shingle, an empty text has none."""
    counts = np.diff(first)
    n = len(h)
    if n >= k:
        out = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            out = mix64(out + h[j : n - k + 1 + j], j)
        doc_of = np.repeat(np.arange(len(counts)), counts)
        whole = doc_of[: n - k + 1] == doc_of[k - 1 :]
        out, docs = out[whole], doc_of[: n - k + 1][whole]
    else:
        out, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            extra[has] = mix64(extra[has] + h[first[short[has]] + j], 100 + j)
        out, docs = np.concatenate([out, extra]), np.concatenate([docs, short])
        order = np.argsort(docs, kind="stable")
        out, docs = out[order], docs[order]
    return out, docs


def distinct(values: np.ndarray, docs: np.ndarray, n_docs: int):
    """Distinct values of each text, sorted within it: (values, first) with n_docs + 1 offsets."""
    bounds = np.searchsorted(docs, np.arange(n_docs + 1))
    parts, sizes = [], np.zeros(n_docs + 1, np.int64)
    for d in range(n_docs):
        lo, hi = bounds[d], bounds[d + 1]
        if hi > lo:
            x = np.sort(values[lo:hi])
            if hi - lo > 1:
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
            parts.append(x)
            sizes[d + 1] = len(x)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)
