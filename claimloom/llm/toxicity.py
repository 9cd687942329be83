"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w . x - theta_k) with one weight vector for all thresholds and ordered
thetas; the expected severity is the sum of these over k.  Features are hashed words (runs
without ASCII punctuation, A-Z folded) and their proper prefixes of 3 to 9 bytes, present or not.

The fit uses a bounded sample of labelled documents (``sample`` rows, those of least hash of the
id).  Near copies in the sample count once, else the chance words of a much copied text look like
evidence; a word enters when most texts with it are toxic, by a test corrected for the number of words
tried.  Scoring runs over every document's whole text.

The grades are those of the labels, and as many thresholds are fitted as they have grades above 0:
labels that tell only toxic from clean give one, and the expected severity is then the probability
of toxicity.

Edges: null and empty texts have no features and get the base rate; labels that are null are not
learned from; with one grade only, or no labels, severity is the base rate and nothing is
rejected at or below one half; repeated rows are scored each; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import _common as C
from claimloom.llm import textkernel as K

SAMPLE = 5000
PREFIXES = range(3, 10)
RIDGE = 0.01
SLICE = 1 << 20


def features(data: np.ndarray, offs: np.ndarray):
    """(hash, text) of every word and of the proper prefixes of 3 to 9 bytes of longer words, which
    stand for the stems of compounds and of inflected words."""
    h, start, end, first = K.words(data, offs, between=K.PUNCTUATED)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    all_h, all_d = [h], [doc]
    for k, part, which in K.prefixes(data, start, end, PREFIXES):
        all_h.append(part)
        all_d.append(doc[which])
    return np.concatenate(all_h), np.concatenate(all_d)


def word_sets(data: np.ndarray, offs: np.ndarray):
    h, doc = features(data, offs)
    order = np.argsort(doc, kind="stable")
    return K.distinct(h[order], doc[order], len(offs) - 1)


def one_of_each(sets: list[np.ndarray]) -> np.ndarray:
    """Marks the first of each group of sets that share a band of four minima."""
    keep = np.ones(len(sets), bool)
    seen: set[tuple[int, int]] = set()
    for i, x in enumerate(sets):
        if not len(x):
            continue
        minima = [int(C.mix64(x, 200 + j).min()) for j in range(40)]
        bands = [(b, hash(tuple(minima[4 * b : 4 * b + 4]))) for b in range(10)]
        keep[i] = not any(b in seen for b in bands)
        seen.update(bands)
    return keep


def _counts(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of all sets in order, and how many sets have each."""
    every = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.diff(np.append(first, len(every))).astype(np.int32)


def _evidence(a: np.ndarray, c: np.ndarray, p: float) -> np.ndarray:
    """Log-likelihood gain of the share a / c over the share p."""
    q = a / np.maximum(c, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.nan_to_num(q * np.log(q / p)) + np.nan_to_num((1 - q) * np.log((1 - q) / (1 - p)))
    return np.where((q >= 0.5) & (q > p), c * kl, 0.0)


def telling_words(sets: list[np.ndarray], high: np.ndarray, wrong: float = 0.01, rare: float = 0.005, shared: float = 0.1) -> np.ndarray:
    """Words that stand in texts of high grade more often than not, and more than by chance after
    Bonferroni's correction.  Texts that share passages are not independent: among the texts with a
    word, those that share a tenth of their rare words (in one of 200 texts at most) with one counted
    before do not count."""
    if not sets or high.all() or not high.any():
        return np.zeros(0, np.uint64)
    every, c = _counts(sets)
    a = np.zeros(len(every), np.int32)
    some, n = _counts([x for x, h in zip(sets, high) if h])
    a[np.searchsorted(every, some)] = n
    p, least = high.mean(), np.log(max(len(every), 1) / wrong)
    first = every[_evidence(a, c, p) > least]
    most = max(2, rare * len(sets))
    shared_rare = every[(c > 1) & (c <= most)]
    alone = every[c == 1] if most >= 1 else every[:0]
    del every, a, c

    def inside(x: np.ndarray, words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(words, x)
        at[at == len(words)] = 0
        return words[at] == x if len(words) else np.zeros(len(x), bool)

    has = [x[inside(x, first)] for x in sets]
    few: dict[int, tuple[set[int], int]] = {}  # rare words that others have too, and the number of all rare words
    seldom = set(first[inside(first, shared_rare) | inside(first, alone)].tolist())
    owners: dict[int, list[int]] = {int(w): [] for w in first}
    for d, words in enumerate(has):
        for w in words.tolist():
            owners[w].append(d)
    keep = []
    for w in first.tolist():
        counted: list[tuple[set[int], int]] = []
        a = 0
        for d in owners[w]:
            if d not in few:
                both = sets[d][inside(sets[d], shared_rare)]
                few[d] = set(both.tolist()), len(both) + int(inside(sets[d], alone).sum())
            mine, size = few[d]
            mine, size = (mine - {w}, size - 1) if w in seldom else (mine, size)
            if any(len(mine & x) >= max(2, shared * min(size, k)) for x, k in counted):
                continue
            counted.append((mine, size))
            a += int(high[d])
        keep.append(_evidence(np.array([a]), np.array([len(counted)]), p)[0] > least)
    return first[np.array(keep, bool)]


def fit_ordinal(x: np.ndarray, grade: np.ndarray, top: int, ridge: float = RIDGE, steps: int = 400):
    """Weights and ordered thetas of a cumulative-link model, by Newton steps on the penalised
    likelihood of its binary thresholds."""
    n, d = x.shape
    w = np.zeros(d)
    above = np.array([(grade >= k).mean() for k in range(1, top + 1)])
    theta = -np.log((above + 1e-3) / (1 - above + 1e-3))
    for _ in range(steps):
        z = (x @ w)[:, None] - theta[None, :]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        r = p - (grade[:, None] >= np.arange(1, top + 1)[None, :])
        v = p * (1 - p) + 1e-9
        gw, gt = x.T @ r.sum(1) + ridge * w, -r.sum(0) + ridge * 0.01 * theta
        hw = x.T @ (x * v.sum(1)[:, None]) + ridge * np.eye(d)
        ht = np.diag(v.sum(0) + ridge * 0.01)
        hwt = -x.T @ v
        step = np.linalg.solve(np.block([[hw, hwt], [hwt.T, ht]]) + 1e-9 * np.eye(d + top), np.concatenate([gw, gt]))
        size = np.abs(step).max()
        step *= min(1.0, 2.0 / max(size, 1e-12))
        w, theta = w - step[:d], np.sort(theta - step[d:])
        if size < 1e-8:
            break
    return w, theta


def fit(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"):
    """``grades``: columns id_col, grade (int from 0).  Returns (words, weights, thetas)."""
    model = _fit(docs, grades, sample, id_col, text_col)
    C.trim()
    return model


def _fit(docs: DataFrame, grades: DataFrame, sample: int, id_col: str, text_col: str):
    some = grades.where("grade IS NOT NULL").groupBy(id_col).agg(F.max("grade").alias("grade"))
    some = some.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample)  # a bounded table
    joined = docs.select(id_col, text_col).join(F.broadcast(some), id_col).select("grade", text_col)

    def run(batches):
        for batch in batches:
            data, offs = C.col_bytes(batch.column(1))
            for lo, hi in C.byte_slices(offs, SLICE):
                values, first = word_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                yield C.record([("grade", batch.column(0).slice(lo, hi - lo).cast(pa.int32())), ("words", C.binary_rows(values, first))])

    rows = joined.mapInArrow(C.lean(run), "grade int, words binary").toArrow()  # ``sample`` rows; their sets are views of it
    grade = rows.column("grade").to_numpy().astype(int)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("words")]
    order = sorted(range(len(sets)), key=lambda i: (hashlib.blake2b(sets[i]).digest(), grade[i]))  # alike on every run
    sets, grade = [sets[i] for i in order], grade[order]
    if not len(sets):
        return np.zeros(0, np.uint64), np.zeros(0), np.array([np.inf])
    keep = one_of_each(sets)
    sets, grade = [s for s, k in zip(sets, keep) if k], grade[keep]
    words = telling_words(sets, grade > 0)
    x = np.array([np.isin(words, s) for s in sets], float).reshape(len(sets), len(words))
    return words, *fit_ordinal(x, grade, max(int(grade.max()), 1))


def _scorer(model):
    """Scores w . x of texts, over whole texts."""
    words, w, _ = model
    order = np.argsort(words)
    words, w = words[order], w[order]
    sieve = np.zeros(1 << 20, bool)
    sieve[(words >> np.uint64(44)).astype(np.int64)] = True

    def score(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        out = np.zeros(n)
        for lo, hi in C.byte_slices(offs, SLICE) if len(words) else ():
            h, doc = features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            hit = np.flatnonzero(sieve[(h >> np.uint64(44)).astype(np.int64)])
            at = np.searchsorted(words, h[hit])
            at[at == len(words)] = 0
            same = words[at] == h[hit]
            pair = np.unique(doc[hit[same]] * len(words) + at[same])
            out[lo:hi] = np.bincount(pair // len(words), weights=w[pair % len(words)], minlength=hi - lo)
        return out

    return score


def grade_documents(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, severity (expected grade), p_toxic (grade 1 or more), grade, toxic, kept."""
    score, theta = _scorer(model), model[2]

    def run(batches):
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(score(*C.col_bytes(batch.column(1)))[:, None] - theta[None, :], -40, 40)))
            yield C.record([(id_col, batch.column(0)), ("severity", pa.array(p.sum(1))), ("p_toxic", pa.array(p[:, 0])), ("grade", pa.array((p >= 0.5).sum(1).astype(np.int32))), ("toxic", pa.array(p[:, 0] > 0.5)), ("kept", pa.array(p[:, 0] <= 0.5))])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(C.lean(run), f"`{id_col}` {kind}, severity double, p_toxic double, grade int, toxic boolean, kept boolean")


def toxic_labels(labels: DataFrame) -> DataFrame:
    """Grades 0 and 1 from the table of labels."""
    return labels.where("toxic IS NOT NULL").select("doc_id", (F.col("toxic") > 0).cast("int").alias("grade"))


def clean_documents(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected; rows with a null id are judged by their text."""
    score, theta = _scorer(model), model[2]
    at_text = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score(*C.col_bytes(batch.column(at_text))) <= theta[0]))

    return docs.mapInArrow(C.lean(run), docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents")
    model = fit(docs, toxic_labels(C.read_table(spark, sf_dir, "labels")))
    return grade_documents(docs, model)
