"""Language identification with a blended-spectrum string kernel.

A text is the set of its 1- to 3-byte n-grams over lower-cased letters (other ASCII becomes one
blank).  The kernel of two texts is the number of n-grams in both, over the geometric mean of
their own numbers.  Landmarks sampled from the training texts give a Nyström map of the kernel;
one-versus-rest ridge regression on it has the closed form of kernel ridge regression.  Scoring
is two matrix products per batch: presence x landmarks, then x dual weights.

N-grams count that stand in at least ``min_df`` landmarks.  The fit uses at most ``per_language``
training texts for each language (those of least hash of the id) and ``landmarks`` of these.

Edges: a null text or one without a letter is ``und`` with score 0; a text that shares no n-gram
with any landmark gets the language with the largest bias; null languages are not learned from;
with nothing to learn all is ``und``; repeated rows are predicted each; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm import _common as C

PER_LANGUAGE = 400
LANDMARKS = 160
MIN_DF = 3
RIDGE = 1e-2
SHARPNESS = 6.0
SLICE = 1 << 20
ROWS = 256

_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def lowered(column) -> pa.Array:
    return pc.utf8_lower(column.fill_null(""))


def collapsed(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters with one blank for each run of other ASCII, and the offsets of the texts in them."""
    x = _LETTER[data]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)  # blanks that follow a blank carry nothing
    keep[offs[:-1][offs[:-1] < len(x)]] = True
    at = np.zeros(len(x) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return x[keep], at[offs]


def grams(x: np.ndarray, offs: np.ndarray):
    """(code, text) of every 1-, 2- and 3-gram of collapsed texts; a code tells its length."""
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    x = x.astype(np.int32)
    one, two, three = x, (x[:-1] << 8) | x[1:], (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    in2, in3 = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    return np.concatenate([one, two[in2] | (1 << 24), three[in3] | (2 << 24)]), np.concatenate([doc, doc[:-1][in2], doc[:-2][in3]])


def presence(column, index: np.ndarray, width: int):
    """Batches (first row, matrix of 0 and 1) over whole texts; ``index`` maps codes to columns.

    Texts go through in strips of bounded size that overlap by two collapsed bytes, so that every
    n-gram stands whole in one of them; presence is a union."""
    data, offs = C.col_bytes(column)
    for lo, hi in C.byte_slices(offs, SLICE):
        for a in range(lo, hi, ROWS):
            b = min(hi, a + ROWS)
            out = np.zeros((b - a, width + 1), np.float32)
            x, at = collapsed(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            for s in range(0, len(x), SLICE):
                e = min(len(x), s + SLICE + 2)
                code, doc = grams(x[s:e], np.clip(at, s, e) - s)
                out[doc, index[code]] = 1
            yield a, out[:, :width]


def code_index(vocabulary: np.ndarray) -> np.ndarray:
    index = np.full(3 << 24, len(vocabulary), np.int16 if len(vocabulary) < 32767 else np.int32)
    index[vocabulary] = np.arange(len(vocabulary))
    return index


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na, nb = np.maximum(a.sum(1), 1), np.maximum(b.sum(1), 1)
    return (a @ b.T) / np.sqrt(na[:, None] * nb[None, :])


def gram_set(text: bytes) -> np.ndarray:
    """The codes of a lower-cased text, each once and in order."""
    data = np.frombuffer(text, np.uint8)
    return np.unique(grams(*collapsed(data, np.array([0, len(data)])))[0]).astype(np.int32) if len(data) else np.zeros(0, np.int32)


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, min_df: int = MIN_DF, ridge: float = RIDGE):
    """(languages, vocabulary, landmark matrix, dual weights) from training texts."""
    return fit_sets([gram_set(t.lower().encode()) for t in texts], langs, landmarks, min_df, ridge)


def fit_sets(sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, min_df: int = MIN_DF, ridge: float = RIDGE):
    """The same from the texts' n-grams."""
    names = sorted(set(langs))
    order = sorted(range(len(sets)), key=lambda i: (langs[i], i))
    turn = {}
    spread = sorted(order, key=lambda i: (turn.setdefault(langs[i], [0]).__setitem__(0, turn[langs[i]][0] + 1) or turn[langs[i]][0], langs[i]))
    chosen = spread[:landmarks]  # languages by turns
    codes, df = np.unique(np.concatenate([sets[i] for i in chosen]), return_counts=True)
    vocabulary = codes[df >= min(min_df, len(chosen))]
    if not len(vocabulary):
        vocabulary = codes
    x = np.zeros((len(sets), len(vocabulary)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(vocabulary, s)
        at[at == len(vocabulary)] = 0
        x[i, at[vocabulary[at] == s]] = 1
    marks = x[chosen]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float))
    good = values > 1e-6 * values.max()
    nystrom = vectors[:, good] / np.sqrt(values[good])
    z = np.hstack([kernel(x, marks) @ nystrom, np.ones((len(sets), 1))])
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = np.array([langs.count(n) for n in names]) / len(langs)
    weight = np.array([1 / share[names.index(n)] for n in langs])
    beta = np.linalg.solve((z * weight[:, None]).T @ z + ridge * len(sets) / 100 * np.eye(z.shape[1]), (z * weight[:, None]).T @ y)
    return names, vocabulary.astype(np.int32), marks.astype(np.uint8), nystrom @ beta[:-1], beta[-1]


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, lang_pred, score for every row."""

    def run(batches):
        if model is None:
            for batch in batches:
                n = batch.num_rows
                yield C.record([(id_col, batch.column(0)), ("lang_pred", pa.array(["und"] * n)), ("score", pa.array(np.zeros(n)))])
            return
        names, vocabulary, marks, dual, bias = model
        index = code_index(vocabulary)
        marks = marks.astype(np.float32)
        labels = np.array([*names, "und"], object)
        for batch in batches:
            column = batch.column(1)
            letter = pc.match_substring_regex(column.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, x in presence(lowered(column), index, len(vocabulary)):
                f = kernel(x, marks) @ dual + bias
                e = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
                best[a : a + len(x)] = f.argmax(1)
                score[a : a + len(x)] = 1 / e.sum(1)
            best[~letter], score[~letter] = len(names), 0
            yield C.record([(id_col, batch.column(0)), ("lang_pred", pa.array(labels[best].tolist(), pa.string())), ("score", pa.array(score))])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(C.lean(run), f"`{id_col}` {kind}, lang_pred string, score double")


def fit_on(train: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """Fit on a bounded sample of the rows that have a language and a letter.  Hashes of ids first cut
    each language to about eight times the sample, so that no language gathers; the driver gets the
    n-grams of the sampled texts, not the texts."""
    known = train.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # languages, a closed list
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 8 * per_language / n))])[F.col("lang")]
    near = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 31)) < share * F.lit(1 << 31))
    turn = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text")
    some = near.withColumn("n", F.row_number().over(turn)).where(F.col("n") <= per_language).select("lang", "n", "text")

    def run(batches):
        for batch in batches:
            sets = [gram_set(t.as_py().encode()) for t in lowered(batch.column(2))]
            yield C.record([("lang", batch.column(0)), ("n", batch.column(1)), ("codes", pa.array([x.tobytes() for x in sets], pa.binary()))])

    rows = sorted(tuple(r) for r in some.mapInArrow(C.lean(run), "lang string, n int, codes binary").collect())
    return fit_sets([np.frombuffer(c, np.int32) for _, _, c in rows], [lang for lang, _, _ in rows])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit_on(docs.where(remainder != 2))
    return predict(docs, model).select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
