import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from claimloom.llm import _common as C
from claimloom.llm import packing as P

from .util import docs_of

ALPHABET = ["'", " ", "  ", "\n", "\t", "s", "t", "re", "ve", "ll", "m", "d", "a", "é", "ß", "1", "２", "½", "!", "?", "'s", " ", "　", "中", "😀", "<|endoftext|>", "́", "S", "Ⅷ", "\x85"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.default_tokenizer())


def test_ids_equal_the_tokenizer(reference):
    rng = random.Random(7)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 14))) for _ in range(8000)] + [None, "", " ", "'", "don't we'll THEY'RE  x"]
    own = P.WordTokens(P.default_tokenizer())
    data, offs = C.col_bytes(pa.array(texts))
    ids, tops = own.encode(data, offs)
    for i, x in enumerate(reference.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert x.ids == ids[tops[i] : tops[i + 1]].tolist(), texts[i]


def test_added_tokens_are_those_of_the_tokenizer_as_loaded(reference):
    texts = ["a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext|>", "<|endof", "text|>", "it<|endoftext|>'s <|endoftext|><|endoftext|> x", "  <|endoftext|>\n\n"]
    own = P.WordTokens(P.default_tokenizer())
    data, offs = C.col_bytes(pa.array(texts))
    ids, tops = own.encode(data, offs)
    for i, x in enumerate(reference.encode_batch(texts, add_special_tokens=False)):
        assert x.ids == ids[tops[i] : tops[i + 1]].tolist(), texts[i]
    assert 50256 in ids.tolist()


def test_small_table_of_words_still_gives_exact_ids(reference):
    own = P.WordTokens(P.default_tokenizer())
    own.POOL = 50  # forces resets
    rng = random.Random(3)
    for _ in range(20):
        texts = [" ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(30)) for _ in range(5)]
        data, offs = C.col_bytes(pa.array(texts))
        ids, tops = own.encode(data, offs)
        assert ids.tolist() == [y for x in reference.encode_batch(texts, add_special_tokens=False) for y in x.ids]


def check_plan(counts, limit):
    table, n = P.packing_plan(counts, limit)
    fill, seen = defaultdict(list), defaultdict(list)
    for length, lo, hi, seq, off in table.tolist():
        seen[length].append((lo, hi))
        for r in range(lo, hi):
            fill[seq + r - lo].append((off, length))
    for length in range(1, limit + 1):
        at = 0
        for lo, hi in sorted(seen[length]):
            assert lo == at
            at = hi
        assert at == counts[length]
    assert len(fill) == n
    for parts in fill.values():
        at = 0
        for off, length in sorted(parts):
            assert off == at
            at += length
        assert at <= limit
    return n


def test_plan_places_every_piece_and_is_tight():
    rng = np.random.default_rng(1)
    for limit, size in ((16, 300), (64, 2000), (1024, 5000)):
        counts = np.bincount(rng.integers(1, limit + 1, size), minlength=limit + 1)
        n = check_plan(counts, limit)
        least = -(-int((counts * np.arange(limit + 1)).sum()) // limit)
        assert n <= least * 1.02 + 1
    assert check_plan(np.array([0, 0, 0, 0, 0, 0, 7, 0, 0, 0]), 9) == 7
    assert check_plan(np.zeros(9, np.int64), 8) == 0


def test_pack_round_trip(spark, reference):
    rng = random.Random(11)
    texts = [None, "", "a b c", "a<|endoftext|> b c"] + [" ".join("".join(rng.choices("abcdexyz", k=rng.randint(1, 9))) for _ in range(rng.choice([3, 60, 400, 900, 5000]))) for _ in range(40)]
    df = docs_of(spark, texts).withColumnRenamed("n_chars", "length")  # a clashing name
    rows = P.pack(df).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = reference.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // 1024)))
        for r in pieces:
            assert r.start == at and 0 < r.length <= 1024
            if r.piece:
                assert r.length == 1024
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 1024


def test_pack_empty(spark):
    assert P.pack(docs_of(spark, ["a"]).where("doc_id > 5")).collect() == []
