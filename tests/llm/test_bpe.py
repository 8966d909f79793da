import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from loomframe.llm import bpe, queries

FILE, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return bpe.BytePairEncoder(FILE, PATTERN)


@pytest.fixture(scope="module")
def library(own):
    made = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    return lambda text: np.array(made.encode_ordinary(text), "<u4").tobytes()


def test_every_character(own, library):
    texts = [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}  {chr(c)}x" for c in [*range(0x3000), *range(0xFE00, 0x10000), *range(0x1F600, 0x1F650)]]
    assert list(own.encode(texts)) == [library(t) for t in texts]


def test_mixed_and_long_texts(own, library):
    """Runs longer than the widest matrix, texts longer than one round of work, special strings as ordinary text."""
    rng = random.Random(5)
    bits = [" ", "\n", "\t", "'s", "the", "ing", "é", "日本", "-", "=", "<|endoftext|>", " ", "　", "\U0001f600", "12", "q"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 80))) for _ in range(500)]
    texts += ["a" * 5000, " " * 3000, "ab" * 600, "".join(rng.choice("abcdefghij") for _ in range(3000)), "", "x", "-=" * 2000, "é" * 511]
    texts += ["".join(rng.choice("abc etaoin  ") for _ in range(own.at_once + 100))]
    got = list(own.encode(texts))
    assert got == [library(t) for t in texts]
    assert [own.decode(g) for g in got] == [t.encode() for t in texts]


def test_matrices_and_heap_agree(own):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdet-") for _ in range(rng.randint(2, 60))).encode() for _ in range(400)]
    words = [w for w in words if w not in own.ranks]
    assert own.encode_words(words) == [own._merge_long(w) for w in words]


def test_pair_table():
    """Chains of equal slots, pairs that are not there, padding."""
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 300, (5000, 2)), axis=0).astype(np.int32)
    table = bpe.PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs), dtype=np.int32))
    assert (table(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    assert (table(pairs[:, 0] + 1000, pairs[:, 1]) == 2**31 - 1).all()
    assert table(np.array([-1, 3], np.int32), np.array([3, -1], np.int32)).tolist() == [2**31 - 1] * 2


def test_edges(spark):
    ddl = "doc_id long, text string, ids string, n_tokens string, decoded string"
    rows = [(1, None, "q", "q", "q"), (None, "hello world", "q", "q", "q"), (2, "", "q", "q", "q"), (3, "b" * 200_000, "q", "q", "q"), (3, "b" * 200_000, "q", "q", "q")]
    made = bpe.decode_ids(bpe.encode_texts(spark.createDataFrame(rows, ddl), FILE, PATTERN), FILE, PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in made) == sorted((a or 0, (b or "").encode()) for a, b, *_ in rows)
    assert {r.doc_id: r.n_tokens for r in made if r.doc_id in (1, 2, None)} == {1: 0, 2: 0, None: 2}
    assert bpe.encode_texts(spark.createDataFrame([], ddl), FILE, PATTERN).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op11_bpe(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        ids = library(text)
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert got[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
