import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomframe.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, sequence_id string"


def whole(rows, size):
    """Sequences are gapless from 0 and within the size."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= size
    return len(by)


def test_ids_equal_the_tokenizers_library(spark):
    own = Tokenizer.from_file(PATH)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["", " ", "  a \n\n b\t", "<|endoftext|> x", "a  <|endoftext|>", "x <|endoftext|><|endoftext|>\n\n<|endoftext", "it's  I'LL don't", "é́   \U0001f600 ½ Ⅷ", "a\x85b 　 c", "0" * 3000, "\r\n \r\n"]
    encode = packing.TokenEncoder(PATH)
    assert packing.np.frombuffer(encode("<|endoftext|> x"), "<u4").tolist() == own.encode("<|endoftext|> x", add_special_tokens=False).ids
    for t in texts:
        assert encode(t) == np.asarray(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:50]


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op4_packing(spark, sf).collect()
    own = Tokenizer.from_file(PATH)
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.asarray([*own.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (a, n) in enumerate(packing.cut_points(len(ids), 1024)):
            want[r.doc_id, k] = (a, n, zlib.crc32(ids[a : a + n].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
    bins = whole(rows, 1024)
    assert bins <= 1.03 * -(-sum(n for _, n, _ in want.values()) // 1024) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_each_document_once(seed):
    rnd = random.Random(seed)
    size = 100
    counts = Counter(min(size, max(1, int(rnd.lognormvariate(3, 1)))) for _ in range(3000))
    plan = packing.best_two_fit(dict(counts), size)
    used = Counter()
    for n, bin_ in plan:
        assert sum(bin_) <= size and n > 0
        for x in bin_:
            used[x] += n
    assert used == counts
    total = sum(k * v for k, v in counts.items())
    assert sum(n for n, _ in plan) <= 1.02 * total / size + 2


def test_swap_takes_two_for_the_smallest():
    # Greedy alone fills 60+30 and leaves 10 empty; 25+15 in place of 30 fills the bin.
    assert packing.best_two_fit({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0] == (1, [60, 25, 15])


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "y"), (4, "word " * 5000, "z"), (4, "word " * 5000, "z")]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH, size=64).collect()
    assert whole(out, 64)
    assert [(r.piece, r.start, r.length) for r in out if r.doc_id in (1, 2)] == [(0, 0, 1)] * 2
    long = [r for r in out if r.doc_id == 4]
    assert sum(r.length for r in long) == 2 * long[0].n_tokens and long[0].n_tokens > 5000
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
