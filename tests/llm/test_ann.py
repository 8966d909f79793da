import numpy as np
import pytest

from loomframe.llm import ann, queries


def brute(rows, k=5):
    out = {}
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    norms = np.sqrt((x * x).sum(1))
    for i in np.flatnonzero(ids % 50 == 0):
        s = (x * x[i]).sum(1) / (norms * norms[i])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    d = f"/root/testdata/{sf}"
    want = brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()])
    got = {}
    for r in sorted(queries.op8_ann(spark, d).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    exact = {(q, a): s for q in want for a, s in want[q]}
    assert all(abs(s - exact.get((q, a), s)) < 1e-12 for q in got for a, s in got[q])


def test_edges(spark):
    rng = np.random.default_rng(1)
    same = [float(v) for v in rng.normal(size=8)]
    rows = [(i, same) for i in range(30, 80)] + [(i, [float(v) for v in rng.normal(size=8)]) for i in range(100, 180)]
    odd = [(0, None), (200, [0.0] * 8), (250, [float("nan")] * 8), (300, [float("inf")] + same[1:]), (350, [None] + same[1:]), (None, same), (400, [1.0]), (450, [])]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in rows + odd + rows[:2]], "vec_id long, embedding array<double>, score double")
    got = {}
    for r in ann.search(ann.build_index(df), df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert got.keys() == {50, 100, 150}
    assert [got[50][i] for i in range(1, 6)] == [30, 31, 32, 33, 34]
    want = brute(rows)
    assert all([got[q][i + 1] for i in range(5)] == [a for a, _ in want[q]] for q in (100, 150))
    few = df.where("vec_id in (100, 101, 102)")
    assert ann.search(ann.build_index(few), few.where("vec_id % 50 = 0")).count() == 2
    none = df.limit(0)
    assert ann.build_index(none) is None and ann.search(None, none).count() == 0


def test_recall_over_chunks_and_query_blocks(spark):
    """50,000 rows of 64 dimensions, so several chunks a task, and the 1000 queries in blocks of 100."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(300, 64))
    x = (centres[rng.integers(0, 300, 50_000)] + 0.7 * rng.normal(size=(50_000, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in ann.search(ann.build_index(df), df.where("vec_id % 50 = 0"), block_bytes=100 * 64 * 8).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    hits = 0
    for q in range(0, 50_000, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argpartition(-s, 5)[:5].tolist()) & set(got[q].values()))
    print("recall", hits / 5000)
    assert len(got) == 1000 and all(len(v) == 5 for v in got.values()) and hits / 5000 >= 0.95


def test_sample_of_few_repeated_keys(spark):
    """Keys that all hash above the sample's share still give an index; the dimension is that of most rows."""
    rows = [(k, [float(k), 1.0, float(k % 3)]) for k in (50, 51, 52)] * 40 + [(60 + i, [1.0, 2.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build_index(df, sample_rows=2)
    assert index is not None and index.quantiser.dim == 3
    assert {r.vec_id for r in ann.search(index, df.where("vec_id = 50")).collect()} == {51, 52}


def test_wide_vectors(spark):
    """1024 dimensions: recall, and what the parts of it take at most in the driver and in a worker."""
    import tracemalloc

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 1024))
    x = (centres[rng.integers(0, 60, 3000)] + 0.9 * rng.normal(size=(3000, 1024))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(2)
    index = ann.build_index(df)
    got = {}
    for r in ann.search(index, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute([(i, v) for i, v in enumerate(x)])
    assert sum(len(got[q] & {a for a, _ in want[q]}) for q in want) / (5 * len(want)) >= 0.9

    def peak(f):
        tracemalloc.start()
        f()
        most = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return most

    unit = rng.normal(size=(2048, 1024))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    assert peak(lambda: index.quantiser.encode(unit)) < 200 and peak(lambda: ann.fit(unit[:1024], rounds=2)) < 300
