import random
import re

import numpy as np
import pytest

from loomframe.llm import components, minhash, neardup, queries

SCHEMA = "doc_id long, text string, component_id string"


def word_sets(text, width=5):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, percent=85):
    """Components by comparing every pair that shares a shingle."""
    sets = [word_sets(t) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    seen = set()
    for group in where.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        root[find(b)] = find(a)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op3_neardup(spark, sf)
    assert found(out) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


@pytest.mark.parametrize("blocks", [False, True])
def test_chains_and_large_groups(spark, blocks, monkeypatch):
    """Copies that drift: neighbours link, far ones do not; small blocks exercise the work between blocks."""
    if blocks:
        monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
        monkeypatch.setattr(neardup, "PIVOTS", 2)
    rnd = random.Random(5)
    rows, ids = [], iter(rnd.sample(range(10_000), 400))
    for _ in range(3):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([60, 150]))]
        for _ in range(40):
            words = list(words)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
            rows.append((next(ids), " ".join(words)))
    base = [f"b{i}" for i in range(120)]
    for _ in range(80):
        own = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4])):
            own[rnd.randrange(120)] = f"m{rnd.randrange(10**6)}"
        rows.append((next(ids), " ".join(own)))
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA)
    assert found(neardup.near_duplicates(df)) == brute(rows)


def test_edges(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(9, "one two"), (4, "One  TWO"), (5, None), (6, ""), (7, " \n"), (8, text * 300), (None, "one two"), (None, None), (3, text), (2, text), (2, text), (11, text), (11, "un deux trois"), (12, "un deux trois")]
    out = neardup.near_duplicates(spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r.component_id for r in out}
    assert got == {9: 4, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, None: None, 3: 2, 2: 2, 11: 2, 12: 2}
    assert {r.n_shingles for r in out if r.doc_id in (5, 6, 7)} == {0}
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    """One task with all edges, and many tasks of a few edges each."""
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)]
    edges += [(5, 5), (None, 3), edges[0]]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    edges += [(5000, 5001 + i) for i in range(400)] + [(6000 + i, 6001 + i) for i in range(300)]
    for a, b in edges[-700:]:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    rows = spark.createDataFrame(edges, "u long, v long").repartition(5)
    for at_once in (30, components.EDGES_PER_TASK):
        got = {r.node: r.component for r in components.connected_components(rows, edges_per_task=at_once).collect()}
        assert got == {x: find(x) for x in root}
    assert components.connected_components(rows.where("u is null")).count() == 0


def test_hashes_follow_words():
    for t in ["", " ", "a", " A b  c", "x" * 5000 + " y", "Été ABC\n\tabc  Foo ", "  lead"]:
        words = re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower())
        h = minhash.word_hashes(t.encode())
        assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
        assert np.array_equal(h, minhash.word_hashes(t.encode(), 3))
        assert len(minhash.shingles(h, 5)) == len(word_sets(t))


def test_similarity_of_80_percent(spark):
    """A whole table and pairs that drift through 0.80 to 0.85: bands and limits follow the threshold."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    base = max(d for d, _ in rows) + 1
    for i in range(40):
        words = [f"v{i}x{j}" for j in range(104)]
        other = [*words[: 104 - 9 - i % 5], *(f"u{i}x{j}" for j in range(9 + i % 5))]
        rows += [(base + 2 * i, " ".join(words)), (base + 2 * i + 1, " ".join(other))]
    got = found(neardup.near_duplicates(spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA), percent=80))
    assert got == brute(rows, 80) != brute(rows)
    assert neardup.banding(85) == (36, 7) and neardup.limits(85, 252) == (0.70, 0.50)
    bands, r = neardup.banding(80)
    assert (1 - 0.8**r) ** bands < 1e-6 < (1 - 0.8**7) ** 36
