import random

from loomframe.llm import decontam, sharding

SCHEMA = "doc_id long, text string, n_hit string"
BENCH = "item_id long, text string, hits string"


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = decontam.words_of(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            wins.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = []
    for _, t in docs:
        w, hit, ids = decontam.words_of(t), set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                got = wins.get(tuple(w[k : k + m]))
                if got:
                    hit.update(range(k, k + m))
                    ids |= got
        out.append((len(w), len(hit), sorted(ids)))
    return out


def test_small_alphabet_against_brute_force(spark):
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choice(["a", "B", "c", "é"]) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 5, 9, 10, 11, 14]))) for i in range(3, 9)] + [(20, None), (21, ""), (None, text(10)), (22, text(12)), (22, text(12))]
    items = [x for x in items if x[1] is None or len(decontam.words_of(x[1])) != 1]
    docs = [(i, text(rnd.randrange(0, 60))) for i in range(40)] + [(90, None), (91, ""), (None, items[0][1])]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], SCHEMA)
    b = spark.createDataFrame([(a, c, "x") for a, c in items], BENCH)
    want = sorted(brute(docs, [x for x in items if x[0] is not None]))
    for block in (16_000_000, 20):  # one block, and one for nearly each item
        got = decontam.decontaminate(d, b, block_bytes=block, keep=("n_hit", "text")).collect()
        assert sorted((r.n_words, r.n_hit, r["items"]) for r in got) == want
        assert {r.doc_id: r.text for r in got} == dict(docs)
    assert decontam.decontaminate(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontam.decontaminate(d, b.limit(0)).collect()} == {0}


def test_a_block_holds_tables_of_bounded_size(spark):
    """What a worker holds for a block, and that the next block takes its place; very long texts are searched whole."""
    import tracemalloc

    rnd = random.Random(8)
    items = [(i, " ".join(f"w{rnd.randrange(50_000)}" for _ in range(200))) for i in range(600)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    first = decontam._searcher("one", items, 10)
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert used < 60 * size
    assert decontam._searcher("one", items, 10) is first
    decontam._searcher("two", items[:5], 10)
    assert list(decontam._HELD) == ["two"]
    text = "word " * 300_000 + items[3][1] + " word" * 300_000
    assert first(text) == (600_200, [[300_000, 300_200]], [3])
    docs = spark.createDataFrame([(1, text), (2, "word"), (2, "word")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (6_000_000, 200_000):  # one pass, and a pass for each of several blocks
        got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontam.decontaminate(docs, bench, block_bytes=block).collect())
        assert got == [(1, 600_200, 200, [3]), (2, 1, 0, []), (2, 1, 0, [])]


def test_words():
    assert decontam.words_of("It's ÉTÉ, x_1 Z!") == ["it".encode(), b"s", "ÉtÉ".encode(), b"x", "1 z".encode()]


def test_shards(spark):
    rnd = random.Random(1)
    rows = [(i, "x" * rnd.randrange(0, 400), "own") for i in range(800)] + [(None, None, "own"), (7, "y" * 3000, "own"), (9000, "z" * 50_000, "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.assign_shards(df, 2000).collect()
    assert len(out) == len(rows)
    size, ids = {}, {}
    for r in out:
        size[r.shard] = size.get(r.shard, 0) + r.row_bytes
        ids.setdefault(r.shard, set()).add(r.doc_id)
    for r in out:
        assert size[r.shard] == r.shard_bytes
        assert r.shard_bytes <= 2000 or len(ids[r.shard]) == 1
    assert len(size) > 50
    prefixes = {tuple(map(int, s.split(".")[0].split("-"))) for s in size}
    for depth, p in prefixes:  # no shard's prefix lies within another's
        assert not any(d < depth and p >> (depth - d) == q for d, q in prefixes)
    assert sharding.assign_shards(df.limit(0), 2000).count() == 0


def test_the_query_splits_buckets(spark):
    """At the query's own limit the documents of sf0.01 fall into several shards of several depths or one depth below the root."""
    from loomframe.llm import queries

    out = queries.op9_sharding(spark, "/root/testdata/sf0.01").collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    assert len(by) > 2 and all(r.shard_depth > 0 for r in out)
    assert all(sum(r.row_bytes for r in rows) == rows[0].shard_bytes <= queries.SHARD_BYTES or len(rows) == 1 for rows in by.values())


def test_one_key_with_a_third_of_all_rows(spark):
    """Rows of one key part by their text, equal ones by their place: every shard of several rows fits."""
    rnd = random.Random(3)
    rows = [(i, "x" * rnd.randrange(1, 300), "a") for i in range(300)]
    rows += [(5, f"{i} " + "y" * rnd.randrange(1, 300), "b") for i in range(250)] + [(77, "the same text " * 12, "c")] * 150 + [(None, None, "d")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, _shard_note string").repartition(5)
    out = sharding.assign_shards(df, 2000).collect()
    assert sorted((r.doc_id or -1, r.text or "", r._shard_note) for r in out) == sorted((a or -1, b or "", c) for a, b, c in rows)
    size, n = {}, {}
    for r in out:
        size[r.shard] = size.get(r.shard, 0) + r.row_bytes
        n[r.shard] = n.get(r.shard, 0) + 1
    assert all(size[r.shard] == r.shard_bytes and (r.shard_bytes <= 2000 or n[r.shard] == 1) for r in out)
    assert sum("." in s for s in size) > 20
    others = {}
    for r in out:
        if r.doc_id not in (5, 77):
            others.setdefault(r.doc_id, set()).add(r.shard)
    assert all(len(s) == 1 for s in others.values())


def test_columns_of_any_name_pass_through(spark):
    """Names used inside, names with dots and blanks; only the added names are replaced. With and without a crowded key."""
    names = ["_h", "_bytes", "_shard", "_rows", "_slot", "_tie", "_depth", "_size", "_outer", "c0", "slot", "depth", "prefix", "a.b", "c d", "shard", "row_bytes"]
    ddl = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    for crowd in (0, 60):
        rows = [(i, "x" * 40, *[f"{n}{i}" for n in names]) for i in range(100)] + [(7, "y" * 30 + str(i), *[f"{n}-{i}" for n in names]) for i in range(crowd)]
        out = sharding.assign_shards(spark.createDataFrame(rows, ddl), 500)
        assert out.columns == ["doc_id", "text", *names[:-2], "row_bytes", "shard", "shard_depth", "shard_bytes"]
        kept = ["doc_id", "text", *names[:-2]]
        got = out.collect()
        assert sorted(tuple(r[c] for c in kept) for r in got) == sorted(r[: len(kept)] for r in rows)
        assert all(r.row_bytes == len(r.text) and r.shard_bytes <= 500 for r in got)
