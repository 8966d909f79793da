import hashlib
import random
import zlib
from itertools import groupby

import pytest

from loomframe.llm import queries, turnrepair

SCHEMA = "conv_id long, turn long, role string, text string, _conv string, copies_ int, part int"
INITIAL = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}


def plain(rows):
    """Cost, audit and repaired lines of rows (role, text) by trying every edit, and the faults."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.rstrip(turnrepair.SPACE)
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "k")
        seen.add((role, text))

    memo = {}

    def best(i, state, inserts):
        """The least (cost, audit, lines) from here; the state is what was written last, '' for nothing."""
        if (i, state, inserts) in memo:
            return memo[i, state, inserts]
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        turn = "a" if state == "u" else "u"
        if inserts < 3:
            c, a, x = best(i, turn, inserts + 1)
            options.append((c + 3, "I" + a, (INITIAL[turn] + ":", *x)))
        if i < len(rows):
            role, text = rows[i]
            c, a, x = best(i + 1, state, 0)
            options.append((c + 4, "D" + a, x))
            if faults[i] in "kt":
                more = 3 if faults[i] == "t" else 0
                c, a, x = best(i + 1, turn, 0)
                options.append((c + 3 + more, "R" + a, (f"{INITIAL[turn]}:{text}", *x)))
                if role[:1] == turn or (role[:1] == "s" and state == ""):
                    c, a, x = best(i + 1, role[:1], 0)
                    options.append((c + more, "K" + a, (f"{role}:{text}", *x)))
        memo[i, state, inserts] = min(options, default=(10**9, "~", ()))
        return memo[i, state, inserts]

    cost, audit, lines = best(0, "", 0)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:], strict=False)]
    count = {f: faults.count(f) for f in "bdt"}
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), count["b"], count["d"], count["t"], sum(p not in ("su", "ua", "au") for p in pairs)


def expected(table):
    """Every conversation of rows (conv_id, turn, role, text, copies) by the plain version."""
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for conv, rows in groupby(sorted(table, key=key), key):
        rows = [(t, " " if role is None else role, " " if text is None else text, n) for _, t, role, text, n in rows]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv[1] if conv[0] else None] = (gaps, *plain([(r[1], r[2]) for r in rows for _ in range(r[3])]))
    return out


def found(df):
    return {r.conv_id: (r.gaps, r.cost, r.audit, r.repaired_sha256, r.blank, r.duplicate, r.truncated, r.illegal) for r in df.collect()}


def odd_rows(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "", " \n", "Why? ", "end.\x0b", "ü", "x. y", "Nö?\n", None]
    roles = ["user", "assistant", "system", "tool", "", None, "usher", "Assistant"]
    out = []
    for c in range(conversations):
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([t, t, t, t + 3, 0, None])
            out.append((rng.choice([c, c, c, None]) if c < 2 else c, turn, rng.choice(roles[:3] * 3 + roles), rng.choice(texts[:2] * 4 + texts), rng.choice([1, 1, 1, 2, 5])))
    return out


@pytest.mark.parametrize("block", [4096, 2])
def test_against_every_edit(spark, monkeypatch, block):
    """Blocks of two rows give what one block gives: costs, audits, hashes and figures on their borders."""
    monkeypatch.setattr(turnrepair, "ROWS_AT_ONCE", block)
    rows = odd_rows(block, 60, 9)
    got = found(turnrepair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int")))
    assert got == expected(rows)


def test_audits_of_known_rows(spark):
    """Ties between cheapest audits, missing turns, a system turn in the wrong place."""
    cases = {"ua": "KK", "sua": "KKK", "u": "KI", "a": "IK", "s": "D", "": None, "uu": "DIKI", "usa": "KDK", "ut": "KR", "aau": "DD"}
    rows = [(i, t, INITIAL[c], f"{c}{t}.") for i, k in enumerate(cases) for t, c in enumerate(k)]
    got = {r.conv_id: (r.audit, r.cost) for r in turnrepair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = {i: plain([(INITIAL[c], f"{c}{t}.") for t, c in enumerate(k)])[:2][::-1] for i, k in enumerate(cases) if k}
    assert got == want
    assert got[0] == ("KK", 0) and got[2] == ("KI", 3) and got[4] == ("D", 4) and got[7] == ("KDK", 4)


def test_turns_and_edges(spark):
    """Turns come in order; conversations without rows, extra columns, empty tables and a very long conversation."""
    ddl = "conv_id long, turn long, role string, text string, _conv string, _h string, part int, n int, kind int"
    rows = [(1, 0, "user", "y" * 300_000 + ".", "q", "q", 1, 1, 1), (1, 1, "user", "b.", "q", "q", 1, 1, 1), (2, 5, "system", " ", "q", "q", 1, 1, 1)]
    df = spark.createDataFrame(rows, ddl)
    turns = [(r.conv_id, r.place, r.role, r.text[:2]) for r in turnrepair.repaired_turns(df).orderBy("conv_id", "place").collect()]
    assert turns == [(1, 0, "user", "yy"), (1, 1, "assistant", "b.")]
    got = found(turnrepair.repair_conversations(df, spark.createDataFrame([(3,), (2,), (None,)], "conv_id long")))
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[3] == got[None] == (0, 0, "", nothing, 0, 0, 0, 0) and got[2] == (0, 4, "D", nothing, 1, 0, 0, 0)
    assert turnrepair.repair_conversations(df.limit(0)).count() == 0
    long = spark.range(30_000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat(id, '.') AS text")
    one = turnrepair.repair_conversations(long).collect()
    assert len(one) == 1 and one[0].audit == "K" * 30_000 and one[0].cost == 0 and one[0].illegal == 0 and one[0].gaps == 0
    lines = "\n".join(f"{'assistant' if i % 2 else 'user'}:{i}." for i in range(30_000))
    assert one[0].repaired_sha256 == hashlib.sha256(lines.encode()).hexdigest()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    damaged, every = [], set()
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        every.add(r.conv_id)
        fate = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if fate == 1 else r.text.translate({ord(c): None for c in ".!?"}) if fate == 2 else r.text
        if fate:
            damaged.append((r.conv_id, r.turn, "user" if fate == 4 else r.role, text, 2 if fate == 3 else 1))
    got = found(queries.op12_turnrepair(spark, sf))
    want = expected(damaged)
    assert got.keys() == every
    assert {c: got[c] for c in want} == want and all(got[c][:3] == (0, 0, "") for c in every - want.keys())
