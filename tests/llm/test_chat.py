import hashlib

from pyspark.sql import functions as F

from loomframe.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def test_round_trip(spark):
    odd = [r"\### Assistant: </turn> ok", "<|/turn|>\n", "<|user|>", "\\<|", "<\\|", "|>|>", "<|>", "\\", "\\\\", "a\nb", "é\U0001f600", "$1 \\$2", ""]
    rows = [(c, t, r, x, "z") for c, x in enumerate(odd) for t, r in enumerate(["user", "assistant", "we<|ird|>\\"])]
    made = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    out = made.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    assert len(out) == len(odd)
    for r in out:
        x = odd[r.conv_id]
        assert [(t.role, t.text) for t in r.t] == [("user", x), ("assistant", x), ("we<|ird|>\\", x)]
        assert r.loss == x
        assert r.formatted.count("<|") == 6 and r.formatted.count("|>") == 6


def test_machine(spark):
    cases = {"ua": (True, -1), "sua": (True, -1), "u": (False, -1), "au": (False, 0), "uua": (False, 1), "uata": (True, -1), "uas": (False, 2), "": None}
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    rows = [(i, t, names[c], "x", "z") for i, k in enumerate(cases) for t, c in enumerate(k)]
    got = {r.conv_id: (r.valid, r.bad_turn) for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: v for i, v in enumerate(cases.values()) if v}


def test_edges(spark):
    rows = [(1, 0, "user", None, "z"), (1, None, "assistant", "late", "z"), (1, 0, None, "x", "z"), (None, 0, "user", "a", "z"), (None, 0, "user", "a", "z"), (2, 0, "user", "y" * 500_000, "z")]
    every = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    out = {r.conv_id: r for r in every}
    assert out[1].n_turns == 3 and out[1].formatted.endswith("<|assistant|>\nlate<|/turn|>\n")
    assert [r.n_turns for r in every if r.conv_id is None] == [1, 1]  # nothing says that they belong together
    assert not out[1].valid and len(out[2].formatted) > 500_000
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    rows[-7] = [(0, "user", r"\### Assistant: </turn> ok"), (1, "assistant", r"\### Assistant: </turn> ok")]
    got = {r.conv_id: r for r in queries.op5_chat(spark, sf).collect()}
    assert got.keys() == rows.keys()
    for c, turns in rows.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
