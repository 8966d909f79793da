"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What a formatted conversation looks like and which turn orders are valid.

    A turn is written as ``<|role|>`` newline, the text, ``<|/turn|>`` newline. The control strings are
    ``opener`` and ``closer``; both are escaped inside roles and texts by a backslash after their first
    character, and a backslash is doubled, so the output holds them unescaped at turn marks only.
    """

    opener: str = "<|"
    closer: str = "|>"
    end_mark: str = "/turn"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user", "tool": "tool"},
            "tool": {"assistant": "assistant"},
        }
    )


def escape(text: Column, t: ChatTemplate) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (t.opener, t.closer):
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    """Every backslash of an escaped text stands before one literal character; a left-to-right pass drops it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _first_break(roles: Column, t: ChatTemplate) -> Column:
    """Run the machine over an array of roles: struct(state, step, bad), bad = 0-based first invalid turn or -1."""
    steps = [(f"{state}\x00{role}", nxt) for state, moves in t.transitions.items() for role, nxt in moves.items()]
    moves = F.create_map(*[F.lit(x) for pair in steps for x in pair])
    begin = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("step"), F.lit(-1).alias("bad"))

    def move(acc: Column, role: Column) -> Column:
        nxt = F.try_element_at(moves, F.concat_ws("\x00", acc["state"], role))
        return F.struct(
            F.coalesce(nxt, acc["state"]).alias("state"),
            (acc["step"] + 1).alias("step"),
            F.when((acc["bad"] < 0) & nxt.isNull(), acc["step"]).otherwise(acc["bad"]).alias("bad"),
        )

    return F.aggregate(roles, begin, move)


def format_conversations(
    turns: DataFrame,
    template: ChatTemplate | None = None,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: (conv, n_turns, valid, bad_turn, segments, formatted).

    ``segments`` is array<struct<text, loss>> in order; its texts joined are ``formatted``. ``valid`` says that
    the roles follow the template's machine and stop in an accepting state; ``bad_turn`` is the 0-based first
    turn that the machine refuses (-1: none). Invalid conversations are formatted too; callers filter on
    ``valid``.

    Nulls: a null text or role counts as empty; null turns sort last; a row with a null conversation id is a
    conversation of its own, as nothing says that such rows belong together (so they gather in no task). Rows with the same turn are ordered by role, then text; repeated rows each count. An empty
    table gives no rows. Extra columns are ignored. One conversation becomes one row, as its format is one text,
    so the longest conversation bounds a task's row, not the number of conversations.
    """
    t = template or ChatTemplate()
    row = F.struct(
        F.col(turn).isNull().alias("late"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    grouped = turns.select(F.col(conv), row.alias("_r")).groupBy(
        conv, F.when(F.col(conv).isNull(), F.monotonically_increasing_id()).alias("_own")
    ).agg(F.sort_array(F.collect_list("_r")).alias("_t"))

    def turn_segments(r: Column) -> Column:
        head = F.concat(F.lit(t.opener), escape(r["role"], t), F.lit(t.closer + "\n"))
        foot = F.lit(f"{t.opener}{t.end_mark}{t.closer}\n")
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(r["text"], t).alias("text"), r["role"].isin(*t.loss_roles).alias("loss")),
            F.struct(foot.alias("text"), F.lit(False).alias("loss")),
        )

    machine = _first_break(F.transform("_t", lambda r: r["role"]), t)
    out = grouped.select(
        F.col(conv),
        F.size("_t").cast("long").alias("n_turns"),
        machine.alias("_m"),
        F.flatten(F.transform("_t", turn_segments)).alias("segments"),
    )
    return out.select(
        F.col(conv),
        "n_turns",
        ((F.col("_m.bad") < 0) & F.col("_m.state").isin(*t.accepting)).alias("valid"),
        F.col("_m.bad").alias("bad_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """Parse a formatted conversation into array<struct<role, text>>, undoing the escapes."""
    t = template or ChatTemplate()
    parts = F.split(formatted, "\\Q" + t.opener + "\\E", -1)
    heads = F.filter(parts, lambda _, i: i % 2 == 1)

    def turn(part: Column) -> Column:
        at = F.instr(part, t.closer)
        return F.struct(
            unescape(F.substr(part, F.lit(1), at - 1)).alias("role"),
            unescape(F.substr(part, at + len(t.closer) + 1)).alias("text"),
        )

    return F.transform(heads, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
