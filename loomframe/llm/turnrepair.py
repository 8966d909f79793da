"""Cheapest repair of conversations: shortest paths over (row, state) by Dial's buckets, and the least audit among them.

A repaired conversation reads `(s?(ua)+)?` in role initials. States are what has been written so far: nothing (E), a system turn
(S), a user turn (U), an assistant turn (A). From a state each edit leads to one state, so an audit names one path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import stored, tidy

#: Costs of the edits, and what a truncated row that stays adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Fixed value: the characters that make no content.
SPACE = " \t\n\x0b\x0c\r"
E, S, U, A = range(4)
ROLE = {U: "user", A: "assistant"}
#: The state after one more user or assistant turn, from each state.
NEXT = (U, U, A, U)
#: What ending costs from each state: missing turns are inserted.
END = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 60
_LARGEST = REROLE + TRUNCATED
ROWS_AT_ONCE = 4096


def kept_state(state: int, initial: str) -> int | None:
    """The state after a row is kept, None where it can't stay as it is."""
    if initial == "s":
        return S if state == E else None
    if initial == "u":
        return NEXT[state] if state != U else None
    return A if initial == "a" and state == U else None


def _costs(fault: str) -> tuple[int, int]:
    """Costs of keeping and of changing the role of a row with this fault; blank and duplicate rows can only go."""
    if fault in "bd":
        return _FAR, _FAR
    more = TRUNCATED if fault == "t" else 0
    return KEEP + more, REROLE + more


def distances(initials: str, faults: str, ends: Iterable[int]) -> list[int]:
    """For each node 4 * row + state the least cost from there to the end of the rows and on: `ends` are the costs behind it.

    Dial's algorithm backwards from the ends: a ring of buckets, one a distance, which suffices since no arc costs more than
    the ring is long; a node is settled when its bucket comes up.
    """
    n = len(initials)
    dist = [_FAR] * (4 * n) + list(ends)
    low, high = min(dist[4 * n :]), max(d for d in dist[4 * n :] if d < _FAR)
    ring: list[list[int]] = [[] for _ in range(max(_LARGEST, high - low) + 1)]
    waiting = 0
    for s in range(4):
        if dist[4 * n + s] < _FAR:
            ring[dist[4 * n + s] % len(ring)].append(4 * n + s)
            waiting += 1
    now = low
    while waiting:
        bucket = ring[now % len(ring)]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != now:
                continue
            i, s = divmod(node, 4)
            before = []
            if i < n:
                before += [(4 * i + p, INSERT) for p in range(4) if NEXT[p] == s]
            if i:
                at = 4 * (i - 1)
                keep, rerole = _costs(faults[i - 1])
                before.append((at + s, DELETE))
                if rerole < _FAR:
                    before += [(at + p, rerole) for p in range(4) if NEXT[p] == s]
                    before += [(at + p, keep) for p in range(4) if kept_state(p, initials[i - 1]) == s]
            for other, cost in before:
                if now + cost < dist[other]:
                    dist[other] = now + cost
                    ring[(now + cost) % len(ring)].append(other)
                    waiting += 1
        now += 1
    return dist


def walk(initials: str, faults: str, dist: list[int], state: int) -> tuple[list[tuple[list[int], str, int]], int]:
    """The path with the least letters from a state: for each row (states of turns inserted before it, letter, state after it),
    and the last state. At each node it takes the first letter, by ASCII, whose arc is tight."""
    out, i, inserted = [], 0, []
    while i < len(initials):
        here = dist[4 * i + state]
        keep, rerole = _costs(faults[i])
        kept = kept_state(state, initials[i])
        if here == DELETE + dist[4 * i + 4 + state]:
            letter = "D"
        elif here == INSERT + dist[4 * i + NEXT[state]]:
            state = NEXT[state]
            inserted.append(state)
            continue
        elif kept is not None and here == keep + dist[4 * i + 4 + kept]:
            letter, state = "K", kept
        else:
            assert here == rerole + dist[4 * i + 4 + NEXT[state]], "a node has no tight arc"
            letter, state = "R", NEXT[state]
        out.append((inserted, letter, state))
        i, inserted = i + 1, []
    return out, state


def ending(state: int) -> list[int]:
    """States of the turns inserted behind the last row."""
    out = []
    while END[state]:
        state = NEXT[state]
        out.append(state)
    return out


def _stream(df: DataFrame, run: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, rows_at_once: int = 256) -> DataFrame:
    """Run a generator over the rows of each partition, in their order."""
    out = T.StructType.fromDDL(schema)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        slices = (b.slice(at, rows_at_once) for b in batches for at in range(0, b.num_rows, rows_at_once))
        rows = run(row for b in slices for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        while part := list(islice(rows, rows_at_once)):
            columns = [pa.array(c, type=f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        tidy()

    return df.mapInArrow(mapped, out)


def _conv_key(conv: Column) -> Column:
    """A text that is equal for equal ids only, and that null has too."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of conversations after damage that crc32(`conv_id:turn`) % 20 decides.

    0 drops the row, 1 empties its text, 2 takes its `[.!?]` out, 3 repeats it (copies 2), 4 makes it a user's. Nulls in a role, a
    text or the key count as one space.
    """
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"]).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(spaced["text"], ".!?", "")).otherwise(spaced["text"])
    made = rows.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(spaced["role"]).alias("role"), text.alias("text"),
        F.when(fate == 3, 2).otherwise(1).alias("copies"), fate.alias("_fate"),
    )
    return made.where(F.col("_fate") != 0).drop("_fate")


def _light(rows: DataFrame) -> DataFrame:
    """(_conv, turn, role, _h, n, initial, fault): distinct rows without their texts, and how often each is there.

    Whether a row was seen earlier is the least turn of its role and text against its own; both are sums with partial ones
    before the exchange, so neither a long conversation nor a frequent row meets in one task.
    """
    rest = F.rtrim("text", F.lit(SPACE))
    known = rows.groupBy("_conv", "turn", "role", "_h").agg(
        F.sum("copies").alias("n"), F.max(rest == "").alias("_blank"), F.max(~F.right(rest, F.lit(1)).isin(".", "!", "?")).alias("_cut")
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = known.groupBy("_conv", "role", "_h").agg(F.min(place).alias("_first"))
    found = known.join(first, ["_conv", "role", "_h"])
    later = ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    fault = F.when(F.col("_blank"), "b").when(later, "d").when(F.col("_cut"), "t").otherwise("k")
    initial = F.substring("role", 1, 1)
    return found.select("_conv", "turn", "role", "_h", "n", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"), fault.alias("fault"))


def _pack(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Blocks of at most ROWS_AT_ONCE neighbouring rows of a conversation, from rows in order.

    A block is open where its conversation may go on in another block: behind a full one, and at a partition's ends.
    """
    part, no, held, conv, opened, first = TaskContext.get().partitionId(), 0, [], None, False, True

    def block(open_end: bool) -> tuple:
        turns, roles, hashes, counts, initials, faults = map(list, zip(*held, strict=True))
        return part, no, conv, opened or first or open_end, "".join(initials), "".join(faults), counts, turns, roles, hashes

    for row in rows:
        if held and row[0] != conv:
            yield block(False)
            no, held, opened, first = no + 1, [], False, False
        elif len(held) == ROWS_AT_ONCE:
            yield block(True)
            no, held, opened, first = no + 1, [], True, False
        conv = row[0]
        held.append(row[1:])
    if held:
        yield block(True)


_BLOCK = (
    "part int, no int, _conv string, open boolean, initials string, faults string, counts array<long>, turns array<long>, "
    "roles array<string>, hashes array<binary>"
)


def _blocks(rows: DataFrame) -> DataFrame:
    """All rows by conversation and turn, as stored blocks: a long conversation lies in many, over several tasks."""
    order = ["_conv", "turn", "role", "_h"]
    dealt = _light(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(_stream(dealt.select("_conv", "turn", "role", "_h", "n", "initial", "fault"), _pack, _BLOCK, 4096), "turn-blocks")


def _joined(opened: DataFrame) -> DataFrame:
    """(part, no, entry, ends, last) of open blocks: the state that each is entered in and the costs behind its end.

    Blocks give their costs from each state to each, these are summed up backwards over a conversation's blocks; with them each
    block knows where its walk from each state ends, and these maps are followed forwards. A group holds a few numbers a block.
    """

    def through(rows):
        for part, no, conv, initials, faults in rows:
            ways = [distances(initials, faults, [0 if s == end else _FAR for s in range(4)])[:4] for end in range(4)]
            yield part, no, conv, [min(ways[end][s], _FAR) for s in range(4) for end in range(4)]

    def backwards(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "no"], ascending=False)
        ends, out = list(END), []
        for row in group.itertuples(index=False):
            out.append((row.part, row.no, row._2, list(ends), len(out) == 0))
            ends = [min(int(row.ways[4 * s + e]) + ends[e] for e in range(4)) for s in range(4)]
        return pd.DataFrame(out, columns=["part", "no", "_conv", "ends", "last"])

    def exits(rows):
        for part, no, conv, initials, faults, ends, last in rows:
            dist = distances(initials, faults, ends)
            yield part, no, conv, ends, last, [walk(initials, faults, dist, s)[1] for s in range(4)]

    def forwards(group: pd.DataFrame) -> pd.DataFrame:
        group, state, entry = group.sort_values(["part", "no"]), E, []
        for leaves in group["exits"]:
            entry.append(state)
            state = int(leaves[state])
        return group.assign(entry=entry)[["part", "no", "entry", "ends", "last"]]

    rows = opened.select("part", "no", "_conv", "initials", "faults")
    ways = _stream(rows, through, "part int, no int, _conv string, ways array<long>")
    behind = ways.groupBy("_conv").applyInPandas(backwards, "part int, no int, _conv string, ends array<long>, last boolean")
    left = _stream(
        rows.join(behind.drop("_conv"), ["part", "no"]).select("part", "no", "_conv", "initials", "faults", "ends", "last"),
        exits, "part int, no int, _conv string, ends array<long>, last boolean, exits array<int>",
    )
    return left.groupBy("_conv").applyInPandas(forwards, "part int, no int, entry int, ends array<long>, last boolean")


def _decided(blocks: DataFrame) -> DataFrame:
    """Blocks with their audit, cost, figures and, a row of theirs, what to write before it, as it and behind it."""
    closed = blocks.where(~F.col("open")).withColumns({"entry": F.lit(E), "ends": F.array(*[F.lit(c).cast("long") for c in END]), "last": F.lit(True)})
    opened = blocks.where("open")
    names = ["part", "no", "_conv", "initials", "faults", "counts", "turns", "roles", "hashes", "entry", "ends", "last"]
    every = closed.select(*names).unionByName(opened.join(_joined(opened), ["part", "no"]).select(*names))

    def decide(rows):
        for part, no, conv, initials, faults, counts, turns, roles, hashes, entry, ends, last in rows:
            dist = distances(initials, faults, ends)
            path, state = walk(initials, faults, dist, entry)
            more = ending(state) if last else []
            letters, lines = [], []
            for k, (inserted, letter, after) in enumerate(path):
                letters += ["I" * len(inserted), letter, "D" * (counts[k] - 1)]
                role = None if letter == "D" else roles[k] if letter == "K" else ROLE[after]
                if inserted or role is not None:
                    lines.append({"turn": turns[k], "role": roles[k], "_h": hashes[k], "before": [ROLE[s] for s in inserted], "as_role": role, "behind": []})
            if more:
                letters.append("I" * len(more))
                lines.append({"turn": turns[-1], "role": roles[-1], "_h": hashes[-1], "before": [], "as_role": None, "behind": [ROLE[s] for s in more]})
            extra = sum(counts) - len(counts)
            known = [t for t in turns if t is not None]
            faulty = {f: sum(1 for g in faults if g == f) for f in "bdt"}
            blank_copies = sum(c - 1 for c, f in zip(counts, faults, strict=True) if f == "b")
            illegal = extra + sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))
            cost = dist[entry] - ends[state] + DELETE * extra + (END[state] if last else 0)
            yield (
                part, no, conv, "".join(letters), cost, faulty["b"] + blank_copies, faulty["d"] + extra - blank_copies, faulty["t"],
                illegal, initials[0], initials[-1], known[0] if known else None, known[-1] if known else None, len(set(known)), lines,
            )

    line = "array<struct<turn: bigint, role: string, _h: binary, before: array<string>, as_role: string, behind: array<string>>>"
    return _stream(
        every, decide,
        "part int, no int, _conv string, audit string, cost long, blank long, duplicate long, truncated long, illegal long, first string, "
        f"final string, low long, high long, distinct long, lines {line}", 64,
    )


def _audits(decided: DataFrame) -> DataFrame:
    """One row a conversation from its blocks, what lies on the border of two blocks included."""
    sums = ["cost", "blank", "duplicate", "truncated"]
    fields = ["part", "no", "audit", "illegal", "first", "final", "low", "high", "distinct"]
    found = decided.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_b"), *[F.sum(c).alias(c) for c in sums])
    n = F.size("_b")
    borders = F.arrays_zip(F.slice("_b", 1, n - 1).alias("l"), F.slice("_b", 2, n - 1).alias("r"))
    wrong = F.filter(borders, lambda p: ~F.concat(p["l"]["final"], p["r"]["first"]).isin("su", "ua", "au"))
    same = F.filter(borders, lambda p: p["l"]["high"] == p["r"]["low"])

    def total(c: str) -> Column:
        return F.aggregate("_b", F.lit(0).cast("long"), lambda acc, b: acc + b[c])

    low, high = F.array_min(F.transform("_b", lambda b: b["low"])), F.array_max(F.transform("_b", lambda b: b["high"]))
    return found.select(
        "_conv", F.coalesce(high - low + 1 - (total("distinct") - F.size(same)), F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        (total("illegal") + F.size(wrong)).alias("illegal"), "cost", F.array_join(F.transform("_b", lambda b: b["audit"]), "").alias("audit"),
    )


_TURNS = "_conv string, place long, role string, text string"


def _rewritten(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """(_conv, place, role, text): the repaired turns, by conversation and place within each partition.

    Texts move once: a row's text and what to do with it come by the same key, sorted, and are merged as they pass.
    """
    key = ["_conv", "turn", "role", "_h"]
    empty = F.array().cast("array<string>")
    said = decided.select("_conv", F.inline("lines")).select(*key, F.lit(0).alias("kind"), "before", "as_role", "behind", F.lit(None).cast("string").alias("text"))
    texts = rows.select(*key, F.lit(1).alias("kind"), empty.alias("before"), F.lit(None).cast("string").alias("as_role"), empty.alias("behind"), "text")
    # `behind` closes a conversation: it is on a line of its own for the last row, so it sorts behind that row's text.
    last = F.when(F.size("behind") > 0, 2).otherwise(F.col("kind"))
    both = said.withColumn("kind", last).unionByName(texts).repartition("_conv").sortWithinPartitions(*key, "kind")

    def merge(stream):
        conv, place, wanted = None, 0, None
        for c, turn, role, h, kind, before, as_role, behind, text in stream:
            if c != conv:
                conv, place, wanted = c, 0, None
            if kind == 1:
                if wanted and wanted[0] == (turn, role, h):
                    yield conv, place, wanted[1], text
                    place, wanted = place + 1, None
                continue
            for inserted in (*before, *behind):
                yield conv, place, inserted, ""
                place += 1
            wanted = ((turn, role, h), as_role) if as_role is not None else None

    return _stream(both.select(*key, "kind", "before", "as_role", "behind", "text"), merge, _TURNS)


def _digests(turns: DataFrame) -> DataFrame:
    """(_conv, repaired_sha256) of turns that come by conversation and place: a running hash, so no conversation is held."""

    def run(stream):
        conv, digest = None, None
        for c, place, role, text in stream:
            if digest is None or c != conv:
                if digest is not None:
                    yield conv, digest.hexdigest()
                conv, digest = c, hashlib.sha256()
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if digest is not None:
            yield conv, digest.hexdigest()

    return _stream(turns, run, "_conv string, repaired_sha256 string")


def _plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their keys, and their decided blocks."""
    kind = dict(rows.dtypes)
    copies = F.col("copies") if "copies" in kind else F.lit(1)
    body, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    keyed = rows.select(
        "conv_id", _conv_key(F.col("conv_id")).alias("_conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), body.alias("text"),
        copies.cast("long").alias("copies"), F.unhex(F.md5(body.cast("binary"))).alias("_h"),
    )
    return keyed, stored(_decided(_blocks(keyed)), "turn-repairs")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, turn by turn; see repair_conversations."""
    keyed, decided = _plan(rows)
    ids = keyed.select("_conv", "conv_id").distinct()
    return _rewritten(keyed, decided).join(ids, "_conv").select("conv_id", "place", "role", "text")


def repair_conversations(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row a conversation.

    `rows` has conv_id, turn, role, text and optionally copies (how often the row stands there). `every` may name conversations
    (conv_id) that have no rows left: they get zeros, an empty audit and the hash of nothing.

    Rows are taken by turn, nulls first; those that share a turn by role and then by the MD5 of their texts. The rows of a
    conversation may lie in any number of blocks: blocks are solved apart and joined by costs and states, so that no task holds
    a conversation. Its audit and its hash are one value each and are written by one task, the hash as turns pass by.

    Nulls: a null role or text is one space, a null turn no part of the gaps, null ids are one conversation. Repeated rows are
    duplicates, ties between audits of equal cost go to the ASCII-least. Texts of any length move once; an empty table gives no
    rows; extra columns are not read.
    """
    keyed, decided = _plan(rows)
    ids = keyed.select("conv_id", "_conv")
    if every is not None:
        ids = ids.unionByName(every.select("conv_id", _conv_key(F.col("conv_id")).alias("_conv")))
    ids = ids.distinct()
    out = ids.join(_audits(decided), "_conv", "left").join(_digests(_rewritten(keyed, decided)), "_conv", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
