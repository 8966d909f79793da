"""Benchmark decontamination: Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, discard, map_rows, stored
from .minhash import U64, mix

#: Bytes that part words, and A-Z, which are lowered. All other bytes (0-9, a-z and those of non-ASCII) stay.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lowered, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """Search for word sequences of one length m. Words count by their numbers (1 and up; 0 is a word that no pattern
    holds), and only words at which the window stops are looked up.

    A pattern is a place in `text`, the patterns' texts as one list of numbers. table: for the block of words (two, or one
    where m is 1) at the window's end, how far the window may move; a block that no pattern holds lets it pass
    m - block + 1 words. Blocks that end a pattern may not move: they stand with -(bucket + 1), and their bucket lists the
    places of the patterns with that suffix; direct comparison confirms an occurrence.
    """

    def __init__(self, text: list[int], places: np.ndarray, m: int, base: int) -> None:
        self.text, self.m, self.base, self.block = text, m, base, min(2, m)
        self.far = m - self.block + 1
        ids = np.asarray(text, np.int64)
        key = (lambda at: ids[at - 1] * base + ids[at]) if self.block == 2 else (lambda at: ids[at])
        self.table: dict[int, int] = {}
        for end in range(self.block, m):  # far blocks first, so that nearer ones overwrite them
            self.table.update(dict.fromkeys(np.unique(key(places + end - 1)).tolist(), m - end))
        # One place a distinct pattern, by its suffix; the places of equal patterns follow it.
        words = sum(ids[places + i] * (mix(np.asarray([i + 11], U64))[0].astype(np.int64) | 1) for i in range(m))
        suffix = key(places + m - 1)
        order = np.lexsort((places, words, suffix))
        places, suffix, words = places[order], suffix[order], words[order]
        fresh = np.ones(len(places), bool)
        same = np.flatnonzero((words[1:] == words[:-1]) & (suffix[1:] == suffix[:-1])) + 1
        if len(same):
            equal = np.ones(len(same), bool)
            for i in range(m):
                equal &= ids[places[same] + i] == ids[places[same - 1] + i]
            fresh[same[equal]] = False
        self.copies = places
        self.distinct = np.append(np.flatnonzero(fresh), len(places))
        starts = np.flatnonzero(np.append(True, np.diff(suffix[self.distinct[:-1]]) != 0)) if len(places) else np.zeros(0, np.int64)
        self.bounds = np.append(starts, len(self.distinct) - 1).tolist()
        self.heads = places[self.distinct[:-1]].tolist()
        for k, v in enumerate(suffix[self.distinct[:-1]][starts].tolist() if len(places) else []):
            self.table[v] = -k - 1

    def find(self, words: list[bytes], number: dict[bytes, int]) -> Iterator[tuple[int, int]]:
        """(start, number of the distinct pattern) of every occurrence, by rising start."""
        one = number.get
        m, far, step_of, base, text, n = self.m, self.far, self.table.get, self.base, self.text, len(words)
        two, at = self.block == 2, self.m - 1
        while at < n:
            key = one(words[at])
            if key is None:  # no window may hold a word that no pattern has
                at += m
                continue
            if two:
                key += one(words[at - 1], 0) * base
            step = step_of(key, far)
            if step > 0:
                at += step
                continue
            start = at - m + 1
            window = [one(w, 0) for w in words[start : at + 1]]
            for p in range(self.bounds[-step - 1], self.bounds[-step]):
                place = self.heads[p]
                if text[place : place + m] == window:
                    yield start, p
            at += 1

    def places(self, pattern: int) -> list[int]:
        """Places of all copies of a distinct pattern."""
        return self.copies[self.distinct[pattern] : self.distinct[pattern + 1]].tolist()


class Searcher:
    """A block of benchmark items: their words as numbers, and a WuManber for each pattern length (full windows, and
    items of fewer words as one window each)."""

    def __init__(self, items: list[tuple[int, str]], window: int) -> None:
        self.number: dict[bytes, int] = {}
        self.items, self.begins, self.text = [], [], []
        by_length: dict[int, list[np.ndarray]] = {}
        for item, body in items:
            words = words_of(body)
            if words:
                begin = len(self.text)
                self.items.append(item)
                self.begins.append(begin)
                self.text += [self.number.setdefault(w, len(self.number) + 1) for w in words]
                m = min(window, len(words))
                by_length.setdefault(m, []).append(np.arange(begin, begin + len(words) - m + 1))
        self.each = [WuManber(self.text, np.concatenate(p), m, len(self.number) + 1) for m, p in sorted(by_length.items())]

    def __call__(self, text: str | None) -> tuple[int, list[list[int]], list[int]]:
        """(word count, merged [start, end) word ranges inside occurrences, ids of the items found)."""
        words, spans, found = words_of(text), [], set()
        for one in self.each:
            seen = set()
            for start, pattern in one.find(words, self.number):
                spans.append((start, start + one.m))
                seen.add(pattern)
            for p in seen:
                found.update(self.items[bisect_right(self.begins, x) - 1] for x in one.places(p))
        return len(words), _merged(spans), sorted(found)


#: The searcher of this Python worker: one block at a time, whatever the number of tasks and passes it runs.
_HELD: dict[str, Searcher] = {}


def _searcher(token: str, items: list[tuple[int, str]], window: int) -> Searcher:
    if token not in _HELD:
        _HELD.clear()
        _HELD[token] = Searcher(items, window)
    return _HELD[token]


def search(text: str | None, items: list[tuple[int, str]], window: int) -> tuple[int, list[list[int]], list[int]]:
    """One text against the items, as Searcher gives it."""
    return Searcher(items, window)(text)


def _merged(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(bench: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark (i, t) in blocks of about block_bytes each, one at a time (a longer item is a block of its own)."""
    block: list[tuple[int, str]] = []
    held = 0
    for r in bench.toLocalIterator():
        if held and held + len(r.t) > block_bytes:
            yield block
            block, held = [], 0
        block.append((r.i, r.t))
        held += len(r.t)
    yield block


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_bytes: int = 6_000_000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc, *keep, n_words, n_hit, hits, items) for every row: words in all, words inside any occurrence of a
    benchmark window, the merged word ranges hit, and the sorted ids of items with an occurring window.

    A benchmark of one block is searched in one pass over the documents, which are not shuffled. A larger one takes a
    pass a block: the rows are stored once with a number, each pass adds its hits by row number to one table, and passes
    follow each other, so a Python worker, like the driver, holds one block however large the benchmark is (some 40
    bytes of tables a byte of benchmark were measured, 230 MB for a block of 6 MB). Hits of a row then meet by its number and are merged.

    Nulls: a null or empty text has no words, no hits; an item with null text or no words has no window; an item
    with a null id is left out. Repeated rows and repeated items each count as they stand. Items of fewer words
    than the window are one window. Texts are searched whole, whatever their length. An empty benchmark hits nothing;
    empty documents give no rows. Extra columns are ignored unless named in `keep` (kept columns with the results'
    names give way).
    """
    keep = tuple(c for c in keep if c not in ("n_words", "n_hit", "hits", "items"))
    held = list(dict.fromkeys([doc, *keep]))
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    ddl = ", ".join(f"`{c}` {types[c]}" for c in held)
    bench = benchmark.select(F.col(item).alias("i"), F.coalesce(item_text, F.lit("")).alias("t")).where(F.col("i").isNotNull())
    results = "_n long, _spans array<array<long>>, _found array<long>"
    blocks = _blocks(bench, block_bytes)
    block = next(blocks)
    following = next(blocks, None)

    def start_with(block, sparse: bool):
        token = uuid.uuid4().hex

        def start():
            look = _searcher(token, block, window)

            def kernel(cols):
                for *own, body in zip(*cols, strict=True):
                    n, spans, found = look(body)
                    if spans or not sparse:
                        yield (*own, n, spans, found)

            return kernel

        return start

    source = docs.select(*held, F.col(text).alias("_body"))
    if following is None:
        out = map_rows(source, [*held, "_body"], start_with(block, False), f"{ddl}, {results}")
    else:
        numbered = stored(source.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        hits, sparse = None, False
        while block is not None:
            found = map_rows(numbered, ["_row", "_body"], start_with(block, sparse), f"_row long, {results}")
            hits, sparse = added(found, hits, "hits"), True
            block, following = following, next(blocks, None) if following is not None else None
        each = hits.groupBy("_row").agg(F.max("_n").alias("_n"), F.flatten(F.collect_list("_spans")).alias("_spans"), F.flatten(F.collect_list("_found")).alias("_found"))

        def start():
            def kernel(cols):
                for row, n, spans, found in zip(*cols, strict=True):
                    yield row, n, _merged(spans), sorted(set(found))

            return kernel

        merged = stored(map_rows(each, ["_row", "_n", "_spans", "_found"], start, f"_row long, {results}"), "merged")
        discard(hits)
        out = numbered.drop("_body").join(merged, "_row")
    return out.select(
        *held,
        F.col("_n").alias("n_words"),
        F.aggregate("_spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0]).alias("n_hit"),
        F.col("_spans").alias("hits"),
        F.col("_found").alias("items"),
    )


def items_digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
