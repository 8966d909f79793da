"""Byte-level BPE by rounds over padded matrices: encoding of whole texts, and decoding."""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_rows

_NONE = np.int32(2**31 - 1)  # the rank of a pair that does not merge


class PairTable:
    """The rank of the token that two tokens make, in an open-addressing hash table over numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(rank)).bit_length())  # at most a quarter full
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        key = self._key(left, right)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            take = free[first]
            self.keys[slot[take]], self.ranks[slot[take]] = key[take], rank[take]
            rest = np.ones(len(key), bool)
            rest[take] = False
            key, rank, slot = key[rest], rank[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = (key ^ (key >> 29)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of flat arrays of pairs; _NONE where two tokens make none, or one of them is padding (-1)."""
        out = np.full(len(left), _NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = self._key(left[at], right[at])
        slot = self._slot(key)
        while len(at):
            found = self.keys[slot]
            hit = found == key
            out[at[hit]] = self.ranks[slot[hit]]
            go = ~hit & (found >= 0)
            at, key, slot = at[go], key[go], (slot[go] + 1) & (len(self.keys) - 1)
        return out


class BytePairEncoder:
    """Encodes and decodes by a file of ranks (a base64 token and its rank a line).

    A text falls into the matches of `pattern`; a match that is a token is that token, any other starts as its bytes and
    merges, always the leftmost pair of the least rank, until no pair makes a token. Matches of like length are the rows of
    one padded matrix, in which every row merges once a round; rows that are done leave it, and it narrows by a column a
    round. Matches of more than `widest` bytes (runs of one kind of character) would need as many rounds as they have bytes:
    they merge in the same order from a heap, in n log n steps.
    """

    widest = 512
    cells = 1 << 18  # of one matrix
    remembered = 1 << 17  # matches whose ids are kept for later texts
    at_once = 1 << 20  # characters that are split before their matches are encoded

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f) if word}
        self.pattern = regex.compile(pattern)
        self.tokens = {rank: word for word, rank in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (self.ranks[word[:k]], self.ranks[word[k:]], rank)
            for word, rank in self.ranks.items() for k in range(1, len(word)) if word[:k] in self.ranks and word[k:] in self.ranks
        ]
        self.pairs = PairTable(*np.array(pairs, np.int32).reshape(-1, 3).T)
        self.known: dict[str, bytes] = {}

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit bytes."""
        out = [b""] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if (rank := self.ranks.get(word)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(word) > self.widest:
                out[i] = self._merge_long(word)
            elif word:
                buckets.setdefault((len(word) + 3) // 4 * 4, []).append(i)
        for width, members in buckets.items():
            rows = max(1, self.cells // width)
            for at in range(0, len(members), rows):
                part = members[at : at + rows]
                for i, ids in zip(part, self._merge_rows([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """The rounds over one matrix: a word a row, -1 behind its end."""
        size = np.array([len(w) for w in words])
        flat = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = flat
        rank = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), width - 1)
        row, done = np.arange(len(words)), [b""] * len(words)
        while len(row):
            best = rank.argmin(axis=1)
            value = rank[np.arange(len(row)), best]
            over = value == _NONE
            for r, line in zip(row[over], ids[over].astype("<u4"), strict=True):
                done[r] = line[: size[r]].tobytes()
            row, ids, rank, best, value = row[~over], ids[~over], rank[~over], best[~over], value[~over]
            if not len(row):
                break
            lines = np.arange(len(row))
            ids[lines, best] = value
            # Close the gap behind each merge; only the two pairs that touch the new token have new ranks.
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > best[:, None]), axis=1)
            columns = np.arange(rank.shape[1] - 1)
            rank = np.take_along_axis(rank, columns + (columns >= best[:, None]), axis=1)
            size[row] -= 1
            for at in (best - 1, best):
                inside = (at >= 0) & (at < rank.shape[1])
                r, c = lines[inside], at[inside]
                rank[r, c] = self.pairs(ids[r, c], ids[r, c + 1])
            if not rank.shape[1]:
                for r, line in zip(row, ids.astype("<u4"), strict=True):
                    done[r] = line[: size[r]].tobytes()
                break
        return done

    def _merge_long(self, word: bytes) -> bytes:
        """The same merges over a linked list and a heap of (rank, position)."""
        part = self.byte[np.frombuffer(word, np.uint8)]
        n = len(part)
        ranks = self.pairs(part[:-1], part[1:])
        heap = [(int(ranks[i]), int(i)) for i in np.flatnonzero(ranks != _NONE)]
        heapq.heapify(heap)
        ids, rank = part.tolist(), [*ranks.tolist(), int(_NONE)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        text = self.tokens

        def renew(i: int) -> None:
            j = after[i]
            rank[i] = int(_NONE) if j >= n else self.ranks.get(text[ids[i]] + text[ids[j]], int(_NONE))
            if rank[i] != _NONE:
                heapq.heappush(heap, (rank[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank[i] != r:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            renew(i)
            if before[i] >= 0:
                renew(before[i])
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _matches(self, text: str) -> Iterator[list[str]]:
        """The matches of a text, lists of bounded length one after the other."""
        if len(text) <= self.at_once:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while part := [m.group() for m in islice(found, self.at_once // 4)]:
            yield part

    def _ids(self, lists: list[list[str]]) -> Iterator[bytes]:
        new = list(set().union(*lists) - self.known.keys())
        made = dict(zip(new, self.encode_words([w.encode() for w in new]), strict=True))
        if len(self.known) + len(made) > self.remembered:
            self.known = {w: self.known[w] for w in set().union(*lists) & self.known.keys()}
        self.known |= made
        for words in lists:
            yield b"".join([self.known[w] for w in words])

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text; texts share matrices as long as they have at most `at_once` characters together."""
        held, size = [], 0
        for text in texts:
            if size + len(text) > self.at_once and held:
                yield from self._ids(held)
                held, size = [], 0
            if len(text) > self.at_once:
                yield b"".join(b"".join(self._ids([part])) for part in self._matches(text))
            else:
                held += self._matches(text)
                size += len(text)
        yield from self._ids(held)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; an id that no token has raises KeyError."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    return BytePairEncoder(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_tokens, ids): the ids of every whole text as little-endian unsigned 32-bit integers.

    A map: nothing is shuffled, and a task holds the matches of about a million characters at a time, whatever a text's
    length. Nulls: a null text is empty and has no ids; a null id stays null. Repeated rows are encoded each, an empty table
    gives no rows, extra columns are not read. Ties between pairs of equal rank go to the leftmost. Special tokens are not
    known here: their strings are ordinary text.
    """

    def start():
        own = encoder(path, pattern)

        def kernel(cols):
            for doc_id, ids in zip(cols[0], own.encode(t or "" for t in cols[1]), strict=True):
                yield doc_id, len(ids) // 4, ids

        return kernel

    kind = docs.schema[doc].dataType.simpleString()
    return map_rows(docs, [doc, text], start, f"`{doc}` {kind}, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, path: str, pattern: str, doc: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc, n_tokens, ids, decoded): the bytes that ids stand for. Null ids decode to nothing; unknown ones fail the job."""

    def start():
        own = encoder(path, pattern)

        def kernel(cols):
            for doc_id, n, row in zip(*cols, strict=True):
                yield doc_id, n, row, own.decode(row or b"")

        return kernel

    kind = encoded.schema[doc].dataType.simpleString()
    return map_rows(encoded, [doc, "n_tokens", ids], start, f"`{doc}` {kind}, n_tokens long, `{ids}` binary, decoded binary")
