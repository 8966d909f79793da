"""Word-shingle hashing and minima of universal hash functions, vectorised in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**64, 256, dtype=U64)
for _b in range(0x41, 0x5B):
    _BYTE[_b] = _BYTE[_b + 32]
_PART = np.zeros(256, bool)
_PART[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_PART] = 0
_STEP = _rng.integers(0, 2**63, 1, dtype=U64)[0] * U64(2) + U64(1)
_MIX = [U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on every input bit."""
    x = (x ^ (x >> U64(30))) * _MIX[0]
    x = (x ^ (x >> U64(27))) * _MIX[1]
    return x ^ (x >> U64(31))


_powers = np.cumprod(np.full(1 << 12, _STEP, U64))
_SEGMENT = 1 << 17
_back = np.cumprod(np.append(U64(1), np.full(_SEGMENT, pow(int(_STEP), -1, 1 << 64), U64)))


def _power(n: int) -> np.ndarray:
    """Powers of an odd base, modulo 2^64, for word positions up to n."""
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(2 * n, _STEP, U64))
    return _powers


def _cuts(body: bytes, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `size` bytes that end at a word's end."""
    at, parts = 0, _PART
    while at < len(body):
        end = min(len(body), at + size)
        while end < len(body) and not parts[body[end]]:
            end += 1
        yield at, end
        at = end


def word_spans(body: bytes, segment: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word [^\\x20\\x09-\\x0D]+ of UTF-8 text, A-Z as a-z; positions are bytes."""
    hashes, begins, ends = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in _cuts(body, segment):
        chars = np.frombuffer(body, np.uint8, b - a, a)
        inside = ~_PART[chars]
        starts = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0) == 1)
        if not len(starts):
            continue
        lengths = np.add.reduceat(inside, starts, dtype=np.int64)
        begins.append(starts + a)
        ends.append(starts + a + lengths)
        chars, starts = chars[starts[0] :], starts - starts[0]
        at = np.arange(len(chars)) - np.repeat(starts, np.diff(starts, append=len(chars)))
        hashes.append(mix(np.add.reduceat(_BYTE[chars] * _power(int(at.max()) + 1)[at], starts) + lengths.astype(U64)))
    return np.concatenate(hashes), np.concatenate(begins), np.concatenate(ends)


def words_of_texts(
    raw: np.ndarray, bounds: np.ndarray, hashed: bool = True, segment: int = _SEGMENT
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_spans of many texts at once: text i is raw[bounds[i] : bounds[i + 1]], positions are in raw. Without
    `hashed` there are positions only.

    A word's hash is a difference of two prefix sums, moved back to the word's start by an inverse power. Words are
    hashed that begin within `segment` (at most _SEGMENT) bytes of each other, so that the sums stay small.
    """
    inside = ~((raw == 0x20) | (raw - np.uint8(0x09) < 5))
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    filled = np.diff(bounds) > 0
    for marks, at in ((begins, bounds[:-1][filled]), (stops, bounds[1:][filled] - 1)):
        marks[at] = inside[at]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    if not hashed:
        return np.zeros(0, U64), starts, ends
    hashes, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        a = starts[i]
        j = int(np.searchsorted(starts, a + segment))
        chars = raw[a : ends[j - 1]]
        sums = np.zeros(len(chars) + 1, U64)
        np.cumsum(_BYTE[chars] * _power(len(chars))[: len(chars)], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        hashes[i:j] = mix((sums[e] - sums[s]) * _back[s] + (e - s).astype(U64))
        i = j
    return hashes, starts, ends


def word_hashes(body: bytes, segment: int = 1 << 20) -> np.ndarray:
    return word_spans(body, segment)[0]


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes of `width` words in a row, sorted; a shorter text is one shingle, no words are none."""
    n = len(words)
    if not n:
        return words
    k = min(n, width)
    place = mix(np.arange(1, k + 1, dtype=U64)) | U64(1)
    total = np.full(n - k + 1, U64(k), U64)
    for i in range(k):
        total += words[i : n - k + 1 + i] * place[i]
    return np.unique(mix(total))


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    a = mix(s + U64(0x9E3779B97F4A7C15)).sum(dtype=U64)
    b = mix(s ^ U64(0xD1B54A32D192ED03)).sum(dtype=U64)
    return int(a.view(np.int64)), int(b.view(np.int64))


class Signer:
    """Minima of bands * rows strongly universal functions x -> (a x + b mod 2^64) >> 32 of 32-bit x."""

    def __init__(self, bands: int, rows: int, seed: int = 1) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bands, self.rows, k = bands, rows, bands * rows
        self.a = rng.integers(0, 2**64, k, dtype=U64) | U64(1)
        self.b = rng.integers(0, 2**64, k, dtype=U64)
        self.fold = rng.integers(0, 2**64, (bands, rows), dtype=U64) | U64(1)
        self.tag = mix(np.arange(bands, dtype=U64) + U64(77))
        self.buffer = np.empty((128, k), U64)

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, bytes]:
        """(one 64-bit key for each band, one byte for each minimum) of a non-empty set."""
        least = np.full(len(self.a), np.iinfo(U64).max, U64)
        x = s >> U64(32)
        for at in range(0, len(x), 128):
            part = x[at : at + 128, None]
            own = self.buffer[: len(part)]
            np.multiply(part, self.a, out=own)
            own += self.b
            np.minimum(least, own.min(axis=0), out=least)
        least >>= U64(32)
        keys = mix((least.reshape(self.bands, self.rows) * self.fold).sum(axis=1, dtype=U64) + self.tag)
        return keys.view(np.int64), (least & U64(255)).astype(np.uint8).tobytes()


def spanning_links(sets: list[np.ndarray], labels: np.ndarray, percent: int, among: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) with 100 * intersection >= percent * union that join the labels of all linked sets.

    Every pair of sets with different labels is compared exactly, but for pairs that earlier links have joined
    already and pairs whose sizes rule a link out. So the result is a spanning forest, never all pairs. `among`
    marks the sets of which one must be in a pair (None: any pair).
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if m < 2:
        return []
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    own = np.zeros(int(ids.max()) + 1, bool)
    labels, links = labels.copy(), []
    for i in range(m) if among is None else np.flatnonzero(among):
        fits = (labels != labels[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        if among is None:
            fits[: i + 1] = False
        others = np.flatnonzero(fits)
        if not len(others):
            continue
        mine = ids[starts[i] : starts[i] + sizes[i]]
        own[mine] = True
        n = sizes[others]
        first = np.cumsum(n) - n
        gather = np.repeat(starts[others] - first, n) + np.arange(int(n.sum()))
        shared = np.add.reduceat(own[ids[gather]], first, dtype=np.int64)
        own[mine] = False
        for j in others[100 * shared >= percent * (n + sizes[i] - shared)]:
            if labels[j] != labels[i]:
                labels[labels == labels[j]] = labels[i]
                links.append((int(i), int(j)))
    return links
