"""Substring dedup: runs of several consecutive sentences, and runs of words chosen by the words themselves, are hashed;
later copies of a run lose their sentences or words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, tidy
from .minhash import U64, mix, words_of_texts

_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True
_CLOSERS = np.zeros(256, bool)
_CLOSERS[[ord(c) for c in "\"')]"]] = True

#: Texts are taken together up to so many bytes: a short one alone would cost as many calls as all of them.
CHUNK = 1 << 19


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK bytes of a text column, of a row at least."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
            yield b.slice(at, end - at)
            at = end


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts in a row, and where each begins, with the end of the last; a null is empty."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


@dataclass(frozen=True)
class Sentences:
    """The sentences of many texts in a row: words of each and their hashes; the byte position and hash of each word; the
    first sentence and the first word of each text, with the end of the last."""

    words: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    each: np.ndarray
    first: np.ndarray
    first_word: np.ndarray


def sentences(raw: np.ndarray, bounds: np.ndarray, most_words: int, hashed: bool = True) -> Sentences:
    """Cut the texts raw[bounds[i] : bounds[i + 1]] into sentences; without `hashed` they are counted only.

    One ends after a word whose last character is . ! or ? (a closing quote or bracket may follow), before a line
    break, and after `most_words` words, so that text without stops has sentences too. The hash sees words only:
    A-Z count as a-z, and how much white space parts words does not count.
    """
    h, starts, ends = words_of_texts(raw, bounds, hashed)
    n = len(starts)
    text = np.searchsorted(starts, bounds)
    if not n:
        return Sentences(starts, h, starts, h, text, text)
    last = raw[ends - 1]
    before = raw[np.maximum(ends - 2, starts)]
    stop = _STOPS[last] | (_CLOSERS[last] & _STOPS[before])
    lines = np.searchsorted(starts, np.flatnonzero(raw == 0x0A))
    stop[np.concatenate([lines[lines > 0], text[text > 0]]) - 1] = True
    begin = np.append(True, stop[:-1])
    first = np.flatnonzero(begin)
    at = np.arange(n) - np.repeat(first, np.diff(first, append=n))
    first = np.flatnonzero(at % most_words == 0)
    counts = np.diff(first, append=n)
    own = np.searchsorted(first, text)
    if not hashed:
        return Sentences(counts, counts, starts, h, own, text)
    place = mix(np.arange(1, most_words + 1, dtype=U64)) | U64(1)
    total = np.add.reduceat(h * place[at % most_words], first)
    return Sentences(counts, mix(total + counts.astype(U64)), starts, h, own, text)


NONE = (np.zeros(0, np.int64),) * 3


def _room(first: np.ndarray) -> np.ndarray:
    """How many members of its text each one has from itself on."""
    return np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])


def runs(s: Sentences, width: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, two independent hashes) of each run of `width` sentences of a text with at least least_words words."""
    m = len(s.hashes) - width + 1
    if m < 1:
        return NONE
    one, two = (mix(np.arange(k, k + width, dtype=U64)) | U64(1) for k in (101, 301))
    total, other, words = np.zeros(m, U64), np.zeros(m, U64), np.zeros(m, np.int64)
    for i in range(width):
        total += s.hashes[i : m + i] * one[i]
        other += s.hashes[i : m + i] * two[i]
        words += s.words[i : m + i]
    at = np.flatnonzero((words >= least_words) & (_room(s.first)[:m] >= width))
    return at, mix(total[at]).view(np.int64), mix(other[at]).view(np.int64)


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every `width` neighbours."""
    size = 1
    while size < width:
        step = min(size, width - size)
        x = pick(x[:-step], x[step:])
        size += step
    return x


#: A word run has 2 ** 5 words; one is chosen of any 20 neighbours, so 32 + 20 - 1 = 51 words in a row hold one.
DOUBLINGS = 5
RUN_WORDS = 1 << DOUBLINGS
CHOICE = 20


def word_runs(s: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, two independent hashes) of the runs of RUN_WORDS words whose first hash is the least of any CHOICE
    neighbouring runs of their text.

    The choice sees nothing but the words, so equal passages of 51 words choose the same run wherever they stand,
    and in longer ones the chosen runs overlap: what they leave is at most CHOICE - 1 words at each end.
    """
    h = s.each
    if len(h) < RUN_WORDS + CHOICE - 1:
        return NONE
    total, place = h, mix(np.arange(201, 201 + DOUBLINGS, dtype=U64)) | U64(1)
    for i in range(DOUBLINGS):
        total = mix(total[: -(1 << i)] * place[i] + total[1 << i :])
    least = _slide(total, CHOICE, np.minimum)
    least[_room(s.first_word)[: len(least)] < RUN_WORDS + CHOICE - 1] = 0
    at = np.flatnonzero(_slide(np.pad(least, CHOICE - 1), CHOICE, np.maximum) == total)
    other = np.zeros(len(at), U64)
    for i, by in enumerate(mix(np.arange(401, 401 + RUN_WORDS, dtype=U64)) | U64(1)):
        other += h[at + i] * by
    return at, total[at].view(np.int64), mix(other).view(np.int64)


def _ranges(marks: np.ndarray, first: np.ndarray) -> pa.Array:
    """For each text the [start, end) ranges of its marked members, counted from its own first."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begins, ends = marks.copy(), marks.copy()
    same = text[1:] == text[:-1]
    begins[1:] &= ~(marks[:-1] & same)
    ends[:-1] &= ~(marks[1:] & same)
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    pairs = np.stack([a, b], axis=1) - first[text[a]][:, None]
    each = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(a) + 1, 2, dtype=np.int32)), pa.array(pairs.ravel().astype(np.int32)))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(a, first).astype(np.int32)), each)


def _covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n members lie in a run of `width` that begins at any of `at`."""
    return np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(at + width, minlength=n + 1))[:n] > 0


def _within(marks: np.ndarray, first: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """How many members of each text are marked, or the sum of their weights."""
    sums = np.append(0, np.cumsum(marks if weights is None else marks * weights))
    return sums[first[1:]] - sums[first[:-1]]


def remove_repeated_spans(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 4, most_words: int = 12, least_words: int = 10
) -> DataFrame:
    """(doc, text, n_sentences, n_removed, removed, n_run_words) for every row: the text without the sentences that a
    repeated run of sentences covers and without the words that a repeated run of words covers, unless the run is the
    first of its kind by (doc_id, position). removed has the [start, end) sentence ranges taken out, n_run_words counts
    the words taken out beside them.

    Long sentences are cut every 12 words from their own start, so copies of a passage share runs of sentences only
    where their cuts agree. Runs of words do not depend on cuts: each later copy of a passage of 51 words or more
    loses at least one run of 32, and all but 19 words at each end (see word_runs). A run of sentences with fewer than
    least_words words is no passage and stays.

    Runs are hashed once to 96 bits where the text is read, and stored. The first 64 bits are counted with map-side sums;
    only occurrences of repeated ones travel on, and equal runs agree in all 96 (among 10^12 runs a false repeat is to be
    expected once in 10^5 inputs). There is
    no cap on how often a run may occur, and no group is gathered into a task: a first occurrence is a minimum, and
    the join back can be split. A document is cut by the positions of its own repeated runs; its text is read again for
    that, and hashed again only where it has any.

    Nulls: a null text stays null, an empty one empty, each with no sentence. Rows with a null doc_id take no part
    and stay as they are. Rows that share doc_id and text are one document: they lose the same sentences, and
    none to each other. Texts of fewer than `width` sentences are left alone. An empty table gives no rows; extra
    columns are ignored.
    """
    named = docs.where(F.col(doc).isNotNull())

    def runs_of(s: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts, positions in them (even ones of sentences, odd ones of words) and hashes (64 and 32 bits) of runs."""
        (a, x, v), (b, y, w) = runs(s, width, least_words), word_runs(s)
        in_text = [np.searchsorted(first, at, "right") - 1 for first, at in ((s.first, a), (s.first_word, b))]
        places = [2 * (a - s.first[in_text[0]]), 2 * (b - s.first_word[in_text[1]]) + 1]
        return np.concatenate(in_text), np.concatenate(places).astype(np.int32), np.concatenate([x, y]), np.concatenate([v, w]).astype(np.int32)

    def each_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, 1):
            i, *rest = runs_of(sentences(*_bytes_of(part.column(1)), most_words))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (part.column(0).to_numpy()[i], *rest)], ["d", "p", "h", "g"])
        tidy()

    source = named.select(F.col(doc).cast("long").alias("d"), text)
    all_runs = stored(source.mapInArrow(each_run, "d long, p int, h long, g int"), "runs")
    often = stored(all_runs.groupBy("h").count().where("count > 1").select("h"), "repeated")
    found = stored(all_runs.join(often, "h"), "occurrences")
    discard(all_runs, often)
    first = stored(found.groupBy("h", "g").agg(F.min(F.struct("d", "p")).alias("f")), "first")
    later = found.join(first, ["h", "g"]).where((F.col("d") != F.col("f.d")) | (F.col("p") != F.col("f.p")))
    lists = stored(later.groupBy(F.col("d").alias("_d")).agg(F.collect_set(F.struct("p", "h")).alias("_runs")), "later")
    discard(found, first)

    def own_runs(s: Sentences, own: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """First sentences and first words of those runs of `own` (a list of p and h for each text) that the texts hold."""
        sizes = pc.fill_null(pc.list_value_length(own), 0).to_numpy()
        i, listed = np.repeat(np.arange(len(own)), sizes), own.flatten()
        p, h = (listed.field(k).to_numpy() for k in ("p", "h"))
        a, q, held, _ = runs_of(s)
        out = []
        for odd, first in enumerate((s.first, s.first_word)):
            here, mine = q % 2 == odd, p % 2 == odd
            known, value = np.zeros(first[-1] + 1, bool), np.zeros(first[-1] + 1, np.int64)
            at = first[a[here]] + q[here] // 2
            known[at], value[at] = True, held[here]
            inside = first[i[mine]] + p[mine] // 2 < first[i[mine] + 1]
            at = (first[i[mine]] + p[mine] // 2)[inside]
            out.append(at[known[at] & (value[at] == h[mine][inside])])
        return out[0], out[1]

    def cut(ids: pa.Array, texts: pa.Array, own: pa.Array) -> list[pa.Array]:
        some = own.null_count < len(own)
        raw, bounds = _bytes_of(texts)
        s = sentences(raw, bounds, most_words, hashed=some)
        gone, lost = np.zeros(len(s.words), bool), np.zeros(len(s.starts), bool)
        whole = lost
        if some:
            of_sentences, of_words = own_runs(s, own)
            gone = _covered(of_sentences, width, len(gone))
            whole = np.repeat(gone, s.words)
            lost = whole | _covered(of_words, RUN_WORDS, len(lost))
        if lost.any():
            until = np.append(s.starts[1:], len(raw))
            filled = np.diff(s.first_word) > 0
            until[s.first_word[1:][filled] - 1] = bounds[1:][filled]
            step = np.zeros(len(raw) + 1, np.int8)
            step[s.starts[lost]] += 1
            step[until[lost]] -= 1
            left = raw[np.cumsum(step[:-1], dtype=np.int8) == 0]
            sizes = np.diff(bounds) - _within(lost, s.first_word, until - s.starts)
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            kept = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(left)])
            texts = pc.if_else(pc.is_valid(texts), kept.cast(texts.type), texts)
        counts = np.diff(s.first), _within(gone, s.first), _within(lost, s.first_word) - _within(whole, s.first_word)
        n, removed, words = (pa.array(c.astype(np.int32)) for c in counts)
        return [ids, texts, n, removed, _ranges(gone, s.first), words]

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with runs to lose and rows without any apart, as the latter are not hashed."""
        for part in _chunks(batches, 1):
            some = pc.is_valid(part.column(2))
            for rows in (part.filter(some), part.filter(pc.invert(some))):
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays(cut(*rows.columns), [doc, text, "n_sentences", "n_removed", "removed", "n_run_words"])
        tidy()

    kind = docs.schema[doc].dataType.simpleString()
    joined = docs.select(doc, text).join(lists, docs[doc] == lists._d, "left").select(doc, text, "_runs")
    return joined.mapInArrow(
        without, f"`{doc}` {kind}, `{text}` string, n_sentences int, n_removed int, removed array<array<int>>, n_run_words int"
    )
