"""Best-two-fit packing of token sequences into rows of a fixed size."""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, stored


class TokenEncoder:
    """Token ids of a `tokenizers` JSON file as little-endian unsigned 32-bit bytes.

    A byte-level BPE whose merges rise with their ids is run by tiktoken's engine over the file's own vocabulary
    (same ids, several times faster); any other file is run by `tokenizers` itself. As there, the strings of the
    file's added tokens stand for these tokens wherever a text holds them.
    """

    #: Fixed value: the word pattern of byte-level BPE files with use_regex.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks, added = self._ranks(spec), self._added(spec)
        if ranks and added is not None:
            import tiktoken

            ranks = {word: i for word, i in ranks.items() if i not in set(added.values())}
            core = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=added)._core_bpe
            self._one = lambda t: bytes(core.encode_to_tiktoken_buffer(t, set(added)))
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            self._one = lambda t: np.asarray(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _added(spec: dict) -> dict[str, int] | None:
        """The added tokens, or None where they are matched otherwise than as plain strings none of which begins another."""
        tokens = spec.get("added_tokens") or []
        names = [t["content"] for t in tokens]
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in tokens):
            return None
        if any(a != b and b.startswith(a) for a in names for b in names):
            return None
        return {t["content"]: t["id"] for t in tokens}

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not spec.get("normalizer") and not model.get("ignore_merges")
        if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            return None
        # Bytes that print stand for themselves in the file, the others for the code points from 256 on.
        printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in printing}
        byte |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printing)))}
        return {bytes(byte[c] for c in word): i for word, i in model["vocab"].items()}

    def __call__(self, text: str) -> bytes:
        return self._one(text) if text else b""


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TokenEncoder:
    return TokenEncoder(path)


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one piece if it fits, else whole sizes after a shorter first one."""
    first = n if n <= size else n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def tokenize(docs: DataFrame, tokenizer: str, size: int, end_id: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, piece, start, length, ids_crc32, n_tokens) of every document's pieces."""

    def start():
        encode, end = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()

        def kernel(cols):
            for doc_id, body in zip(*cols, strict=True):
                ids = memoryview(encode(body or "") + end)
                n = len(ids) // 4
                for k, (at, length) in enumerate(cut_points(n, size)):
                    yield doc_id, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n

        return kernel

    kind = docs.schema[doc].dataType.simpleString()
    return map_rows(docs, [doc, text], start, f"`{doc}` {kind}, piece int, start long, length long, ids_crc32 long, n_tokens long")


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Plan bins over a histogram of lengths: (how many bins, the lengths in each).

    A bin is filled greedily with the largest length that fits. Then its smallest document is swapped for the
    two unpacked ones that fill the widened gap most, as long as two fill it more than the one did. A bin's
    choice depends only on which lengths are left, so it is repeated until one of its lengths runs out: the work
    is a few steps a distinct length, whatever the number of documents.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    ids, plan = np.arange(size + 1), []

    def largest() -> np.ndarray:
        """For each x the largest length left that is at most x (0: none)."""
        return np.maximum.accumulate(np.where(left > 0, ids, 0))

    def two(room: int) -> tuple[int, int]:
        """Two lengths left with the largest sum of at most room (0, 0: none)."""
        below = largest()
        a = ids[(left > 0) & (ids <= room)]
        if not len(a):
            return 0, 0
        b = below[np.minimum(room - a, a)]
        twin = (b == a) & (left[a] < 2)
        b = np.where(twin, below[np.maximum(a - 1, 0)], b)
        b = np.where(b > 0, b, -size)
        k = int(np.argmax(a + b))
        return (int(a[k]), int(b[k])) if b[k] > 0 else (0, 0)

    while left.any():
        bin_, room = [], size
        while room and (x := int(largest()[room])):
            bin_.append(x)
            left[x] -= 1
            room -= x
        while room:
            s = min(bin_)
            a, b = two(room + s)
            if a + b <= s:
                break
            bin_.remove(s)
            left[s] += 1
            bin_ += [a, b]
            left[a] -= 1
            left[b] -= 1
            room += s - a - b
        used = {x: bin_.count(x) for x in set(bin_)}
        more = min(int(left[x]) // k for x, k in used.items())
        for x, k in used.items():
            left[x] -= more * k
        plan.append((1 + more, sorted(bin_, reverse=True)))
    return plan


def _slots(plan: list[tuple[int, list[int]]], size: int) -> dict[str, np.ndarray]:
    """For each length, runs of its documents' numbers: where a run begins, its first sequence and its offset."""
    rows, used, sequence = [], [0] * (size + 1), 0
    for n, bin_ in plan:
        at = 0
        for x in bin_:
            rows.append((x, used[x], sequence, at))
            used[x] += n
            at += x
        sequence += n
    rows.sort()
    length, first, seq, at = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 4
    return {"length": length, "first": first, "sequence": seq, "offset": at}


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, piece, start, length, ids_crc32, n_tokens, sequence_id, offset) of every piece of every document.

    Texts are tokenized where they are read; only piece descriptions (no texts, no ids) are written to the
    shared folder and numbered within their length. The plan needs the histogram of lengths alone (at most
    `size` numbers), so the driver's work and memory do not grow with the documents. Pieces of one length are
    numbered in salted groups, since one length may hold a large share of all pieces.

    Nulls: a null text is empty, and an empty document is its end id alone; a null id stays null. Repeated rows
    are packed each. An empty table gives no rows; extra columns are ignored. Texts of any length are cut into
    pieces of `size`, the first of which may be shorter.
    """
    pieces = stored(tokenize(docs, tokenizer, size, end_id, doc, text).withColumn("_tie", F.monotonically_increasing_id()), "pieces")
    total = pieces.count()
    salts = max(64, -(-total // 100_000))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(doc, "piece", "_tie"), F.lit(salts)))
    groups = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    slots = _slots(best_two_fit(counts, size), size)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy(doc, "piece", "_tie")
    numbered = salted.withColumn("_k", F.row_number().over(within)).join(offsets, ["length", "_salt"])
    names = [doc, "piece", "start", "length", "ids_crc32", "n_tokens"]
    numbered = numbered.select(*names, (F.col("_k") - 1 + F.col("_before")).alias("_number"))
    key = slots["length"] << 44  # length and number as one sorted key; numbers stay below 2^44

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = b.column(3).to_numpy(), b.column(6).to_numpy()
            k = np.searchsorted(key + slots["first"], (length << 44) + number, side="right") - 1
            seq = slots["sequence"][k] + number - slots["first"][k]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(seq), pa.array(slots["offset"][k])], [*names, "sequence_id", "offset"])

    kind = docs.schema[doc].dataType.simpleString()
    ddl = f"`{doc}` {kind}, piece int, start long, length long, ids_crc32 long, n_tokens long, sequence_id long, offset long"
    return numbered.mapInArrow(place, ddl)
