"""Quality classifier: zstandard dictionaries of good and bad text; the compressed-size difference is calibrated."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, md5_bits


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and the logistic curve over the normalised size difference."""

    good: bytes
    bad: bytes
    slope: float
    offset: float
    level: int = 1
    chunk: int = 1024

    def difference(self, text: str | None) -> float:
        """(bad size - good size) / (bad size + good size), over all chunks of the whole text.

        The text is compressed in chunks, so that a long text cannot become its own dictionary.
        """
        body = (text or "").encode("utf-8", "surrogatepass")
        good, bad = _compressors(self.good, self.bad, self.level)
        g = b = 0
        for at in range(0, len(body), self.chunk):
            part = body[at : at + self.chunk]
            g += len(good.compress(part))
            b += len(bad.compress(part))
        return (b - g) / (b + g) if b + g else 0.0

    def score(self, text: str | None) -> float:
        z = self.slope * self.difference(text) + self.offset
        return 1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0


@functools.lru_cache(maxsize=8)
def _compressors(good: bytes, bad: bytes, level: int):
    made = []
    for d in (good, bad):
        own = zstandard.ZstdCompressionDict(d) if d else None
        made.append(
            zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
        )
    return made


def _dictionary(texts: list[str], size: int, level: int, chunk: int) -> bytes:
    """A trained dictionary; where zstandard finds too little to train on, the raw text itself serves."""
    parts = [t.encode()[at : at + 2 * chunk] for t in texts for at in range(0, len(t.encode()), 2 * chunk)]
    total = sum(map(len, parts))
    if total > 4 * size:
        try:
            return zstandard.train_dictionary(size, parts, level=level).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(parts)[-size:]


def _logistic(x: list[float], y: list[int], rounds: int = 60) -> tuple[float, float]:
    """Newton's method for one slope and an offset, with a weak pull to 0 so that parted classes stay finite."""
    if not x:
        return 0.0, 0.0
    mean = sum(x) / len(x)
    spread = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x)) or 1.0
    u, a, b, pull = [(v - mean) / spread for v in x], 0.0, 0.0, 0.01
    for _ in range(rounds):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for v, t in zip(u, y, strict=True):
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, a * v + b))))
            w = p * (1 - p)
            g0 += (p - t) * v
            g1 += p - t
            h00 += w * v * v
            h01 += w * v
            h11 += w
        g0, g1, h00, h11 = g0 + pull * a, g1 + pull * b, h00 + pull, h11 + pull
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return a / spread, b - a * mean / spread


def fit(taken: dict[int, list[str]], shares: dict[int, int], dict_bytes: int = 112_640, level: int = 1, chunk: int = 1024) -> CompressionModel:
    """Fit on sample texts of each class (0 and 1), in a fixed order; shares: rows of each class among all labelled.

    Two thirds of a class's sample build its dictionary, the rest sets the curve, whose offset is corrected from
    the sample's class weights to the shares. Without texts of both classes every score is the share of label 1
    (0.5 without any row).
    """
    prior = math.log((shares.get(1, 0) + 1) / (shares.get(0, 0) + 1))
    if not taken.get(0) or not taken.get(1):
        return CompressionModel(b"", b"", 0.0, prior, level, chunk)
    dicts, rest = {}, []
    for q in (0, 1):
        cut = max(1, 2 * len(taken[q]) // 3)
        dicts[q] = _dictionary(taken[q][:cut], dict_bytes, level, chunk)
        rest += [(t, q) for t in (taken[q][cut:] or taken[q])]
    raw = CompressionModel(dicts[1], dicts[0], 1.0, 0.0, level, chunk)
    slope, offset = _logistic([raw.difference(t) for t, _ in rest], [q for _, q in rest])
    k1 = sum(q for _, q in rest)
    offset += prior - math.log((k1 + 1) / (len(rest) - k1 + 1))
    return CompressionModel(dicts[1], dicts[0], slope, offset, level, chunk)


def held_out(key: Column) -> Column:
    """crc32 of the key's text modulo 3 is 1: never learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    docs_per_class: int = 2000,
    max_doc_bytes: int = 20_000,
    **params,
) -> CompressionModel:
    """Fit on a bounded sample of the documents that labels cover, but for the held-out third.

    Of each class the first docs_per_class labelled ids by a hash are taken, and of these the documents of at
    most max_doc_bytes: the two bound what the driver gathers, and the ids (that many at most) are broadcast, so
    no text is shuffled. Scoring has no such bound. Rows with a null id, text or label are not learnt from.
    """
    marks = labels.select(F.col(doc).alias("_k"), F.col(label).cast("int").alias("_q"))
    marks = marks.where(F.col("_k").isNotNull() & F.col("_q").isin(0, 1) & ~held_out(F.col("_k"))).withColumn("_h", md5_bits(F.col("_k")))
    shares = {r[0]: r[1] for r in marks.groupBy("_q").count().collect()}
    ids = [marks.where(F.col("_q") == q).orderBy("_h", "_k").limit(docs_per_class) for q in (0, 1)]
    body = docs.select(F.col(doc).alias("_k"), F.col(text).alias("_t")).where(F.octet_length("_t") <= max_doc_bytes)
    rows = body.join(F.broadcast(ids[0].unionByName(ids[1])), "_k").orderBy("_h", "_k", "_q", "_t").limit(2 * docs_per_class)
    taken: dict[int, list[str]] = {0: [], 1: []}
    for r in rows.select("_q", "_t").collect():
        taken[r[0]].append(r[1])
    return fit(taken, shares, **params)


def score_quality(docs: DataFrame, model: CompressionModel, doc: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, *keep, score): score from 0 to 1 for every row, higher where label 1 is likelier; only the text counts.

    Each row is scored where it is read, without a shuffle; the model has a fixed size. Null and empty texts get
    the curve's value at a difference of 0. Texts of any length are compressed whole. Repeated rows score alike;
    an empty table gives no rows; extra columns are ignored unless named in `keep` (one called score gives way).
    """
    held = [c for c in dict.fromkeys([doc, *keep]) if c != "score"]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def start():
        def kernel(cols):
            body = cols[-1]
            for i, t in enumerate(body):
                yield (*[c[i] for c in cols[:-1]], model.score(t))

        return kernel

    src = docs.select(*held, F.col(text).alias("_body"))
    return map_rows(src, [*held, "_body"], start, ", ".join(f"`{c}` {types[c]}" for c in held) + ", score double")
