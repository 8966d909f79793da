"""Extendible hashing: a directory over hash-prefix bits; only buckets over the byte limit take another bit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import md5_bits, stored

BITS = 60
#: Bits of the second directory, for rows that agree in the whole hash of their key: so many of the text's hash come first.
TEXT_BITS = 40


def _directory(sizes: DataFrame, depth: int, limit: int, within: list[str]) -> DataFrame:
    """(*within, slot, depth, prefix, shard_bytes, shard_rows) for each used directory slot of `depth` bits.

    A slot points at the shallowest prefix whose rows fit the limit; a lone row that does not fit stands alone,
    and rows that agree in all hash bits stay together. Above the shallowest such prefix of a group no slot can point
    anywhere, so slots are set against the prefixes from there down only: these hold about as many slots as a shard has.
    """
    sums = [F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows")]

    def levels(rows: DataFrame, from_: Column) -> DataFrame:
        each = rows.select(*within, "slot", "bytes", "rows", F.explode(F.sequence(from_, F.lit(depth))).alias("depth"))
        return each.withColumn("prefix", F.expr(f"shiftright(slot, {depth} - depth)"))

    done = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == depth)
    totals = stored(levels(sizes, F.lit(0)).groupBy(*within, "depth", "prefix").agg(*sums).where(done), "prefixes")
    top = totals.groupBy(*within).agg(F.min("depth").alias("top"))
    if within:
        below = levels(sizes.join(top, within), F.col("top"))
    else:
        below = levels(sizes, F.lit(top.first()["top"] or 0))
    return (
        below.join(totals, [*within, "depth", "prefix"])
        .groupBy(*within, "slot")
        .agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("s"))
        .select(*within, "slot", "s.*")
    )


def _split(rows: DataFrame, depth: int, limit: int, within: list[str]) -> tuple[DataFrame, Column]:
    """The stored directory of the rows' hashes _h in each group of `within`, and the slot of a row in it.

    The directory deepens only while some slot is over the limit with rows that more bits can part."""
    while True:
        slot = F.shiftright("_h", BITS - depth)
        counted = rows.groupBy(*within, slot.alias("slot")).agg(
            F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("_h").alias("lo"), F.max("_h").alias("hi")
        )
        sizes = stored(counted, "slots")  # so the rows are read once for a depth
        if depth == BITS or sizes.where((F.col("bytes") > limit) & (F.col("lo") != F.col("hi"))).isEmpty():
            break
        depth = min(BITS, depth + 6)
    found = _directory(sizes.drop("lo", "hi"), depth, limit, within)
    return stored(
        found.select(
            *within,
            F.col("slot").alias("_slot"),
            F.concat_ws("-", F.col("depth").cast("string"), F.col("prefix").cast("string")).alias("_shard"),
            F.col("depth").cast("int").alias("_depth"),
            F.col("shard_bytes").alias("_bytes"),
            F.col("shard_rows").alias("_rows"),
        ),
        "directory",
    ), slot


#: Columns that assign_shards adds, after those of the rows.
ADDED = ("row_bytes", "shard", "shard_depth", "shard_bytes")


def assign_shards(docs: DataFrame, limit_bytes: int, key: str = "doc_id", size: Column | None = None, text: str = "text") -> DataFrame:
    """Add shard ("depth-prefix"), shard_depth, shard_bytes and row_bytes to every row.

    The hash is 60 bits of md5 over the key's text. The directory starts deep enough for the whole input and
    deepens only while some slot is over the limit with rows that more bits can part. Its size follows the
    number of shards, and it is joined by Catalyst's choice (never collected).

    Rows that share a key part in a second directory where they are over the limit together: 40 bits of their text's
    hash, then 20 of their place in the input for equal texts; their shards are "depth-prefix.depth-prefix", and
    shard_depth counts the bits of both. So every shard of more than one row fits the limit, whatever share of the rows
    one key holds; the rows of all other keys stay together by key.

    Nulls: a null key hashes as empty text, a null text has 0 bytes. One row over the limit is a shard of its own.
    Ties and repeated rows are covered by the second directory. An empty table gives no rows; extra columns of any name
    pass through unless they bear the names added here, which are replaced.
    """
    own = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") if size is None else size.cast("long")
    # Inside, the rows' columns are numbered, so that none of them can meet a name used here.
    names = {f"c{i}": c for i, c in enumerate(docs.columns) if c not in ADDED}
    hashes = {"_h": md5_bits(F.col(key), BITS), "_text_h": md5_bits(F.col(text), TEXT_BITS), "_size": own}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], *[e.alias(n) for n, e in hashes.items()])
    total = rows.agg(F.sum("_size").alias("b")).first()
    found, slot = _split(rows, _first_depth(total["b"], limit_bytes), limit_bytes, [])
    crowded = (F.col("_bytes") > limit_bytes) & (F.col("_rows") > 1)
    if found.where(crowded).isEmpty():
        return _named(rows.withColumn("_slot", slot).join(found, "_slot"), names)
    # The place of a row is taken before any shuffle, and stored, so that it is one and the same in all that follows.
    place = F.shiftright(md5_bits(F.monotonically_increasing_id()), TEXT_BITS)
    tie = F.shiftleft("_text_h", BITS - TEXT_BITS) + place
    placed = rows.withColumns({"_slot": slot, "_tie": tie}).join(found, "_slot")
    held = placed.where(crowded).withColumns({"_h": F.col("_tie"), "_outer": F.col("_shard"), "_outer_depth": F.col("_depth")})
    held = stored(held.drop("_tie", "_slot", "_shard", "_depth", "_bytes", "_rows"), "crowded")
    most = held.groupBy("_outer").agg(F.sum("_size").alias("b")).agg(F.max("b")).first()[0]
    inner, slot = _split(held, _first_depth(most, limit_bytes), limit_bytes, ["_outer"])
    parted = held.withColumn("_slot", slot).join(inner, ["_outer", "_slot"])
    parted = parted.withColumns({"_shard": F.concat_ws(".", "_outer", "_shard"), "_depth": F.col("_outer_depth") + F.col("_depth")})
    return _named(placed.where(~crowded), names).unionByName(_named(parted, names))


def _first_depth(total: int | None, limit: int) -> int:
    return min(BITS, math.ceil(math.log2(max(1, (total or 0) // limit))) + 6)


def _named(placed: DataFrame, names: dict[str, str]) -> DataFrame:
    made = {"row_bytes": "_size", "shard": "_shard", "shard_depth": "_depth", "shard_bytes": "_bytes"}
    return placed.select(*[F.col(n).alias(c) for n, c in (names | {own: c for c, own in made.items()}).items()])
