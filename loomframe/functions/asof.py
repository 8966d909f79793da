"""As-of joins by time buckets: the last (or next) row of another table, within a tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _seconds(on: Column, kind: str) -> Column:
    """A date or time as a double of seconds, so that buckets and tolerances are arithmetic."""
    if kind == "date":
        return (F.unix_date(on) * 86_400).cast("double")
    return F.unix_micros(on.cast("timestamp")) / 1e6 if kind.startswith("timestamp") else on.cast("double")


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], on: str, columns: Sequence[str], tolerance: float | None = None, width: float = 30 * 86_400,
    forward: bool = False, strict: bool = False,
) -> DataFrame:
    """left with `columns` of the last row of right with equal `by` and an `on` not after its own, null where there is none.

    `forward` takes the next row instead, `strict` leaves out rows of equal `on`, `tolerance` those further away (seconds for
    dates and times, else units of `on`). Of right rows that agree in by and on the one with the largest `columns` is taken. All rows
    of left stay, also repeated ones and those whose key or time is null, which match nothing.

    A key's history is dealt in buckets of `width`, so one that holds most rows is in many tasks: a bucket's rows meet in one
    window, and what a bucket has to know of those before it is their last row, which is carried forward over one row a bucket.
    """
    kind = left.schema[on].dataType.simpleString()
    sign = -1 if forward else 1
    t = sign * _seconds(F.col(on), kind)
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    place = F.floor(t / width)
    value = F.struct(t.alias("t"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    known = F.col(on).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(left.columns)])
    asks = left.where(known).select(*keys, place.alias("_b"), t.alias("_t"), F.lit(0 if strict else 1).alias("_side"), row.alias("_row"), F.lit(None).alias("_value"))
    tells = right.where(known).select(*keys, place.alias("_b"), t.alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).alias("_row"), value.alias("_value"))
    # The last row that each bucket leaves to those after it: a row a bucket, summed where it is read.
    leaves = tells.groupBy(*names, "_b").agg(F.max("_value").alias("_leaves"))
    buckets = leaves.unionByName(asks.select(*names, "_b", F.lit(None).alias("_leaves"))).groupBy(*names, "_b").agg(F.max("_leaves").alias("_leaves"))
    earlier = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*names, "_b", F.last("_leaves", ignorenulls=True).over(earlier).alias("_carried"))
    # Within a bucket right rows of one time are ordered by their columns; the frame ends with the row itself.
    here = Window.partitionBy(*names, "_b").orderBy("_t", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    met = asks.unionByName(tells).withColumn("_found", F.last("_value", ignorenulls=True).over(here)).where("_row IS NOT NULL")
    met = met.join(carried, [*names, "_b"]).withColumn("_found", F.coalesce("_found", "_carried"))
    if tolerance is not None:
        met = met.withColumn("_found", F.when(F.col("_t") - F.col("_found.t") <= tolerance, F.col("_found")))
    found = met.select("_row.*", *[F.col(f"_found.v{i}").alias(f"v{i}") for i in range(len(columns))])
    lone = left.where(~F.coalesce(known, F.lit(False))).select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(left.columns)], *[F.lit(None).cast(right.schema[c].dataType).alias(f"v{i}") for i, c in enumerate(columns)]
    )
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(left.columns)]
    return found.unionByName(lone).select(*own, *[F.col(f"v{i}").alias(c) for i, c in enumerate(columns)])
