"""Order over a whole column or a long history without a task that holds it: ranges, counts before them, blocks.

Rows are dealt to ranges of their keys, which split a key that holds most rows; what a range has to know of the others is how
many rows lie before it, a number a range and key.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .sqlsteps import Steps
from .template import _arguments


def _ranges(rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """rows by ranges of keys, with the number of each row's range; stored, as a sampled range may fall otherwise in a retry."""
    return stored(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), label)


def _before(ranged: DataFrame, by: Sequence[str], n) -> DataFrame:
    """(by, _range, _before): what n sums to in the ranges before each; a row a range and key."""
    sums = ranged.groupBy(*by, "_range").agg(n.alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "_pos") -> DataFrame:
    """rows with their 0-based number by `order` within `by` (not null); what orders before and after a tie is arbitrary."""
    ranged = _ranges(rows, [*by, *order], "numbered")
    here = Window.partitionBy(*by, "_range").orderBy(*order)
    counted = ranged.join(_before(ranged, by, F.count(F.lit(1))), [*by, "_range"])
    return counted.withColumn(name, F.col("_before") + F.row_number().over(here) - 1).drop("_range", "_before")


def average_ranks(rows: DataFrame, columns: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """rows with the average rank of each column (column -> name of its rank) among the known values, in all rows or within `by`.

    Equal values are counted before anything is ordered, so ties cost nothing: ranges hold distinct values with their
    counts. A rank is looked up by value in a join whose frequent values Spark may split. Null and NaN have no rank, -0.0 is
    0.0; a row whose `by` is null has none either.
    """
    for column, name in columns.items():
        known = rows.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
        values = known.groupBy(*by, F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_ties"))
        ranged = _ranges(values, [*by, "_value"], "ranked")
        here = Window.partitionBy(*by, "_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
        within = ranged.join(_before(ranged, by, F.sum("_ties")), [*by, "_range"])
        rank = F.col("_before") + F.coalesce(F.sum("_ties").over(here), F.lit(0)) + (F.col("_ties") + 1) / 2
        looked = within.select(*by, "_value", rank.cast("double").alias(name))
        rows = rows.withColumn("_value", F.col(column)).join(looked, [*by, "_value"], "left").drop("_value")
    return rows


def reach(steps: Steps) -> tuple[int, int]:
    """How many rows before and after a row a chain looks at: what its levels reach at most, summed up.

    A chain that looks at all rows of a ticker has no such number: ValueError.
    """
    back = ahead = 0
    for level in steps.levels:
        before, after = [0], [0]
        for e in level.values():
            if "UNBOUNDED" in e:
                raise ValueError("a window over a whole history cannot be cut into blocks")
            before += [int(n) for n in re.findall(r"(\d+) PRECEDING", e)]
            after += [int(n) for n in re.findall(r"(\d+) FOLLOWING", e)]
            for m in re.finditer(r"\b(lag|lead)\(", e):
                args, _ = _arguments(e, m.end() - 1)
                (before if m[1] == "lag" else after).append(int(args[1]) if len(args) > 1 else 1)
        back, ahead = back + max(before), ahead + max(after)
    return back, ahead


def in_blocks(steps: Steps, panel: DataFrame, size: int = 1 << 16) -> DataFrame:
    """steps.result(panel) where one ticker may hold most rows: its history lies in blocks of `size` rows in many tasks.

    Each block borrows the rows before and after it that the chain's windows reach, so values are those of windows over the
    whole history, to the last bit. A task's group has `size` rows and the borrowed ones, whatever a ticker has.
    """
    back, ahead = reach(steps)
    size = max(size, back, ahead)
    rows = numbered(panel, ["ticker"], ["date"])
    block, at = F.floor(F.col("_pos") / size), F.col("_pos") % size
    own = F.struct(block.alias("_block"), F.lit(True).alias("_own"))
    lent = [
        F.when(at >= size - back, F.struct((block + 1).alias("_block"), F.lit(False).alias("_own"))),
        F.when((at < ahead) & (block > 0), F.struct((block - 1).alias("_block"), F.lit(False).alias("_own"))),
    ]
    dealt = rows.select(*panel.columns, F.inline(F.array_compact(F.array(own, *lent))))
    levels = [{c: e.replace("PARTITION BY ticker ", "PARTITION BY ticker, _block ") for c, e in level.items()} for level in steps.levels]
    return replace(steps, levels=levels, where=f"_own AND ({steps.where or 'true'})").result(dealt)
