"""Connected components by alternating large-star and small-star, on DataFrames of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, stored

#: Edges a task: a round over few edges runs in few tasks, whatever the session's number of shuffle partitions.
EDGES_PER_TASK = 200_000


def star_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable by these edges) of every node that is not itself the least."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (further := label[label] != label).any():
            label[further] = label[label[further]]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contracted(edges: DataFrame, edges_per_task: int) -> DataFrame:
    """Each task replaces its edges, `edges_per_task` at a time, by the stars of their own components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def stars() -> pa.RecordBatch:
            node, least = star_forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], ["u", "v"])

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) >= edges_per_task:
                yield stars()
        if held:
            yield stars()

    return edges.mapInArrow(run, "u long, v long")


def _with_least(pairs: DataFrame, floor: bool) -> DataFrame:
    """(u, v, m) for each pair: m is the least v of u, and u itself where `floor`.

    The minima are partial aggregates; they come back by a sort-merge join, of which Spark splits a hot node's
    partition. Neither side is broadcast.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    if floor:
        least = least.withColumn("m", F.least("u", "m"))
    return pairs.join(least.hint("merge"), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, True).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them (edges have u > v)."""
    linked = _with_least(edges, False)
    ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
    return linked.select(ends.alias("e")).select("e.u", "e.v").where(F.col("u") != F.col("v"))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, component) of every node that has an edge; component is the least node reachable.

    Edges are longs in any direction; self-links, repeated edges and rows with a null end are ignored, and an
    empty table gives no rows. A round lets each task contract its own edges to stars and then applies large-star
    and small-star to what is left; it ends in a table in the shared folder, so a lost executor costs at most one
    round, and its predecessor is deleted. Rounds end when one leaves the edges as they were. Their number grows
    with the logarithm of the longest chain; nothing reaches the driver but a count and a checksum a round.
    """
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    ordered = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b))

    def kept(df: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
        seen = Observation()
        told = df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
        return stored(told, "edges"), (seen.get["n"], seen.get["x"])

    held, now = kept(_contracted(ordered, edges_per_task).distinct())
    before = None
    while now != before and now[0]:
        before, last = now, held
        tasks = -(-now[0] // edges_per_task)
        starred = _large_star(_contracted(last.coalesce(tasks), edges_per_task)).coalesce(tasks)
        held, now = kept(_small_star(starred).distinct().coalesce(tasks))
        discard(last)
    stars = held.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
