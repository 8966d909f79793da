"""Shared plumbing of the corpus operators: table access, shared storage, Arrow map helper."""

from __future__ import annotations

import ctypes
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomframe.functions.shared import shared_dir

_LIBC = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Smaller than a checkpoint for wide text rows, since Parquet compresses columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def added(df: DataFrame, to: DataFrame | None, label: str) -> DataFrame:
    """Append df to the table `to` of stored() or added(), and read all of it; a new table where there is none yet."""
    if to is None:
        return stored(df, label)
    df.write.mode("append").parquet(to._stored_at)
    out = df.sparkSession.read.schema(to.schema).parquet(to._stored_at)
    out._stored_at = to._stored_at
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of stored(); only for those that nothing not yet written depends on."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def md5_bits(key: Column, bits: int = 60) -> Column:
    """A non-negative long of `bits` (at most 60) uniform bits of md5 over the key's text form."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.shiftright(F.conv(head, 16, 10).cast("long"), 60 - bits)


def drawn(rows: DataFrame, key: str, size: int) -> DataFrame:
    """About `size` rows by a hash of the key, never more than twice as many; all rows where there are fewer.

    The share is set from a count, so a task gives up its own share only: what reaches the driver is bounded by
    `size`, not by the number of tasks.
    """
    n = rows.count()
    if n <= size:
        return rows
    return rows.where(md5_bits(F.col(key)) < int(2**60 * size / n)).limit(2 * size)


def clear_of(spans: list[tuple], base: list[tuple]) -> list[tuple]:
    """The spans (kind, start, end, ...) that overlap no span of base; in time linear in both but for sorting."""
    starts, ends = [], []
    for a, b in sorted((s[1], s[2]) for s in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for s in spans:
        k = bisect_right(ends, s[1])
        if k == len(ends) or starts[k] >= s[2]:
            out.append(s)
    return out


def tidy() -> None:
    """Hand memory that a finished task no longer uses back to the machine: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


def map_rows(
    df: DataFrame,
    columns: list[str],
    start: Callable[[], Callable[[list[list]], Iterable[tuple]]],
    schema: str | T.StructType,
    rows_at_once: int = 256,
) -> DataFrame:
    """Run a Python kernel over Arrow batches of `columns`.

    `start()` runs once per task and returns the kernel; the kernel gets lists (one per column, at most
    `rows_at_once` long, so that a batch of long texts stays small) and yields output tuples.
    """
    out = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = start()
        arrow = to_arrow_schema(out)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                rows = list(kernel([c.to_pylist() for c in part.columns]))
                if rows:
                    cols = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, schema=arrow)
        tidy()

    return df.select(*columns).mapInArrow(run, out)
