"""The folder that the driver and all executors reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: One temporary folder a Python process, for sessions of a single machine that name none.
_LOCAL_ONLY: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.

    Only a session of one JVM (master local[...]) may go without it: it gets a temporary folder. On a cluster each
    machine would write to its own disk, so there the setting is required.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _LOCAL_ONLY.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="loomframe-"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: several plans use it, executors may be lost meanwhile."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
