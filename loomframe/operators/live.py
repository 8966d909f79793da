"""A day's signals: the last features known, stored models, positions scaled by volatility, a file, figures of the run."""

from __future__ import annotations

import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .models import live_signals, probabilities


def snapshot(features: DataFrame, day: datetime.date | str) -> DataFrame:
    """The rows of the last date of features that is not after the day; a filter that readers prune files by."""
    until = features.where(F.col("date") <= F.lit(day).cast("date"))
    last = until.agg(F.max("date")).first()[0]
    return until.where(F.col("date") == F.lit(last)) if last is not None else until.limit(0)


def scaled(signals: DataFrame, vol: str = "vol") -> DataFrame:
    """signals with `weight`: the position over the name's volatility, as a share of all such a date; 0 where it has no known one."""
    raw = F.coalesce(F.when(F.col(vol) > 0, F.col("position") / F.col(vol)), F.lit(0.0))
    rows = signals.withColumn("_raw", raw)
    whole = F.sum(F.abs("_raw")).over(Window.partitionBy("date"))
    return rows.withColumn("weight", F.when(whole > 0, F.col("_raw") / whole).otherwise(F.lit(0.0))).drop("_raw")


def run(features: DataFrame, models: dict[str, PipelineModel], day: datetime.date | str, folder: str, vol: str = "vol", threshold: float = 0.65) -> tuple[DataFrame, DataFrame]:
    """The signals of a day, written as CSV to folder/signals_<date>, and one row of figures of the run.

    features: ticker, date, what the models read, and the volatility; models: touch and side, as load_models() gives them. A run
    of the same day writes the same folder anew.
    """
    rows = snapshot(features, day)
    scored = probabilities(models["touch"], rows, "p1").select(*rows.columns, "p1")
    scored = probabilities(models["side"], scored, "p2").select("ticker", "date", vol, "p1", "p2")
    signals = scaled(live_signals(scored, threshold).join(scored, ["ticker", "date"]), vol)
    stamp = signals.agg(F.date_format(F.max("date"), "yyyyMMdd")).first()[0] or "none"
    path = f"{folder}/signals_{stamp}"
    signals.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a row a name: one small file
    back = signals.sparkSession.read.option("header", True).schema(signals.schema).csv(path)
    count = lambda p: F.coalesce(F.sum((F.col("position") == p).cast("long")), F.lit(0))
    figures = back.agg(F.max("date").alias("date"), F.count(F.lit(1)).alias("n_signals"), count(1).alias("n_long"), count(-1).alias("n_short"), F.lit(path).alias("path"))
    return back, figures
