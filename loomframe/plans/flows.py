"""Queries of streaming bars, model adapters and whole pipelines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.ordered import in_blocks
from loomframe.functions.shared import shared_dir
from loomframe.operators import indicators, labeling, live, microstructure, models, search, technical
from loomframe.sources import responses
from loomframe.sources.bars import BARS_SQL, bars, read_table
from loomframe.streaming.bars import event_bars, run_bars, run_moments

from . import research


def _rounded(df: DataFrame) -> DataFrame:
    cols = [F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")]
    return df.select("ticker", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), *cols, "n_events")


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(event_bars(read_table(spark, sf_dir, "events")))


def streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars through the streaming path; windows that the watermark has not passed stay open."""
    work = f"{shared_dir(spark).rstrip('/')}/bars-{uuid.uuid4().hex}"
    read_table(spark, sf_dir, "events").write.parquet(f"{work}/in")
    run_bars(spark, f"{work}/in", f"{work}/out", f"{work}/state").awaitTermination()
    return _rounded(spark.read.parquet(f"{work}/out"))


def streamed_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling moments of the events as a stream that comes in six micro-batches by time."""
    work = f"{shared_dir(spark).rstrip('/')}/moments-{uuid.uuid4().hex}"
    events = read_table(spark, sf_dir, "events")
    for days in range(0, 30, 5):
        events.where(f"ts >= timestamp_ntz'2024-01-01' + INTERVAL {days} DAY AND ts < timestamp_ntz'2024-01-01' + INTERVAL {days + 5} DAY").write.mode("append").parquet(f"{work}/in")
    run_moments(spark, f"{work}/in", f"{work}/out", f"{work}/state", files=64).awaitTermination()
    cols = [(F.round(c, 6) + 0.0).alias(c) for c in ("mean", "std")]
    return spark.read.parquet(f"{work}/out").select("ticker", "event_id", *cols)


BROKEN = "Brand#13"


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fetches of the panel as a provider's answers, the second of a longer range; one ticker's answer is broken.

    A row a ticker: its bars after the second fetch, and how many days each fetch asked the provider for.
    """
    work = f"{shared_dir(spark).rstrip('/')}/provider-{uuid.uuid4().hex}"
    panel = bars(spark, sf_dir)
    answer = F.to_json(F.struct(F.col("date").cast("string").alias("date"), "open", "high", "low", "close", "volume"))
    lines = panel.select("ticker", F.when(F.col("ticker") == BROKEN, "{oops").otherwise(answer).alias("value"))
    lines.repartition("ticker").write.partitionBy("ticker").text(f"{work}/answers")
    cache = responses.Cache(spark, f"{work}/cache")
    every = panel.select("ticker").distinct()
    wanted = lambda lo, hi: every.selectExpr("ticker", f"DATE '{lo}' AS lo", f"DATE '{hi}' AS hi")
    days = lambda asked, name: asked.groupBy("ticker").agg(F.sum(F.datediff("hi", "lo") + 1).cast("long").alias(name))
    _, _, first = cache.fetch(f"{work}/answers", wanted("1994-01-01", "1995-12-31"))
    rows, failed, second = cache.fetch(f"{work}/answers", wanted("1993-07-01", "1997-12-31"))
    found = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_bars"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.round(F.sum("close"), 4).alias("closes"))
    errors = failed.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_failed"))
    out = every.join(days(first, "asked_first"), "ticker", "left").join(days(second, "asked_second"), "ticker", "left").join(found, "ticker", "left").join(errors, "ticker", "left")
    return out.fillna(0, ["n_bars", "n_failed", "asked_first", "asked_second"])


SPACE = {"penalty": search.Number(1e-3, 10, log=True), "clip": search.Number(1, 5), "half_life": search.Number(60, 2000, log=True)}


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten trials of a ridge regression of the next return on four columns, over three purged folds of dates."""
    scored = research.SCORED.apply(spark, panel=bars(spark, sf_dir)).withColumn("turn", F.col("volume") * F.col("close"))
    columns = ["signal", "volume", "vol", "turn"]
    objective = search.ridge_objective(search.purged_rows(scored, columns, 3), columns)
    return search.trial_rows(spark, search.search(objective, SPACE, 3, 10), list(SPACE))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = bars(spark, sf_dir)
    events = labeling.barrier_events().apply(spark, panel=panel)
    scored = research.SCORED.apply(spark, panel=panel).selectExpr("ticker AS t", "date AS d", "signal", "volume", "vol")
    return events.join(scored, (events.ticker == scored.t) & (events.t0 == scored.d)).select("ticker", "t0", "t1", "barrier_side", "signal", "volume", "vol")


def crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the touched events' sides by a stack of two kinds of models, crossed over three folds of dates."""
    rows = _labelled(spark, sf_dir).where("barrier_side <> 0").withColumn("label", (F.col("barrier_side") > 0).cast("double"))
    out, _ = models.stacked(rows, ["signal", "volume", "vol"], 3, kinds={"logistic": {}, "boosted": {"maxIter": 5}})
    return out.select("ticker", "t0", "fold", "label", *[F.round(c, 6).alias(c) for c in ("p_logistic", "p_boosted", "score")])


def live_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of a Sunday in 1998: models of the events before 1997, stored and loaded, on the last features known."""
    work = f"{shared_dir(spark).rstrip('/')}/live-{uuid.uuid4().hex}"
    _, fitted = models.two_stage(_labelled(spark, sf_dir), ["signal", "volume", "vol"], "1997-01-01")
    models.save_models(fitted, f"{work}/models")
    features = research.SCORED.apply(spark, panel=bars(spark, sf_dir)).select("ticker", "date", "signal", "volume", "vol")
    signals, _ = live.run(features, models.load_models(spark, f"{work}/models"), "1998-03-15", f"{work}/out")
    return signals.select("ticker", "date", F.col("position").cast("int").alias("position"), *[F.round(c, 6).alias(c) for c in ("p1", "p2", "weight")])


def two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of the events from 1997 on, by models of the events that ended before."""
    out, _ = models.two_stage(_labelled(spark, sf_dir), ["signal", "volume", "vol"], "1997-01-01")
    return models.live_signals(out.withColumnRenamed("t0", "date")).withColumn("position", F.col("position").cast("int"))


#: Bars of a minute, at a level where logarithms are known: five histories of any length.
MINUTES_SQL = """SELECT event_type AS ticker, date_trunc('minute', ts) AS date, 100 + arg_min(value, (ts, event_id)) / 7 AS open, 100 + max(value) / 7 AS high,
  100 + min(value) / 7 AS low, 100 + arg_max(value, (ts, event_id)) / 7 AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL"""
#: Rows of a block in these queries; the library's default is 65,536.
BLOCK = 1024
INTRADAY = {
    "t20_intraday": technical.compute_all, "t01_intraday": technical.cum_returns, "m01_intraday": microstructure.amihud,
    "i05_intraday": indicators.rolling_stats, "f02_intraday": lambda: indicators.fracdiff((0.5,)),
}


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = event_bars(read_table(spark, sf_dir, "events"), "1 minute")
    level = [(F.col(c) / 7 + 100).alias(c) for c in ("open", "high", "low", "close")]
    return made.select("ticker", F.col("start").alias("date"), *level, F.col("n_events").cast("double").alias("volume"))


def intraday(steps):
    return lambda spark, sf_dir: in_blocks(steps(), minute_bars(spark, sf_dir), BLOCK).withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm"))


_BARS = """SELECT event_type AS ticker, strftime(s, '%Y-%m-%d %H:%M') AS start, round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high,
  round(min(value), 6) AS low, round(arg_max(value, (ts, event_id)), 6) AS close, count(*) AS n_events
FROM (SELECT *, date_trunc('hour', ts) AS s FROM events) e {where} GROUP BY event_type, s"""
QUERIES = {"st_hourly_bars": hourly_bars, "st_streamed_bars": streamed_bars, "a04_a07_two_stage_signals": two_stage}
QUERIES |= {"s04_fetched": fetched, "st_rolling_moments": streamed_moments, "a03_search": searched, "a04_stacked": crossed, "a07_live_run": live_run}
QUERIES |= {name: intraday(steps) for name, steps in INTRADAY.items()}
ORACLES = {name: f"SELECT * REPLACE (strftime(date, '%Y-%m-%d %H:%M') AS date) FROM ({steps().sql(MINUTES_SQL)})" for name, steps in INTRADAY.items()} | {
    "st_hourly_bars": _BARS.format(where=""),
    "st_streamed_bars": _BARS.format(where="WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"),
    "st_rolling_moments": """SELECT event_type AS ticker, event_id, round(CASE WHEN count(*) OVER w = 20 THEN avg(value) OVER w END, 6) + 0.0 AS mean,
  round(CASE WHEN count(*) OVER w = 20 THEN stddev_samp(value) OVER w END, 6) + 0.0 AS std FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 19 PRECEDING)""",
    "s04_fetched": f"""WITH b AS ({BARS_SQL}), f AS (SELECT ticker, count(*) AS n_bars, min(date) AS first_day, max(date) AS last_day, round(sum(close), 4) AS closes
  FROM b WHERE date BETWEEN DATE '1993-07-01' AND DATE '1997-12-31' AND ticker <> '{BROKEN}' GROUP BY ticker)
SELECT t.ticker, 730 AS asked_first, CASE WHEN t.ticker = '{BROKEN}' THEN 1645 ELSE 184 + 731 END AS asked_second, coalesce(n_bars, 0) AS n_bars, first_day, last_day, closes,
  CASE WHEN t.ticker = '{BROKEN}' THEN 1 ELSE 0 END AS n_failed FROM (SELECT DISTINCT ticker FROM b) t LEFT JOIN f ON t.ticker = f.ticker""",
}
