"""Structured Streaming: event-time bars, deduplicated upserts and per-key state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomframe.sources.bars import upsert


def event_bars(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """OHLCV bars of values by event type and window; the same definition serves a batch and a stream.

    `late` sets a watermark, which bounds the state to the windows still open.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        e = e.withWatermark("ts", late)
    order = F.struct("ts", "event_id")
    bars = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("n_events"),
    )
    return bars.select(F.col("event_type").alias("ticker"), F.col("w.start").alias("start"), "open", "high", "low", "close", "n_events")


def run_bars(spark: SparkSession, source: str, out: str, checkpoint: str, width: str = "1 hour", late: str = "1 day"):
    """Read a folder of event files as a stream and append finished bars as Parquet; returns the started query.

    Append mode writes a bar once, when the watermark has passed its end; a restart goes on from the checkpoint.
    """
    schema = spark.read.parquet(source).schema
    bars = event_bars(spark.readStream.schema(schema).parquet(source), width, late)
    return bars.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream without repeated event ids, with state kept for the watermark's length only."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def merge_batch(batch: DataFrame, n: int, target: str, staged: str) -> None:
    """Batch n's bars into `target/current`, a table by day: only the days that it touches are read and written again.

    The merged rows are staged under the batch's number first and replace their days from there. Replacing a day deletes it
    before the new files move in; where that is cut short the batch comes again, and a finished stage is what it then
    replaces the days from, without reading them: they hold the old rows already.
    """
    spark = batch.sparkSession
    system = lambda path: path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    stage, current = f"{staged}/{n}", f"{target}/current"
    columns = [c for c in batch.columns if c not in ("ticker", "start")]
    fresh = batch.groupBy("ticker", "start").agg(F.max(F.struct(*columns)).alias("r")).select("ticker", "start", "r.*").withColumn("day", F.to_date("start"))
    if not system(at(stage)).exists(at(f"{stage}/_SUCCESS")):
        if system(at(current)).exists(at(current)):
            old = spark.read.schema(fresh.schema).parquet(current)
            touched = old.join(fresh.select("day").distinct(), "day", "left_semi").select(*fresh.columns)
            upsert(touched, fresh, ("ticker", "start")).write.mode("overwrite").parquet(stage)
        else:
            fresh.write.mode("overwrite").parquet(stage)
    rows = spark.read.schema(fresh.schema).parquet(stage)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(current)
    if system(at(staged)).exists(at(f"{staged}/{n - 1}")):
        system(at(staged)).delete(at(f"{staged}/{n - 1}"), True)  # batch n - 1 was committed before n began


def upsert_batches(stream: DataFrame, target: str, checkpoint: str):
    """Each micro-batch's bars replace those of the same ticker and start in `target/current`, a table by day.

    A batch that is run again gives the same rows, also after a crash between any two steps of it (merge_batch); its stage
    lies beside the checkpoint whose batch numbers it follows. Of rows of one batch with equal keys the one with the largest
    values stays.
    """
    merge = lambda batch, n: merge_batch(batch, n, target, f"{checkpoint.rstrip('/')}-staged")
    return stream.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RollingMoments(StatefulProcessor):
    """Mean and sample deviation of each key's last k values: a ring of values and their moments, into which a value is taken
    up and from which the oldest is taken away. A timer clears keys that were idle for `idle` seconds of event time."""

    def __init__(self, k: int, idle: int) -> None:
        self.k, self.idle = k, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "value double")
        self.moments = handle.getValueState("moments", "n long, mean double, m2 double, same long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        ring = deque((v[0] for v in self.ring.get()), maxlen=self.k) if self.ring.exists() else deque(maxlen=self.k)
        n, mean, m2, same = self.moments.get() if self.moments.exists() else (0, 0.0, 0.0, 0)
        means, deviations = [], []
        for x in new.value:
            if x == x:
                if n == self.k:
                    old = ring.popleft()
                    rest = (mean * n - old) / (n - 1) if n > 1 else 0.0
                    m2, mean, n = max(m2 - (old - mean) * (old - rest), 0.0) if n > 1 else 0.0, rest, n - 1
                same = same + 1 if ring and x == ring[-1] else 1
                ring.append(x)
                n += 1
                step = x - mean
                mean += step / n
                m2 += step * (x - mean)
                if same >= n:  # what rounding left of other values goes
                    mean, m2 = x, 0.0
            full = x == x and n == self.k
            means.append(mean if full else None)
            deviations.append((m2 / (n - 1)) ** 0.5 if full and n > 1 else None)
        self.ring.put([(v,) for v in ring])
        self.moments.update((n, mean, m2, same))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        self.handle.registerTimer(int(new.ts.max().timestamp() * 1000) + 1000 * self.idle)
        yield pd.DataFrame({"ticker": key[0], "ts": new.ts, "event_id": new.event_id, "mean": pd.Series(means, new.index, "float64"), "std": pd.Series(deviations, new.index, "float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        self.moments.clear()
        return iter(())

    def close(self) -> None:
        pass


#: Fixed value: the store that state with several variables and timers needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rolling_moments(stream: DataFrame, k: int = 20, idle: int = 7 * 86_400, late: str = "1 day") -> DataFrame:
    """(ticker, ts, event_id, mean, std) of a stream (event_type, ts, event_id, value): over each key's last k known values, null
    before there are so many and for a null value.

    Rows of a micro-batch are taken by event time and id, micro-batches as they come, so any split of an ordered stream gives
    the batch's values. State is k numbers a key, and nothing for a key without rows for `idle` seconds. Needs the ROCKS state
    store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = stream.select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value").withWatermark("ts", late)
    schema = "ticker string, ts timestamp, event_id long, mean double, std double"
    return rows.groupBy("event_type").transformWithStateInPandas(RollingMoments(k, idle), schema, "Append", "EventTime")


def run_moments(spark: SparkSession, source: str, out: str, checkpoint: str, k: int = 20, idle: int = 7 * 86_400, files: int = 1):
    """Rolling moments of a folder of event files, `files` a micro-batch, appended as Parquet; returns the started query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files).parquet(source)
    made = rolling_moments(stream, k, idle)
    return made.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)


def running_ema(stream: DataFrame, span: int = 20) -> DataFrame:
    """(ticker, n, ema) of each key's values so far: the recurrence y = a x + (1 - a) y kept as state.

    Rows of one micro-batch are taken in event-time order; the state is two numbers a key.
    """
    a = 2 / (span + 1)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, y = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for x in rows.value:
            y = x if n == 0 else a * x + (1 - a) * y
            n += 1
        state.update((n, y))
        yield pd.DataFrame({"ticker": [key[0]], "n": [n], "ema": [y]})

    return stream.groupBy("event_type").applyInPandasWithState(step, "ticker string, n long, ema double", "n long, ema double", "update", "NoTimeout")


def ic_alerts(ics: DataFrame, floor: float = 0.03, run: int = 3) -> DataFrame:
    """(key, n_low, alert) of a stream (key, date, ic): alert where the last `run` values all lie under the floor."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        low = state.get[0] if state.exists else 0
        for ic in pd.concat(list(batches)).sort_values("date").ic.dropna():
            low = low + 1 if ic < floor else 0
        state.update((low,))
        yield pd.DataFrame({"key": [key[0]], "n_low": [low], "alert": [low >= run]})

    return ics.groupBy("key").applyInPandasWithState(step, "key string, n_low long, alert boolean", "n long", "update", "NoTimeout")


def alert_outbox(alerts: DataFrame, path: str, checkpoint: str):
    """Alerts of a stream (key, ..., alert) as a table `path/batch=<number>`: what is to be sent, once.

    A batch writes its own folder whole, so one that runs again replaces its alerts with the same ones. Senders read the table
    and keep the last batch that they have sent; the table goes with the checkpoint whose batch numbers it has.
    """

    def put(batch: DataFrame, n: int) -> None:
        batch.where("alert").write.mode("overwrite").parquet(f"{path}/batch={n}")

    return alerts.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
