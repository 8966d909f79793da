import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomframe.streaming import bars as st

SF = "/root/testdata/sf0.01"


def files(spark, tmp_path, n=3):
    """Events in n files by time, one event late and one repeated."""
    e = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values("ts").reset_index(drop=True)
    parts = [e.iloc[k * len(e) // n : (k + 1) * len(e) // n] for k in range(n)]
    folder = tmp_path / "in"
    folder.mkdir()
    for k, p in enumerate(parts):
        p.assign(ts=p.ts.astype("datetime64[us]")).to_parquet(folder / f"{k}.parquet")
    return e, str(folder)


def stream(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_bars_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    _, folder = files(spark, tmp_path)
    st.run_bars(spark, folder, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = st.event_bars(spark.read.parquet(folder))
    assert got.count() > 100 and got.exceptAll(want).count() == 0
    n = got.count()
    st.run_bars(spark, folder, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()  # a restart adds nothing
    assert spark.read.parquet(str(tmp_path / "out")).count() == n


def test_upserts(spark, tmp_path):
    _, folder = files(spark, tmp_path)
    bars = st.event_bars(stream(spark, folder), late="1 day")
    st.upsert_batches(bars, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    want = st.event_bars(spark.read.parquet(folder))
    got = spark.read.parquet(str(tmp_path / "t" / "current"))
    assert got.drop("day").exceptAll(want).count() == 0 and got.count() == want.count()
    assert len(list((tmp_path / "t" / "current").glob("day=*"))) > 1


def test_state(spark, tmp_path):
    e, folder = files(spark, tmp_path)
    out = st.running_ema(stream(spark, folder)).writeStream.outputMode("update").format("memory").queryName("ema").trigger(availableNow=True).start()
    out.awaitTermination()
    got = {r.ticker: r.ema for r in spark.table("ema").groupBy("ticker").agg(F.max_by("ema", "n").alias("ema")).collect()}
    for t, g in e.sort_values(["ts", "event_id"]).groupby("event_type"):
        assert abs(got[t] - g.value.ewm(span=20, adjust=False).mean().iloc[-1]) < 1e-9


def test_alerts_and_repeats(spark, tmp_path):
    rows = pd.DataFrame({"key": "k", "date": pd.date_range("2024-01-01", periods=6), "ic": [0.1, 0.01, 0.02, None, 0.0, 0.05]})
    folder = tmp_path / "ic"
    folder.mkdir()
    for k in range(6):
        rows.iloc[[k]].assign(date=rows.iloc[[k]].date.astype("datetime64[us]")).to_parquet(folder / f"{k}.parquet")
    q = st.ic_alerts(stream(spark, str(folder))).writeStream.outputMode("update").format("memory").queryName("alerts").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.n_low, r.alert) for r in spark.table("alerts").collect()]
    assert (3, True) in got and got[-1] == (0, False)


def moments(spark, events, folder, cuts, k=20, idle=7 * 86_400):
    """Rolling moments of events that come in parts cut at `cuts`."""
    folder.mkdir()
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(events)], strict=True)):
        events.iloc[a:b].to_parquet(folder / f"{n}.parquet")
    st.run_moments(spark, str(folder), f"{folder}-out", f"{folder}-state", k, idle).awaitTermination()
    return spark.read.parquet(f"{folder}-out").toPandas().sort_values(["ticker", "ts", "event_id"]).reset_index(drop=True)


def test_moments_of_any_split_equal_those_of_a_batch(spark, tmp_path):
    """Means and deviations over the last 20 known values, nulls among them, and a constant stretch."""
    e = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values(["ts", "event_id"]).reset_index(drop=True).iloc[:2000]
    e = e.assign(ts=e.ts.astype("datetime64[us]"), value=e.value.where(e.index % 17 > 0).where((e.index < 500) | (e.index > 900), 3.0))
    known = e.dropna(subset="value").sort_values(["event_type", "ts", "event_id"])
    roll = known.groupby("event_type").value.rolling(20)
    want = known.assign(mean=roll.mean().to_numpy(), std=roll.std().to_numpy()).set_index("event_id")
    for n, cuts in enumerate(([], [700, 701, 1500])):
        got = moments(spark, e, tmp_path / f"in{n}", cuts).set_index("event_id")
        assert len(got) == 2000
        both = got.join(want, rsuffix="_w")
        assert np.allclose(both["mean"].astype(float), both.mean_w, equal_nan=True) and np.allclose(both["std"].astype(float), both.std_w, atol=1e-6, equal_nan=True)


def test_state_of_an_idle_key_goes(spark, tmp_path):
    """Key a pauses longer than the idle time while b moves the watermark on: a starts anew."""
    day = pd.Timestamp("2024-01-01")
    rows = [("a", day, 1, 1.0), ("a", day, 2, 3.0), ("b", day + pd.Timedelta(days=20), 3, 1.0), ("b", day + pd.Timedelta(days=21), 4, 1.0), ("a", day + pd.Timedelta(days=30), 5, 7.0), ("a", day + pd.Timedelta(days=30), 6, 9.0)]
    e = pd.DataFrame(rows, columns=["event_type", "ts", "event_id", "value"]).astype({"ts": "datetime64[us]"})
    got = moments(spark, e, tmp_path / "in", [2, 3, 4], k=2, idle=86_400).set_index("event_id")["mean"]
    assert got[2] == 2.0 and np.isnan(got[5]) and got[6] == 8.0 and got[4] == 1.0


def test_a_crash_while_days_are_replaced_loses_nothing(spark, tmp_path):
    """The day's old rows are deleted and the new ones not there yet: the batch that runs again brings both back."""
    import shutil

    ddl = "ticker string, start timestamp, close double"
    first = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 10), 1.0), ("b", dt.datetime(2024, 1, 1, 11), 2.0)], ddl)
    second = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 10), 5.0), ("c", dt.datetime(2024, 1, 2, 10), 3.0)], ddl)
    target, staged = str(tmp_path / "bars"), str(tmp_path / "staged")
    st.merge_batch(first, 0, target, staged)
    st.merge_batch(second, 1, target, staged)
    shutil.rmtree(tmp_path / "bars/current/day=2024-01-01")
    st.merge_batch(second, 1, target, staged)
    rows = sorted((r.ticker, r.close) for r in spark.read.parquet(f"{target}/current").collect())
    assert rows == [("a", 5.0), ("b", 2.0), ("c", 3.0)] and not (tmp_path / "staged/0").exists()
    # A stage that was not finished is made anew.
    (tmp_path / "staged/1/_SUCCESS").unlink()
    st.merge_batch(second, 1, target, staged)
    assert sorted((r.ticker, r.close) for r in spark.read.parquet(f"{target}/current").collect()) == rows


def test_alerts_are_put_out_once(spark, tmp_path):
    """A micro-batch that runs again (its commit is taken back) writes no alert twice."""
    rows = pd.DataFrame({"key": "k", "date": pd.date_range("2024-01-01", periods=8), "ic": [0.1, 0.01, 0.02, 0.0, 0.0, 0.05, 0.0, 0.0]})
    folder = tmp_path / "ic"
    folder.mkdir()
    for k in range(4):
        part = rows.iloc[2 * k : 2 * k + 2]
        part.assign(date=part.date.astype("datetime64[us]")).to_parquet(folder / f"{k}.parquet")
    out, state = str(tmp_path / "out"), tmp_path / "state"
    put = lambda: st.alert_outbox(st.ic_alerts(stream(spark, str(folder))), out, str(state)).awaitTermination()
    put()
    before = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert len(before) == 1 and before[0][2]
    last = max(int(p.name) for p in (state / "commits").iterdir() if p.name.isdigit())
    for p in (state / "commits").glob(f"*{last}*"):
        p.unlink()
    put()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == before
