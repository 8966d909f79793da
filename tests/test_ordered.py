"""Ranks, numbers and windows over columns and histories that no task holds."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomframe.functions import ordered
from loomframe.operators import backtest, indicators, metrics, microstructure, splits, technical
from loomframe.plans import research
from loomframe.sources.bars import bars

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rounded_frame(df, by):
    return df.toPandas().sort_values(by).reset_index(drop=True)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_average_ranks_equal_pandas_on_heavy_ties(spark, by):
    """A third of all values equal, nulls, NaN, signed zeros, a group of one row."""
    rng = np.random.default_rng(4)
    x = np.where(rng.random(5000) < 0.35, 0.0, np.round(rng.normal(size=5000), 1))
    x[:200] = -0.0
    rows = pd.DataFrame({"id": np.arange(5000), "g": np.where(np.arange(5000) == 7, "lone", np.where(rng.random(5000) < 0.9, "hot", "cold")), "x": x})
    df = spark.createDataFrame(rows).withColumn("x", F.when(F.col("id") % 50 == 3, None).when(F.col("id") % 50 == 4, float("nan")).otherwise(F.col("x")))
    got = ordered.average_ranks(df, {"x": "rank"}, by).orderBy("id").toPandas()
    rows.loc[rows.id % 50 == 3, "x"] = rows.loc[rows.id % 50 == 4, "x"] = np.nan
    want = (rows.groupby("g").x if by else rows.x).rank()
    assert len(got) == 5000 and np.allclose(got["rank"].astype(float), want, equal_nan=True)


def test_ranks_order_no_panel_in_one_task(spark, monkeypatch):
    """What meets in a single partition are counts of ranges, dates and runs, never rows of the panel."""
    scored = research.SCORED.apply(spark, panel=bars(spark, SF))
    whole = plan(metrics.whole_ic(scored))
    for part in re.findall(r"\+- Window.*?Exchange (?:SinglePartition|hashpartitioning\([^)]*\))", whole, re.S):
        assert "_range" in part or "SinglePartition" not in part
    assert splits.evaluate(scored).count() == 15


def test_numbers_of_a_hot_key(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 70).otherwise(-1).alias("k"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("t"))
    got = ordered.numbered(rows, ["k"], ["t"]).toPandas().sort_values(["k", "t", "_pos"])
    assert len(got) == 20_000 and (got._pos == got.groupby("k").cumcount()).all()
    assert ordered.numbered(rows.limit(0), ["k"], ["t"]).count() == 0


HISTORY = """SELECT if(id % 10 < 9, 'hot', concat('t', id % 30)) AS ticker, timestamp_seconds(1.7e9 + 60 * id) AS date, c AS open, c + 1 AS high, c - 1 AS low, c AS close,
  CAST(100 + id % 37 AS DOUBLE) AS volume FROM (SELECT id, 100 + 10 * sin(id / 9e0) + pmod(xxhash64(id), 100) / 20e0 AS c FROM range({n}))"""
CHAINS = {
    "all": technical.compute_all, "stats": indicators.rolling_stats, "filters": lambda: indicators.fracdiff((0.5,)), "illiquidity": microstructure.amihud,
    "ahead": lambda: ordered.Steps([{"next": "lead(close, 3) OVER (PARTITION BY ticker ORDER BY date)"}, {"up": "next / lag(close, 2) OVER (PARTITION BY ticker ORDER BY date)"}]),
}


@pytest.mark.parametrize("name", sorted(CHAINS))
def test_blocks_equal_whole_histories(spark, name):
    """A ticker with 90 % of the rows, blocks shorter and longer than the reach of the windows: the same to the last bit."""
    panel, steps = spark.sql(HISTORY.format(n=3000)), CHAINS[name]()
    want = rounded_frame(steps.result(panel), ["ticker", "date"])
    for size in (1, 700):
        got = rounded_frame(ordered.in_blocks(steps, panel, size), ["ticker", "date"])
        pd.testing.assert_frame_equal(got[want.columns], want, check_exact=True)


def test_a_hot_ticker_is_dealt_evenly(spark, monkeypatch):
    """No group of the windows holds more than a block and what it borrows."""
    seen = []
    monkeypatch.setattr(ordered.Steps, "result", lambda self, df: seen.append(df) or df)
    steps = indicators.rolling_stats()
    ordered.in_blocks(steps, spark.sql(HISTORY.format(n=30_000)), 500)
    groups = [r["count"] for r in seen[0].groupBy("ticker", "_block").count().collect()]
    back, _ = ordered.reach(steps)
    assert back == 49 and max(groups) <= 500 + back and sum(groups) < 1.2 * 30_000 and len(groups) > 50


def test_reach():
    lag = "OVER (PARTITION BY ticker ORDER BY date)"
    steps = ordered.Steps([{"r": f"close / lag(close) {lag} - 1", "z": f"lag(greatest(open, close), 4) {lag}"}, {"m": f"avg(r) {ordered.Steps.__name__ and 'OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND 2 FOLLOWING)'}"}])
    assert ordered.reach(steps) == (13, 2)
    with pytest.raises(ValueError, match="whole history"):
        ordered.reach(indicators.expanding_zscore())


@pytest.mark.parametrize("run, scans", [("b09_result", 2), ("b10_walk_forward", 5), ("k17_acceptance_gate", 2)])
def test_runs_are_one_chain(spark, run, scans):
    """A run reads the panel twice, the second time for its dates; splits read their dates beside it. Panel rows meet no range join."""
    text = plan(research.QUERIES[run](spark, SF))
    assert text.count("Scan parquet") <= scans
    joined = re.findall(r"(?:BroadcastNestedLoopJoin|CartesianProduct)[^\n]*", text)
    assert len(joined) <= (2 if run == "b10_walk_forward" else 0) and all("lo#" in j for j in joined)
    assert not hasattr(backtest, "_turned")
