"""The fused feature table and as-of joins."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from loomframe.functions.asof import asof_join
from loomframe.functions.sqlsteps import Steps, fused, last
from loomframe.operators import features
from loomframe.sources.bars import bars

SF = "/root/testdata/sf0.001"


def test_names_that_mean_different_things():
    """A later chain's intermediate is renamed, equal ones are one, a column waits for what it reads, the first result stays."""
    one = Steps([{"r": "close - open"}, {"m": f"avg(r) {last(3)}"}, {"deep": "m * 2"}], ["m", "deep"], digits={"m": 3})
    two = Steps([{"r": "close / open", "x": "close"}, {"out": "r + x"}, {"m": "out"}], ["out", "m"], digits={"m": 5})
    three = Steps([{"r": "close - open"}, {"late": "deep + r"}], ["late"])
    got = fused([one, two, three])
    assert got.columns == ["m", "deep", "out", "late"] and got.digits == {"m": 3}
    where = {c: (k, e) for k, level in enumerate(got.levels) for c, e in level.items()}
    assert where["out"] == (1, "r__1 + x") and where["r"][0] == where["r__1"][0] == 0 and where["late"] == (3, "deep + r")


def test_one_exchange_for_the_whole_table(spark):
    panel = bars(spark, SF)
    table = features.feature_table(panel)
    text = table._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Scan parquet") == 1 and "SinglePartition" not in text
    assert len(table.columns) == 2 + len(features.feature_chain().columns) + 5 and len(set(table.columns)) == len(table.columns)


def test_the_table_has_the_families_columns(spark):
    """Each family by itself gives the same values, whatever its intermediates are called beside the others."""
    panel = bars(spark, SF).where("ticker IN ('Brand#11', 'Brand#2')").cache()
    table = features.feature_table(panel).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    for name, steps in features.families().items():
        if name[:3] in ("t03", "t12", "m10", "m13", "v04", "v06", "v07", "v08"):
            own = steps.apply(panel).select("ticker", "date", *steps.columns).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
            for c in steps.columns:
                assert np.allclose(table[c].astype(float), own[c].astype(float), equal_nan=True, rtol=1e-12, atol=1e-12), (name, c)
    panel.unpersist()


def plain(left, right, tolerance, forward, strict):
    out = []
    for k, t, x in left:
        best = None
        for rk, rt, v in right:
            if k is None or t is None or rk != k or rt is None:
                continue
            gap = (rt - t if forward else t - rt).total_seconds()
            if gap < 0 or (strict and gap == 0) or (tolerance is not None and gap > tolerance):
                continue
            if best is None or gap < best[0] or (gap == best[0] and v > best[1]):
                best = (gap, v)
        out.append((k, t, x, best[1] if best else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_against_every_pair(spark, forward, strict):
    """A key with most rows, repeated times and rows, gaps longer than a bucket, nulls in keys and times, buckets of any width."""
    rng, day = random.Random(7), dt.datetime(2024, 1, 1)
    at = lambda: rng.choice([None, *[day + dt.timedelta(hours=rng.choice([rng.randint(0, 40), rng.randint(900, 960)])) for _ in range(9)]])
    key = lambda: rng.choice(["hot"] * 8 + ["b", "c", None])
    left = [(key(), at(), i) for i in range(150)] + [("hot", day, 1)] * 2 + [("lone", day, 2)]
    right = [(key(), at(), i % 40) for i in range(120)]
    a, b = spark.createDataFrame(left, "k string, t timestamp, `_row` int"), spark.createDataFrame(right, "k string, t timestamp, v int")
    for tolerance, width in ((None, 3600.0), (7200, 86_400), (None, 1e9)):
        got = asof_join(a, b, ["k"], "t", ["v"], tolerance, width, forward, strict)
        assert got.columns == ["k", "t", "_row", "v"]
        assert sorted(map(tuple, got.collect()), key=str) == plain(left, right, tolerance, forward, strict)


def test_asof_deals_a_hot_key(spark):
    """No group of the window holds more than a bucket's rows: the frame is partitioned by key and bucket."""
    a = spark.range(5000).selectExpr("1 AS k", "timestamp_seconds(id * 60) AS t", "id")
    b = spark.range(500).selectExpr("1 AS k", "timestamp_seconds(id * 600) AS t", "id AS v")
    got = asof_join(a, b, ["k"], "t", ["v"], width=3600)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_k0" in text and "_b" in text and got.where("v != id div 10").count() == 0 and got.count() == 5000
    empty = asof_join(a.limit(0), b, ["k"], "t", ["v"])
    assert empty.count() == 0 and asof_join(a, b.limit(0), ["k"], "t", ["v"]).where("v IS NULL").count() == 5000


def test_asof_of_dates(spark):
    days = pd.date_range("2024-01-01", periods=9).date
    a, b = spark.createDataFrame([(d,) for d in days], "d date").selectExpr("1 AS k", "d"), spark.createDataFrame([(days[2], 2), (days[5], 5)], "d date, v int").selectExpr("1 AS k", "d", "v")
    got = asof_join(a, b, ["k"], "d", ["v"], 2 * 86_400)
    assert [r.v for r in got.orderBy("d").collect()] == [None, None, 2, 2, 2, 5, 5, 5, None]


@pytest.mark.parametrize("query", ["s02_bucketed_technical", "s02_bucketed_training_set"])
def test_bucketed_panels_plan_no_exchange(spark, query):
    """Neither windows by ticker nor a join by ticker and date moves a row; the values are those of the plain panel."""
    from loomframe.plans import research

    got = research.QUERIES[query](spark, SF)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Bucketed: true" in text
    plain = {"s02_bucketed_technical": "t20_all", "s02_bucketed_training_set": "l10_training_set"}[query]
    from loomframe.plans import registry

    want = registry.QUERIES[plain](spark, SF)
    key = list(want.columns[:2])
    a, b = (d.toPandas().sort_values(key).reset_index(drop=True) for d in (got, want))
    pd.testing.assert_frame_equal(a, b, check_exact=True)
