"""Stacks crossed over folds of dates, and a live run."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomframe.operators import live, models


def planted(n=600, seed=4):
    rng = np.random.default_rng(seed)
    t0 = pd.bdate_range("2020-01-01", periods=n // 2).repeat(2)
    a, b = rng.normal(size=n), rng.normal(size=n)
    label = (a * 1.5 + np.where(b > 0, 1.5, -1.5) + 0.5 * rng.normal(size=n) > 0).astype(float)
    return pd.DataFrame({"ticker": ["A", "B"] * (n // 2), "t0": t0.date, "t1": (t0 + pd.Timedelta(days=9)).date, "label": label, "a": a, "b": b})


def area(score, label):
    rank = pd.Series(score).rank()
    up = label == 1
    return (rank[up].sum() - up.sum() * (up.sum() + 1) / 2) / (up.sum() * (~up).sum())


KINDS = {"logistic": {}, "boosted": {"maxIter": 4}}


def test_no_training_life_touches_a_scored_fold(spark):
    events = models.date_folds(spark.createDataFrame(planted()), 4).toPandas()
    sizes = events.groupby("fold").t0.nunique()
    assert list(sizes) == [75] * 4 and events.groupby("fold").t0.max()[0] < events.groupby("fold").t0.min()[1]
    for fold in range(4):
        train = models.apart(spark.createDataFrame(events), fold, purge=5).toPandas()
        own = events[events.fold == fold]
        lo, hi = own.t0.min() - dt.timedelta(5), own.t1.max() + dt.timedelta(5)
        assert len(train) and ((train.t1 < lo) | (train.t0 > hi)).all()
        gone = events[events.fold != fold].merge(train[["ticker", "t0"]], how="left", indicator=True, on=["ticker", "t0"]).query("_merge == 'left_only'")
        assert ((gone.t1 >= lo) & (gone.t0 <= hi)).all() and len(gone)


def test_the_stack_finds_a_planted_signal_without_seeing_its_fold(spark):
    """Turning the labels of a fold and of the lives that touch it changes none of its scores; the models given score later events."""
    rows = planted()
    scored, fitted = models.stacked(spark.createDataFrame(rows), ["a", "b"], 3, 5, KINDS)
    got = scored.toPandas().sort_values(["t0", "ticker"]).reset_index(drop=True)
    assert len(got) == 600 and area(got.score, got.label) > 0.9
    assert area(got.score, got.label) >= max(area(got.p_logistic, got.label), area(got.p_boosted, got.label)) - 0.02
    own = got[got.fold == 1]
    near = (rows.t1 >= own.t0.min() - dt.timedelta(5)) & (rows.t0 <= own.t1.max() + dt.timedelta(5))
    again, _ = models.stacked(spark.createDataFrame(rows.assign(label=np.where(near, 1 - rows.label, rows.label))), ["a", "b"], 3, 5, KINDS)
    again = again.where("fold = 1").toPandas().sort_values(["t0", "ticker"])
    assert np.allclose(again[["p_logistic", "p_boosted"]], own[["p_logistic", "p_boosted"]])
    later = planted(seed=9)
    new = models.ensemble(fitted, spark.createDataFrame(later)).toPandas().sort_values(["t0", "ticker"])
    assert area(new.score.reset_index(drop=True), later.sort_values(["t0", "ticker"]).label.reset_index(drop=True)) > 0.9


def test_live_run(spark, tmp_path):
    """The last date not after the day, positions by both thresholds, weights over volatility, and the same file again."""
    rows = planted()
    train = spark.createDataFrame(rows.assign(barrier_side=np.where(rows.label == 1, 1, np.where(rows.a > 0, -1, 0))))
    _, fitted = models.two_stage(train, ["a", "b"], rows.t0.iloc[400], least=10)
    models.save_models(fitted, str(tmp_path / "m"))
    features = spark.createDataFrame(
        [(f"T{i}", dt.date(2024, 1, d), float(i - 5), float(5 - i), v) for d in (4, 5, 9) for i, v in enumerate([0.1, 0.2, 0.4, None, 0.0, 0.1, 0.1, 0.2, 0.2, 0.3, 0.1])],
        "ticker string, date date, a double, b double, vol double",
    )
    for _ in range(2):
        signals, figures = live.run(features, models.load_models(spark, str(tmp_path / "m")), dt.date(2024, 1, 7), str(tmp_path))
        got, of = signals.toPandas().sort_values("ticker"), figures.first()
        assert (got.date == dt.date(2024, 1, 5)).all() and len(got) == of.n_signals == 11 and of.path.endswith("signals_20240105")
        want = np.where(got.p1 < 0.65, 0, np.where(got.p2 > 0.5, 1, -1))
        assert (got.position == want).all() and of.n_long == (want == 1).sum() and of.n_short == (want == -1).sum() and (want != 0).any()
        raw = np.where(got.vol > 0, want / got.vol, 0.0)
        assert np.allclose(got.weight, raw / np.abs(raw).sum()) and np.isclose(got.weight.abs().sum(), 1)
    assert live.snapshot(features, dt.date(2020, 1, 1)).count() == 0
    none = live.scaled(features.withColumn("position", F.lit(0)))
    assert none.where("weight != 0").count() == 0
