"""Proposals, the median rule and folds, against a plain version of each."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomframe.operators import search

SPACE = {"x": search.Number(0.01, 100, log=True), "k": search.Number(1, 30, whole=True), "kind": search.Choice(("a", "b", "c"))}


def objective(settings, fold):
    """Best at x = 1, k = 12, kind b; folds differ a little."""
    return -(math.log(settings["x"]) ** 2) - abs(settings["k"] - 12) / 5 + (settings["kind"] == "b") + 0.01 * fold


def replay(trials, folds, seed, startup=5, warmup=1):
    """The search written out again in plain loops: densities by sums over points, the rule by a sorted middle."""
    rng, past = np.random.default_rng(seed), []
    normal = lambda x, c, w: math.exp(-((x - c) ** 2) / (2 * w * w)) / (w * math.sqrt(2 * math.pi))
    mass = lambda c, w: 0.5 * (math.erf((1 - c) / (w * math.sqrt(2))) + math.erf(c / (w * math.sqrt(2))))

    def curves(points):
        rows = sorted([(p, False) for p in points] + [(0.5, True)], key=lambda r: (r[0], not r[1]))
        at = [r[0] for r in rows]
        wide = [max(c - (at[i - 1] if i else 0.0), (at[i + 1] if i + 1 < len(at) else 1.0) - c) for i, c in enumerate(at)]
        wide = [min(max(w, 1 / min(100, 2 + len(at))), 1.0) for w in wide]
        return [(c, 1.0 if r[1] else w) for c, w, r in zip(at, wide, rows, strict=True)]

    for t in trials:
        ranked = sorted(past, key=lambda r: -np.mean(r[1]))
        cut = math.ceil(len(ranked) / 4)
        want = {}
        for name, kind in SPACE.items():
            if len(ranked) < startup:
                want[name] = kind.options[rng.integers(3)] if name == "kind" else kind.outer(rng.random())
            elif name == "kind":
                good, rest = ([r[0][name] for r in part] for part in (ranked[:cut], ranked[cut:]))
                p = {o: ((1 + good.count(o)) / (len(good) + 3), (1 + rest.count(o)) / (len(rest) + 3)) for o in kind.options}
                drawn = [kind.options[i] for i in rng.choice(3, 24, p=[p[o][0] for o in kind.options])]
                want[name] = max(drawn, key=lambda o: round(p[o][0] / p[o][1], 12))
            else:
                good, rest = (curves([kind.inner(r[0][name]) for r in part]) for part in (ranked[:cut], ranked[cut:]))
                pick = rng.integers(0, len(good), 24)
                drawn = np.clip(rng.normal([good[i][0] for i in pick], [good[i][1] for i in pick]), 0, 1)
                like = lambda x, own: sum(normal(x, c, w) / mass(c, w) for c, w in own) / len(own)
                want[name] = kind.outer(max(drawn, key=lambda x: math.log(like(x, good)) - math.log(like(x, rest))))
        scores, cutoff = [], False
        for fold in range(folds):
            scores.append(round(objective(want, fold), 9))
            whole = sorted(np.mean(r[1][: fold + 1]) for r in past if not r[2])
            middle = (whole[len(whole) // 2] + whole[(len(whole) - 1) // 2]) / 2 if whole else 0
            if fold + 1 < folds and fold + 1 > warmup and len(whole) >= startup and np.mean(scores) < middle:
                cutoff = True
                break
        past.append((want, scores, cutoff))
        yield t, want, scores, cutoff


@pytest.mark.parametrize("seed", [1, 42])
def test_trials_are_those_of_a_plain_version(seed):
    trials = search.search(objective, SPACE, 5, 40, seed)
    for t, settings, scores, pruned in replay(trials, 5, seed):
        assert t.settings["kind"] == settings["kind"] and t.settings["k"] == settings["k"] and math.isclose(t.settings["x"], settings["x"], rel_tol=1e-9)
        assert np.allclose(t.scores, scores) and t.pruned == pruned


def test_fewer_fits_than_a_grid_for_a_better_score():
    """Over six seeds: each run fits fewer folds than the grid and cuts trials short, and the middle one's score is better."""
    grid = [{"x": x, "k": k, "kind": o} for x in (0.01, 0.1, 1.5, 10, 100) for k in (1, 8, 15, 22, 30) for o in "abc"]
    best_of_grid = max(np.mean([objective(s, f) for f in range(5)]) for s in grid)
    runs = [search.search(objective, SPACE, 5, 60, seed) for seed in (1, 2, 3, 4, 5, 42)]
    assert all(any(t.pruned for t in r) and sum(len(t.scores) for t in r) < 5 * len(grid) for r in runs)
    assert np.median([search.best(r).value for r in runs]) > best_of_grid and not any(search.best(r).pruned for r in runs)


def test_ridge_over_purged_folds(spark):
    """The objective against NumPy on the same folds; training dates end `purge` dates before the test."""
    rng = np.random.default_rng(3)
    dates = pd.bdate_range("2020-01-01", periods=90)
    rows = pd.DataFrame([(d.date(), a, rng.normal(), rng.normal() * 3 + 1) for d in dates for a in range(12)], columns=["date", "t", "a", "b"])
    rows["fwd"] = 0.4 * rows.a - 0.05 * rows.b + rng.normal(size=len(rows))
    df = search.purged_rows(spark.createDataFrame(rows).withColumn("a", F.expr("CASE WHEN t = 3 THEN NULL ELSE a END")), ["a", "b"], 2, purge=5)
    own = df.toPandas()
    assert set(own[(own.fold == 0) & (own.part == "train")].day) == set(range(25)) and set(own[(own.fold == 1) & (own.part == "test")].day) == set(range(60, 90))
    got = search.ridge_objective(df, ["a", "b"])({"penalty": 0.1, "clip": 2.0, "half_life": 20.0}, 1)
    train, test = own[(own.fold == 1) & (own.part == "train")], own[(own.fold == 1) & (own.part == "test")]
    z = lambda f: ((f[["a", "b"]] - train[["a", "b"]].mean()) / train[["a", "b"]].std(ddof=0)).clip(-2, 2).to_numpy()
    w = 0.5 ** ((train.day.max() - train.day.to_numpy()) / 20)
    x = z(train)
    beta = np.linalg.solve((x * w[:, None]).T @ x / w.sum() + 0.1 * np.eye(2), (x * w[:, None]).T @ train.fwd / w.sum())
    daily = (np.sign(z(test) @ beta) * test.fwd).groupby(test.date).mean()
    assert math.isclose(got, daily.mean() / (daily.std(ddof=0) + 1e-10) * math.sqrt(252), rel_tol=1e-6) and got > 3
