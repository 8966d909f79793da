"""Search over settings: proposals from two kernel densities, trials cut short by a median rule, folds scored in Spark."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions.shared import stored
from loomframe.functions.template import Template

from .splits import DATES


@dataclass(frozen=True)
class Number:
    """A setting from lo to hi; on a logarithmic scale, or in whole numbers."""

    lo: float
    hi: float
    log: bool = False
    whole: bool = False

    def inner(self, value: float) -> float:
        """The value on the scale where densities are taken, as a share of the range."""
        f = math.log if self.log else float
        return (f(value) - f(self.lo)) / (f(self.hi) - f(self.lo))

    def outer(self, share: float) -> float:
        share = min(max(share, 0.0), 1.0)
        if self.log:
            value = math.exp(math.log(self.lo) + share * (math.log(self.hi) - math.log(self.lo)))
        else:
            value = self.lo + share * (self.hi - self.lo)
        return int(round(value)) if self.whole else value


@dataclass(frozen=True)
class Choice:
    options: tuple


@dataclass
class Trial:
    number: int
    settings: dict
    scores: list[float] = field(default_factory=list)  # a fold each, in order
    pruned: bool = False

    def running(self, folds: int) -> float:
        """The mean of the first folds' scores."""
        return sum(self.scores[:folds]) / folds

    @property
    def value(self) -> float:
        return self.running(len(self.scores))


class Density:
    """A mixture of normal curves on [0, 1], one about each point as wide as the farther of its neighbours is away, and a broad one."""

    def __init__(self, points: list[float]) -> None:
        centres = np.array(sorted([*points, 0.5]))
        edges = np.concatenate([[0.0], centres, [1.0]])
        gaps = np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1])
        broad = np.searchsorted(centres, 0.5)
        self.centres, self.widths = centres, np.clip(gaps, 1 / min(100, 2 + len(centres)), 1.0)
        self.widths[broad] = 1.0

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        k = rng.integers(0, len(self.centres), n)
        return np.clip(rng.normal(self.centres[k], self.widths[k]), 0.0, 1.0)

    def log(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.centres) / self.widths
        erf = np.vectorize(math.erf)
        inside = (erf((1 - self.centres) / self.widths / math.sqrt(2)) - erf((0 - self.centres) / self.widths / math.sqrt(2))) / 2
        return np.log(np.mean(np.exp(-z * z / 2) / (self.widths * math.sqrt(2 * math.pi) * inside), axis=1) + 1e-300)


def propose(space: dict, trials: list[Trial], rng: np.random.Generator, startup: int = 5, draws: int = 24) -> dict:
    """Settings of the next trial: at random at first; then, setting by setting, of some draws from the density of good trials the one
    with the largest ratio to the density of the others. Good are the best quarter, pruned trials by the folds they have."""
    done = sorted((t for t in trials if t.scores), key=lambda t: -t.value)
    out = {}
    for name, kind in space.items():
        options = kind.options if isinstance(kind, Choice) else None
        if len(done) < startup:
            out[name] = options[rng.integers(len(options))] if options else kind.outer(rng.random())
            continue
        n = math.ceil(len(done) / 4)
        good, rest = [t.settings[name] for t in done[:n]], [t.settings[name] for t in done[n:]]
        if options:
            share = lambda own: np.array([1 + sum(x == o for x in own) for o in options]) / (len(own) + len(options))
            k = rng.choice(len(options), draws, p=share(good))
            out[name] = options[int(k[np.argmax(np.round(share(good) / share(rest), 12)[k])])]
        else:
            own, other = Density([kind.inner(x) for x in good]), Density([kind.inner(x) for x in rest])
            x = own.draw(rng, draws)
            out[name] = kind.outer(float(x[np.argmax(own.log(x) - other.log(x))]))
    return out


def below_median(trial: Trial, trials: list[Trial], startup: int = 5, warmup: int = 1) -> bool:
    """Whether a trial's running mean is under the median of those of all whole trials after as many folds."""
    n, whole = len(trial.scores), [t for t in trials if not t.pruned and t is not trial]
    return n > warmup and len(whole) >= startup and trial.running(n) < float(np.median([t.running(n) for t in whole]))


def search(objective: Callable[[dict, int], float], space: dict, folds: int, trials: int, seed: int = 42, startup: int = 5, warmup: int = 1) -> list[Trial]:
    """Trials of settings by objective(settings, fold), larger is better; a trial ends early where the median rule says so.

    The same seed and the same scores give the same trials. Scores are rounded to nine digits, so that the order in which Spark
    adds numbers up does not turn a comparison.
    """
    rng, out = np.random.default_rng(seed), []
    for number in range(trials):
        trial = Trial(number, propose(space, out, rng, startup))
        for fold in range(folds):
            trial.scores.append(round(float(objective(trial.settings, fold)), 9))
            if fold + 1 < folds and below_median(trial, out, startup, warmup):
                trial.pruned = True
                break
        out.append(trial)
    return out


def best(trials: list[Trial]) -> Trial:
    return max((t for t in trials if not t.pruned), key=lambda t: (t.value, -t.number))


def purged_rows(scored: DataFrame, columns: list[str], folds: int, purge: int = 21) -> DataFrame:
    """(fold, part, day, fwd, columns) of known rows in each fold of dates: `test` in it, `train` before it but for the purged dates.

    Dates are cut into folds + 1 equal stretches; the first only trains. A row a date is joined, so panel rows move once.
    """
    known = scored.where(" AND ".join(f"{c} IS NOT NULL" for c in [*columns, "fwd"])).select("date", "fwd", *columns)
    cut = Template(f"""WITH d AS ({DATES}), f AS (SELECT INTSEQ(0, {folds - 1}) AS fold),
e AS (SELECT d.date, d.i, fold, ceil((fold + 1) * n / {folds + 1}e0) AS lo, ceil((fold + 2) * n / {folds + 1}e0) AS hi FROM d CROSS JOIN f)
SELECT CAST(fold AS INT) AS fold, date, CAST(i AS DOUBLE) AS day, CASE WHEN i < lo - {purge} THEN 'train' ELSE 'test' END AS part
FROM e WHERE i < lo - {purge} OR (i >= lo AND i < hi)""").apply(scored.sparkSession, panel=scored)
    return known.join(cut, "date").select("fold", "part", "date", "day", "fwd", *columns)


def ridge_objective(rows: DataFrame, columns: list[str]) -> Callable[[dict, int], float]:
    """objective(settings, fold) of a ridge regression of fwd on the columns, settings: penalty, clip (deviations), half_life (dates).

    Columns are standardised and clipped by the training rows; these count half as much each half_life dates before the last of
    them. Moments of all folds are one aggregate, a fit is one of products over its training rows (a few numbers a fold leave
    Spark), the score the yearly Sharpe ratio of the mean of sign(prediction) * fwd a test date.
    """
    rows = stored(rows, "search-rows")
    spread = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    moments = {r["fold"]: r for r in rows.where("part = 'train'").groupBy("fold").agg(F.max("day").alias("last"), *spread).collect()}

    def objective(settings: dict, fold: int) -> float:
        own = rows.where(F.col("fold") == fold)
        train = own.where("part = 'train'")
        if (moment := moments.get(fold)) is None:
            return 0.0
        clip = settings.get("clip", 3.0)

        def level(c: str):
            z = (F.col(c) - moment[f"m_{c}"]) / (moment[f"s_{c}"] or 1.0)
            return F.greatest(F.least(z, F.lit(clip)), F.lit(-clip))

        z = {c: level(c) for c in columns}
        weight = F.pow(F.lit(0.5), (moment["last"] - F.col("day")) / settings.get("half_life", 1e9))
        sums = {f"{a}_{b}": F.sum(weight * z[a] * z[b]) for i, a in enumerate(columns) for b in columns[i:]}
        sums |= {f"y_{a}": F.sum(weight * z[a] * F.col("fwd")) for a in columns} | {"w": F.sum(weight)}
        got = train.agg(*[e.alias(k) for k, e in sums.items()]).first()
        gram = np.array([[got[f"{a}_{b}"] if columns.index(a) <= columns.index(b) else got[f"{b}_{a}"] for b in columns] for a in columns]) / got["w"]
        beta = np.linalg.solve(gram + settings["penalty"] * np.eye(len(columns)), np.array([got[f"y_{a}"] for a in columns]) / got["w"])
        score = sum((F.lit(float(b)) * z[c] for b, c in zip(beta, columns, strict=True)), F.lit(0.0))
        daily = own.where("part = 'test'").groupBy("date").agg(F.avg(F.signum(score) * F.col("fwd")).alias("ret"))
        made = daily.agg((F.avg("ret") / (F.stddev_pop("ret") + 1e-10)).alias("sharpe")).first()["sharpe"]
        return 0.0 if made is None else made * math.sqrt(252)

    return objective


def trial_rows(spark, trials: list[Trial], names: list[str]) -> DataFrame:
    """(trial, fold, settings, score, running, pruned, chosen), a row a fold that was fitted."""
    top = best(trials).number
    rows = [
        (t.number, k, *[float(t.settings[n]) for n in names], s, round(t.running(k + 1), 9), t.pruned, t.number == top) for t in trials for k, s in enumerate(t.scores)
    ]
    ddl = "trial int, fold int, " + ", ".join(f"{n} double" for n in names) + ", score double, running double, pruned boolean, chosen boolean"
    return spark.createDataFrame(rows, ddl)
