"""Two-stage models over labelled events: adapters to Spark ML."""

from __future__ import annotations

import datetime
import functools
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.functions.shared import stored


class _Logistic(LogisticRegression):
    """Its models keep no training summary. That holds the session, which travels with every scoring task and cannot once
    the session has observed a frame or tagged a job (NotSerializableException); models read from a store have none either."""

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        model = super()._fit(dataset)
        model._java_obj.setSummary(dataset.sparkSession._jvm.scala.Option.empty())
        return model


def classifier(features: list[str], kind: str = "logistic", label: str = "label", **options) -> Pipeline:
    """Imputed features and a logistic (lasso) or boosted-tree classifier; options are the classifier's own settings."""
    filled = [f"{f}_filled" for f in features]
    stages = [Imputer(inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features")]
    if kind == "boosted":
        return Pipeline(stages=[*stages, GBTClassifier(**{"labelCol": label, "maxIter": 20, "maxDepth": 3, "seed": 42} | options)])
    return Pipeline(stages=[*stages, _Logistic(**{"labelCol": label, "regParam": 0.01, "elasticNetParam": 1.0 if kind == "lasso" else 0.0} | options)])


def probabilities(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1])


def tuned(rows: DataFrame, features: list[str], grid: dict[str, list], kind: str = "logistic", label: str = "label", fold: str = "fold", folds: int = 3) -> CrossValidatorModel:
    """The best of a grid of the classifier's settings by area under the curve over given folds (an int column from 0, cut by
    date by the caller, so that no fold is trained on its own dates)."""
    pipe = classifier(features, kind, label)
    last = pipe.getStages()[-1]
    settings = [dict(zip([last.getParam(p) for p in grid], values, strict=True)) for values in product(*grid.values())]
    own = CrossValidator(estimator=pipe, estimatorParamMaps=settings, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, foldCol=fold, seed=42)
    return own.fit(rows)


def two_stage(events: DataFrame, features: list[str], until: datetime.date | str, threshold: float = 0.65, least: int = 100) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """(ticker, t0, p1, p2) of the events from `until` on, and the two models: will a barrier be touched, and if so which.

    Both stages learn from events that end before `until` only (t1 < until), so no label overlaps what is scored. Stage two
    learns from the touched events that stage one is sure of, and from all touched ones where these are too few. $events
    has ticker, t0, t1, barrier_side and the features.
    """
    day = F.lit(until).cast("date")
    train = events.where(F.col("t1") < day).withColumn("label", (F.col("barrier_side") != 0).cast("double"))
    later = events.where(F.col("t0") >= day).select("ticker", "t0", *features)
    one = classifier(features).fit(train)
    touched = probabilities(one, train, "p1").select("barrier_side", *features, "p1").where("barrier_side <> 0")
    touched = touched.withColumn("label", (F.col("barrier_side") > 0).cast("double"))
    sure = touched.where(F.col("p1") > threshold)
    two = classifier(features).fit(sure if sure.count() >= least else touched)
    scored = probabilities(one, later, "p1").select("ticker", "t0", *features, "p1")
    return probabilities(two, scored, "p2").select("ticker", "t0", "p1", "p2"), {"touch": one, "side": two}


def save_models(models: dict[str, PipelineModel], path: str) -> None:
    """Each model in a folder of its name, in any store that Spark writes to."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")


def load_models(spark: SparkSession, path: str, names: tuple[str, ...] = ("touch", "side")) -> dict[str, PipelineModel]:
    return {name: PipelineModel.read().session(spark).load(f"{path}/{name}") for name in names}


def live_signals(scored: DataFrame, threshold: float = 0.65) -> DataFrame:
    """(ticker, date, position) of scored rows with p1, p2: 0 below the threshold, else the likelier side."""
    side = F.when(F.col("p2") > 0.5, 1).otherwise(-1)
    return scored.select("ticker", "date", F.when(F.col("p1") < threshold, 0).otherwise(side).alias("position"))


def date_folds(events: DataFrame, folds: int) -> DataFrame:
    """events with `fold`: consecutive stretches of their dates t0, each of as many dates as any other but for one."""
    place = Window.orderBy("t0")  # a row a date
    dates = events.select("t0").distinct().select("t0", (F.row_number().over(place) - 1).alias("_i"))
    n = dates.count()
    return events.join(dates, "t0").withColumn("fold", F.floor(F.col("_i") * folds / F.lit(max(n, 1))).cast("int")).drop("_i")


def apart(events: DataFrame, fold: int, purge: int = 0) -> DataFrame:
    """The events of other folds whose lives, from t0 to t1, touch neither those of this fold nor `purge` days on either side."""
    span = events.where(F.col("fold") == fold).agg(F.date_sub(F.min("t0"), purge).alias("_lo"), F.date_add(F.max("t1"), purge).alias("_hi"))
    rest = events.where(F.col("fold") != fold).crossJoin(F.broadcast(span))  # one row
    return rest.where((F.col("t1") < F.col("_lo")) | (F.col("t0") > F.col("_hi"))).drop("_lo", "_hi")


def stacked(
    events: DataFrame, features: list[str], folds: int = 4, purge: int = 10, kinds: dict[str, dict] | None = None, label: str = "label"
) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """(ticker, t0, t1, fold, label, p_<kind>, score) of every event by models that saw nothing of its time, and models of all events.

    Each fold of dates is scored by classifiers of all kinds that learnt from the events apart from it (see apart). A second level,
    a logistic regression over these scores, is crossed in the same way: an event's final score comes from the scores of the
    events apart from its fold. The models returned (one a kind, and `stack` over the crossed scores) are for later events:
    ensemble() applies them. events: ticker, t0, t1, label, features.
    """
    kinds = kinds or {"logistic": {}, "boosted": {}}
    make = lambda own, kind, more: classifier(own, kind.split("_")[0], label, **more)
    rows = stored(date_folds(events.select("ticker", "t0", "t1", label, *features), folds), "stack-events")
    parts = []
    for fold in range(folds):
        scored, train = rows.where(F.col("fold") == fold), apart(rows, fold, purge)
        for kind, more in kinds.items():
            model = make(features, kind, more).fit(train)
            scored = probabilities(model, scored, f"p_{kind}").drop("features", "rawPrediction", "probability", "prediction", *[f"{f}_filled" for f in features])
        parts.append(scored)
    names = [f"p_{k}" for k in kinds]
    keys = ["ticker", "t0", "t1", "fold", label]
    first = stored(functools.reduce(DataFrame.unionByName, [p.select(*keys, *names) for p in parts]), "stack-scores")
    second = []
    for fold in range(folds):
        level = classifier(names, label=label).fit(apart(first, fold, purge))
        second.append(probabilities(level, first.where(F.col("fold") == fold), "score").select(*keys, *names, "score"))
    models = {kind: make(features, kind, more).fit(rows) for kind, more in kinds.items()} | {"stack": classifier(names, label=label).fit(first)}
    return functools.reduce(DataFrame.unionByName, second), models


def ensemble(models: dict[str, PipelineModel], rows: DataFrame, name: str = "score") -> DataFrame:
    """rows with the score of stacked()'s models: each kind's probability, and the second level's over them."""
    columns = rows.columns
    kinds = [k for k in models if k != "stack"]
    for kind in kinds:
        rows = probabilities(models[kind], rows, f"p_{kind}").select(*columns, *[f"p_{k}" for k in kinds[: kinds.index(kind) + 1]])
    return probabilities(models["stack"], rows, name).select(*columns, *[f"p_{k}" for k in kinds], name)
