"""MLlib baselines: fit, search parameters on validation, repeat over seeds, keep predictions as a table."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timetab.operators.joins import null_safe_join
from timetab.plans.boosting import fit_histogram
from timetab.plans.leaderboard import ensemble_mean
from timetab.plans.metrics import DEFAULT_SCORE, FAILED_SCORE, SCORES, all_finite, all_scores, regression_metrics, signed_score
from timetab.session import JOBS_AT_ONCE, side_by_side
from timetab.sources.runs import load_predictions, save_predictions


def fit_linear(train: DataFrame, task: str, params: dict, seed: int = 0) -> Model:
    """Elastic-net linear or logistic regression. The solver is deterministic, the seed has no effect."""
    kind = LinearRegression if task == "regression" else LogisticRegression
    return kind(
        featuresCol="features", labelCol="y", regParam=params.get("reg", 0.0), elasticNetParam=params.get("l1_share", 0.0),
        maxIter=params.get("max_iter", 100),
    ).fit(train)


def fit_forest(train: DataFrame, task: str, params: dict, seed: int = 0) -> Model:
    kind = RandomForestRegressor if task == "regression" else RandomForestClassifier
    return kind(
        featuresCol="features", labelCol="y", numTrees=params.get("trees", 20), maxDepth=params.get("depth", 5),
        minInstancesPerNode=params.get("leaf_rows", 1), maxBins=params.get("bins", 32), bootstrap=params.get("bootstrap", True), seed=seed,
    ).fit(train)


def fit_boosted(train: DataFrame, task: str, params: dict, seed: int = 0, val: DataFrame | None = None) -> Model:
    """Boosted trees, cut after the round with the lowest loss on ``val``.

    All rounds are fitted once. The first trees of a run are those of a shorter run, so the model of the best round is made
    of the first trees and their weights. The model ``histogram`` stops early instead and knows several classes.
    """
    if task == "multiclass":
        raise ValueError("MLlib's boosted trees tell two classes apart; take histogram, a forest or a linear model")
    kind = GBTRegressor if task == "regression" else GBTClassifier
    model = kind(
        featuresCol="features", labelCol="y", maxIter=params.get("rounds", 20), maxDepth=params.get("depth", 5),
        stepSize=params.get("rate", 0.1), subsamplingRate=params.get("row_share", 1.0), seed=seed,
    ).fit(train)
    if val is None:
        return model
    loss = model.evaluateEachIteration(val, *(["squared"] if task == "regression" else []))
    return FirstTrees(model, min(range(len(loss)), key=loss.__getitem__) + 1, task)


class FirstTrees:
    """The first ``rounds`` trees of a boosted model."""

    def __init__(self, model: Model, rounds: int, task: str):
        self.model, self.rounds, self.task = model, rounds, task
        self.trees, self.weights = model.trees[:rounds], model.treeWeights[:rounds]

    @property
    def getNumTrees(self) -> int:  # noqa: N802  as MLlib's models call it
        return self.rounds

    @property
    def featureImportances(self):  # noqa: N802
        """As MLlib does for ensembles: each tree's importances sum to one, their mean is normalised."""
        from pyspark.ml.linalg import Vectors

        total = sum(t.featureImportances.toArray() for t in self.trees)
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    def transform(self, data: DataFrame) -> DataFrame:
        """Adds ``prediction``, and for classes ``probability``, from the weighted sum of the trees."""
        out = data
        for i, tree in enumerate(self.trees):
            own = tree.copy({tree.predictionCol: f"_tree_{i}"})
            out = own.transform(out)
        total = sum((F.col(f"_tree_{i}") * w for i, w in enumerate(self.weights)), F.lit(0.0))
        out = out.withColumn("_total", total).drop(*[f"_tree_{i}" for i in range(self.rounds)])
        if self.task == "regression":
            return out.withColumnRenamed("_total", "prediction")
        # The margin of the two-class loss: the probability of class 1 is the logistic function of twice the sum.
        one = 1.0 / (1.0 + F.exp(-2.0 * F.col("_total")))
        return out.withColumns({
            "probability": array_to_vector(F.array(1.0 - one, one)), "prediction": (F.col("_total") > 0).cast("double"),
        }).drop("_total")


FITTERS: dict[str, Callable[..., Model]] = {"linear": fit_linear, "forest": fit_forest}
WATCHED: dict[str, Callable[..., Model]] = {"boosted": fit_boosted, "histogram": fit_histogram}  # these look at part val


TASK_VALUES = 1 << 23  # numbers of training rows in one task, ROW_VALUES being what a row costs besides its features
ROW_VALUES = 8


def training_rows(data: DataFrame, part: str) -> DataFrame:
    """Rows of a part, dealt out to all cores, in tasks of ``TASK_VALUES`` numbers at most, and kept while models are fitted.

    Persisted rows of a lost executor are read again from the input.
    """
    rows = data.where(F.col("part") == part).select("features", "y")
    first = rows.first()
    width = ROW_VALUES + (first["features"].size if first is not None and first["features"] is not None else 0)
    tasks = max(data.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * width // TASK_VALUES))
    return rows.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)


def fits_at_once(train: DataFrame, most: int) -> int:
    """How many fits run side by side: ``most`` where one leaves cores idle between its steps, fewer as its tasks fill the cores by
    themselves, since each fit keeps a copy of the rows."""
    return max(1, min(most, most * train.sparkSession.sparkContext.defaultParallelism // train.rdd.getNumPartitions()))


@contextmanager
def kept_rows(data: DataFrame, model: str):
    """``(train, val)`` for any number of fits; boosted trees also watch part val."""
    train = training_rows(data, "train")
    val = training_rows(data, "val") if model in WATCHED else None
    try:
        yield train, val
    finally:
        train.unpersist()
        if val is not None:
            val.unpersist()


def _fit_on(model: str, rows: tuple[DataFrame, DataFrame | None], task: str, params: dict, seed: int) -> Model:
    if model in WATCHED:
        return WATCHED[model](rows[0], task, params, seed, rows[1])
    return FITTERS[model](rows[0], task, params, seed)


def fit(model: str, data: DataFrame, task: str, params: dict, seed: int = 0) -> Model:
    """Fit on the rows of part train."""
    with kept_rows(data, model) as rows:
        return _fit_on(model, rows, task, params, seed)


def predict(model: Model, data: DataFrame, task: str) -> DataFrame:
    """(row_id, part, y, prediction): the value for regression, the probability of class 1 for two classes, the array of
    probabilities for more."""
    return model.transform(data).select("row_id", "part", "y", _value(task).alias("prediction"))


def _value(task: str) -> Column:
    """A prediction in the columns that a model adds."""
    return {
        "regression": lambda: F.col("prediction"),
        "binclass": lambda: vector_to_array("probability")[1],
        "multiclass": lambda: vector_to_array("probability"),
    }[task]()


def evaluate(predictions: DataFrame, task: str, score: str | None = None) -> DataFrame:
    """Signed score per part: the one named, or the task's own; ``FAILED_SCORE`` for a part with a prediction that is not finite."""
    return _scored(predictions, task, score, ["part"])


def _scored(predictions: DataFrame, task: str, score: str | None, by: Sequence[str]) -> DataFrame:
    score = score or DEFAULT_SCORE[task]
    if score not in SCORES[task]:
        raise ValueError(f"{task} has no score {score}; it has {', '.join(SCORES[task])}")
    sound = all_finite("prediction", task).alias("_sound")
    value = F.when(F.col("_sound"), signed_score(score, F.col(f"`{score}`"))).otherwise(F.lit(FAILED_SCORE))
    if task == "regression":  # one aggregate, so the predictions are made once
        scores = regression_metrics(predictions, by=by, more=[sound])
    else:
        scores = null_safe_join(all_scores(predictions, task, by), predictions.groupBy(*by).agg(sound), by)
    return scores.select(*by, value.alias("score"))


def importances(model: Model, names: Sequence[str]) -> DataFrame:
    """Importance per feature name of a fitted tree model."""
    from pyspark.sql import SparkSession

    values = model.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


def draw(space: dict[str, Any], rng: random.Random) -> dict:
    """One configuration. A value is plain, or a list (distribution, arguments...):

    uniform, loguniform, int and int-power-of-two take (low, high); categorical takes its choices; a leading ``?`` makes
    the parameter optional and the next argument its default.
    """
    out = {}
    for name, rule in space.items():
        if isinstance(rule, dict):
            out[name] = draw(rule, rng)
            continue
        if not isinstance(rule, (list, tuple)):
            out[name] = rule
            continue
        kind, args = rule[0], list(rule[1:])
        if kind.startswith("?"):
            default = args.pop(0)
            if rng.random() < 0.5:
                out[name] = default
                continue
            kind = kind[1:]
        if kind == "uniform":
            out[name] = rng.uniform(*args)
        elif kind == "loguniform":
            out[name] = math.exp(rng.uniform(math.log(args[0]), math.log(args[1])))
        elif kind == "int":
            out[name] = rng.randint(*args)
        elif kind == "int-power-of-two":
            out[name] = 2 ** rng.randint(*args)
        elif kind == "categorical":
            out[name] = rng.choice(args[0] if len(args) == 1 and isinstance(args[0], (list, tuple)) else args)
        else:
            raise ValueError(f"unknown distribution {kind}")
    return out


def search(
    model: str, data: DataFrame, task: str, space: dict, trials: int, seed: int = 0, score: str | None = None,
    at_once: int = JOBS_AT_ONCE,
) -> tuple[dict, list[dict]]:
    """Random search: the configuration with the best validation score, and all trials. Trials run side by side on rows kept once.

    A trial whose score is no number is never the best; of equal scores the first trial is.
    """
    rng = random.Random(seed)
    drawn = [draw(space, rng) for _ in range(trials)]
    with kept_rows(data, model) as rows:
        def run(params: dict) -> float:
            held_out = predict(_fit_on(model, rows, task, params, seed), data.where(F.col("part") == "val"), task)
            return evaluate(held_out, task, score).first()["score"]

        scores = side_by_side(data.sparkSession, [lambda p=p: run(p) for p in drawn], fits_at_once(rows[0], at_once))
    done = [{"trial": i, "params": p, "score": s} for i, (p, s) in enumerate(zip(drawn, scores))]
    return max(done, key=lambda t: t["score"] if t["score"] is not None and math.isfinite(t["score"]) else -math.inf)["params"], done


def over_seeds(
    model: str, data: DataFrame, task: str, params: dict, seeds: Sequence[int], dataset: str, split: str = "default",
    at_once: int = JOBS_AT_ONCE,
) -> DataFrame:
    """Predictions of the configuration refitted per seed, in the layout of the predictions table.

    Fits run side by side. The data are read once for all seeds, and the predictions of a row stand together.
    """
    with kept_rows(data, model) as kept:
        fits = [lambda s=s: _fit_on(model, kept, task, params, s) for s in seeds]
        fitted = side_by_side(data.sparkSession, fits, fits_at_once(kept[0], at_once))
    out = data.select("row_id", "part", "y", "features")
    for i, one in enumerate(fitted):
        out = one.transform(out).select(*out.columns, _value(task).alias(f"_prediction_{i}"))
    runs = F.array(*[F.struct(F.lit(s).alias("seed"), F.col(f"_prediction_{i}").alias("prediction")) for i, s in enumerate(seeds)])
    return out.select("part", "row_id", "y", F.explode(runs).alias("r")).select(
        F.lit(model).alias("model"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"),
        "r.seed", "part", "row_id", "y", "r.prediction",
    )


def ensemble_runs(
    predictions: DataFrame, labels: DataFrame, task: str, path: str, *, size: int = 5, ensembles: int = 3, classes: int | None = None,
    score: str | None = None,
) -> DataFrame:
    """Average complete groups of ``size`` seeds, store them in the predictions table at ``path`` and score what was stored.

    ``labels`` has (dataset, row_id, y). Returns (model, dataset, split, ensemble, part, score). The stored seed is the
    number of the ensemble, the model's name ends in ``-ensemble-<size>``.
    """
    keys = ["model", "dataset", "split", "part", "row_id"]
    mean = ensemble_mean(predictions, keys, size, ensembles, classes=classes)
    named = mean.withColumns({"model": F.concat("model", F.lit(f"-ensemble-{size}")), "seed": F.col("ensemble")})
    names = [r["model"] for r in named.select("model").distinct().collect()]
    if not names:
        raise ValueError(f"no group of {size} seeds is complete")
    save_predictions(named, path)
    stored = load_predictions(labels.sparkSession, path).where(F.col("model").isin(names)).join(labels, ["dataset", "row_id"])
    by = ["model", "dataset", "split", "seed", "part"]
    return _scored(stored, task, score, by).withColumnRenamed("seed", "ensemble")
