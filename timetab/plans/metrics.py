"""Scores of predictions, each from one or two aggregates over (label, prediction) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timetab.operators.joins import null_safe_join
from timetab.operators.ordering import prefix_totals

# Metric names, which of them grow with quality, the default score per task, and the score of a failed run.
HIGHER_IS_BETTER = {
    "accuracy": True,
    "cross-entropy": False,
    "mae": False,
    "r2": True,
    "rmse": False,
    "roc-auc": True,
}
DEFAULT_SCORE = {"binclass": "accuracy", "multiclass": "accuracy", "regression": "rmse"}
FAILED_SCORE = -999999.0
DOUBLE_STEP = 2.220446049250313e-16


def regression_metrics(
    df: DataFrame, y: str = "y", prediction: str = "prediction", by: Sequence[str] = (), more: Sequence[Column] = ()
) -> DataFrame:
    """RMSE, MAE and R² per group, and ``more`` aggregates of the same rows."""
    t, p = F.col(y).cast("double"), F.col(prediction).cast("double")
    sse, spread = F.sum((t - p) * (t - p)), F.count(F.lit(1)) * F.var_pop(t)
    r2 = F.when(spread > 0, 1.0 - sse / spread).when(sse == 0, 1.0).otherwise(0.0)
    return df.groupBy(*by).agg(
        F.sqrt(sse / F.count(F.lit(1))).alias("rmse"), F.avg(F.abs(t - p)).alias("mae"), r2.alias("r2"), *more
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def classification_report(df: DataFrame, y: str = "y", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, their macro and weighted means, and accuracy, in long form.

    Rows meet in one aggregate per (label, prediction) pair; everything after it works on that small table.
    """
    by = list(by)
    cells = df.groupBy(*by, F.col(y).cast("bigint").alias("t"), F.col(label).cast("bigint").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("t").alias("cls"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(zero).alias("hit"),
                 F.col("n").alias("support"), zero.alias("guessed")),
        F.struct(F.col("p").alias("cls"), zero.alias("hit"), zero.alias("support"), F.col("n").alias("guessed")),
    )
    classes = (
        cells.select(*by, F.explode(sides).alias("e")).groupBy(*by, "e.cls")
        .agg(*[F.sum(f"e.{c}").alias(c) for c in ("hit", "support", "guessed")])
        .withColumns({"precision": _ratio(F.col("hit"), F.col("guessed")), "recall": _ratio(F.col("hit"), F.col("support"))})
        .withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )
    names = ("precision", "recall", "f1")
    per_class = classes.select(*by, F.col("cls").cast("string").alias("row"), *names, "support")
    total = F.sum("support")
    macro = classes.groupBy(*by).agg(F.lit("macro avg").alias("row"), *[F.avg(c).alias(c) for c in names], total.alias("support"))
    weighted = classes.groupBy(*by).agg(
        F.lit("weighted avg").alias("row"), *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in names],
        total.alias("support"),
    )
    accuracy = classes.groupBy(*by).agg(
        F.lit("accuracy").alias("row"), *[(F.sum("hit") / total).alias(c) for c in names], total.alias("support")
    )
    return per_class.unionByName(macro).unionByName(weighted).unionByName(accuracy)


def binary_cross_entropy(df: DataFrame, y: str = "y", probability: str = "probability", by: Sequence[str] = ()) -> DataFrame:
    p = F.least(F.greatest(F.col(probability), F.lit(DOUBLE_STEP)), F.lit(1.0 - DOUBLE_STEP))
    loss = F.when(F.col(y) == 1, -F.log(p)).otherwise(-F.log(1.0 - p))
    return df.groupBy(*by).agg(F.avg(loss).alias("cross_entropy"))


def multiclass_cross_entropy(df: DataFrame, y: str = "y", probabilities: str = "probabilities", by: Sequence[str] = ()) -> DataFrame:
    """``probabilities`` is an array in class order, ``y`` the 0-based class."""
    clipped = F.least(F.greatest(F.element_at(F.col(probabilities), F.col(y).cast("int") + 1), F.lit(DOUBLE_STEP)),
                      F.lit(1.0 - DOUBLE_STEP))
    return df.groupBy(*by).agg(F.avg(-F.log(clipped)).alias("cross_entropy"))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per group, ties counted half; null where a group has one class only.

    Rows are first counted per distinct score. The negatives below each score come from range-partitioned prefix sums.
    """
    by = list(by)
    counts = df.groupBy(*by, F.col(score).alias("_score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    placed = prefix_totals(counts, [*by, "_score"], {"below": "neg"}, within=by)
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    won = F.sum(F.col("pos").cast("double") * (F.col("below").cast("double") + F.col("neg") / 2.0))
    return placed.groupBy(*by).agg(F.when((pos > 0) & (neg > 0), won / (pos * neg)).alias("roc_auc"))


# The scores of each task.
SCORES = {
    "regression": ("rmse", "mae", "r2"),
    "binclass": ("accuracy", "cross-entropy", "roc-auc"),
    "multiclass": ("accuracy", "cross-entropy"),
}


def all_scores(df: DataFrame, task: str, by: Sequence[str] = (), y: str = "y", prediction: str = "prediction") -> DataFrame:
    """All scores of the task per group, named as in ``SCORES``; nulls are a group.

    Predictions are values, the probability of class 1, or arrays of one probability per class; of equal probabilities the
    lower class is guessed, and a probability of one half is class 0. A prediction that is not finite guesses no class, so it is
    wrong; ``evaluate`` gives such a group ``FAILED_SCORE``.
    """
    if task == "regression":
        return regression_metrics(df, y, prediction, by)
    if not by:
        return all_scores(df.withColumn("_all", F.lit(0)), task, ["_all"], y, prediction).drop("_all")
    by = list(by)
    t = F.col(y).cast("bigint")
    if task == "binclass":
        guess = F.when(finite(F.col(prediction), task), F.rint(F.col(prediction).cast("double")).cast("bigint"))
        loss = binary_cross_entropy(df, y, prediction, by)
    else:
        guess = F.when(finite(F.col(prediction), task), F.array_position(F.col(prediction), F.array_max(prediction)) - 1)
        loss = multiclass_cross_entropy(df, y, prediction, by)
    right = df.groupBy(*by).agg(F.avg(F.coalesce((t == guess), t.isNull() & F.lit(None)).cast("double")).alias("accuracy"))
    loss = loss.withColumnRenamed("cross_entropy", "cross-entropy")
    parts = [right, loss] if task == "multiclass" else [right, loss, roc_auc(df, y, prediction, by).withColumnRenamed("roc_auc", "roc-auc")]
    out = parts[0]
    for p in parts[1:]:
        out = null_safe_join(out, p, by)
    return out


def signed_score(metric: str, value: str | Column) -> Column:
    """The metric turned so that higher is better."""
    v = F.col(value) if isinstance(value, str) else value
    return v if HIGHER_IS_BETTER[metric] else -v


def finite(value: Column, task: str = "regression") -> Column:
    """Whether a prediction is a finite number, or an array of such for several classes; false for null."""
    def number(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))

    return number(value) if task != "multiclass" else F.coalesce(F.forall(value, number), F.lit(False))


def all_finite(prediction: str, task: str = "regression") -> Column:
    """Aggregate: whether every prediction is finite."""
    return F.bool_and(finite(F.col(prediction), task))


def guarded_score(score: Column, prediction: str, task: str = "regression") -> Column:
    """Aggregate: the score, or ``FAILED_SCORE`` if any prediction is not finite."""
    return F.when(all_finite(prediction, task), score).otherwise(F.lit(FAILED_SCORE))
