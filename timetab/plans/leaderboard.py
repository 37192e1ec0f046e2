"""Model comparison from a (model, dataset, seed, score) table."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timetab.functions.probability import sigmoid, softmax


def score_table(
    runs: DataFrame, models: Sequence[str] | None = None, kind: str | None = None, latest: str | None = None
) -> DataFrame:
    """One score per (model, dataset, seed), limited to known models; a run that was logged twice counts once.

    Of runs with different scores the one with the largest ``latest`` counts; without such a column they are an error.
    """
    if models is not None:
        runs = runs.where(F.col("model").isin(list(models)))
    if kind is not None:
        runs = runs.where(F.col("kind") == kind)
    if latest is not None:
        score = F.max_by("score", latest)
    else:
        differ = F.raise_error(F.concat_ws(" ", F.lit("different scores for"), "model", "dataset", F.lit("seed"), F.col("seed").cast("string")))
        score = F.when(F.min("score").eqNullSafe(F.max("score")), F.max("score")).otherwise(differ.cast("double"))
    return runs.groupBy("model", "dataset", "seed").agg(score.alias("score"))


def group_stats(scores: DataFrame) -> DataFrame:
    """Runs, mean and sample std per model and dataset; the std of a single run is null."""
    return scores.groupBy("model", "dataset").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std")
    )


def score_matrix(scores: DataFrame, datasets: Sequence[str], regression: Sequence[str]) -> DataFrame:
    """One row per model with mean and std per dataset, regression scores shown as positive errors."""
    shown = scores.withColumn(
        "score", F.when(F.col("dataset").isin(list(regression)), -F.col("score")).otherwise(F.col("score"))
    )
    return shown.groupBy("model").pivot("dataset", list(datasets)).agg(
        F.avg("score").alias("mean"), F.stddev_samp("score").alias("std")
    )


def _leader_fold(entries: Column, starts_new: object) -> Column:
    """Walk models from best to worst; ``starts_new(entry, leader)`` says when the next rank begins."""
    blank = F.struct(
        F.lit(0).alias("rank"), F.lit(None).cast("string").alias("leader"), F.lit(None).cast("double").alias("mean"),
        F.lit(None).cast("double").alias("std"),
        F.array().cast("array<struct<model:string,rank:int>>").alias("out"),
    )

    def step(state: Column, e: Column) -> Column:
        new = state["leader"].isNull() | starts_new(e, state)
        rank = state["rank"] + new.cast("int")
        return F.struct(
            rank.alias("rank"),
            F.when(new, e["model"]).otherwise(state["leader"]).alias("leader"),
            F.when(new, e["mean"]).otherwise(state["mean"]).alias("mean"),
            F.when(new, e["std"]).otherwise(state["std"]).alias("std"),
            F.concat(state["out"], F.array(F.struct(e["model"].alias("model"), rank.alias("rank")))).alias("out"),
        )

    return F.aggregate(entries, blank, step, lambda s: s["out"])


def _best_first(extra: Sequence[str] = ()) -> Column:
    """Models of one dataset sorted by mean, best first; one entry per model, after the runs are aggregated."""
    entry = F.struct((-F.col("mean")).alias("down"), "model", "mean", F.coalesce("std", F.lit(float("inf"))).alias("std"), *extra)
    return F.sort_array(F.collect_list(entry))


def tolerance_rank(stats: DataFrame) -> DataFrame:
    """Models within one std of the rank's leader share the rank; a leader with a single run ties with all below."""
    rank = _leader_fold(F.col("entries"), lambda e, lead: (lead["mean"] - e["mean"]) > lead["std"])
    return (
        stats.groupBy("dataset").agg(_best_first().alias("entries"))
        .select("dataset", F.explode(rank).alias("r")).select("dataset", "r.model", "r.rank")
    )


def rank_summary(ranks: DataFrame) -> DataFrame:
    """Mean and population std of a model's rank over the datasets it has scores for."""
    return ranks.groupBy("model").agg(
        F.avg("rank").alias("rank_mean"), F.stddev_pop("rank").alias("rank_std"), F.count(F.lit(1)).alias("datasets")
    )


def uplift(stats: DataFrame, baseline: str, higher_is_better: Sequence[str]) -> DataFrame:
    """Percent change over the baseline model per dataset; datasets without a baseline drop out.

    Scores of the other datasets are negative errors, so their ratio changes sign.
    """
    base = stats.where(F.col("model") == baseline).select("dataset", F.col("mean").alias("base"))
    change = (F.col("mean") - F.col("base")) / F.col("base") * 100.0
    signed = F.when(F.col("dataset").isin(list(higher_is_better)), change).otherwise(-change)
    return stats.join(base, "dataset").select("model", "dataset", signed.alias("uplift"))


def uplift_summary(uplifts: DataFrame) -> DataFrame:
    """Median, smallest and largest uplift per model, best median first; one value per dataset."""
    return uplifts.groupBy("model").agg(
        F.median("uplift").alias("median"), F.min("uplift").alias("min"), F.max("uplift").alias("max")
    ).orderBy(F.desc("median"), "model")


def pairwise_range(stats: DataFrame) -> DataFrame:
    """Studentised range statistic of each ordered pair of models of a dataset (Tukey-Kramer for unequal runs).

    Works on one row per model and dataset. ``groups`` and ``freedom`` are the parameters of its distribution.
    """
    pooled = stats.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("groups"),
        (F.sum("n") - F.count(F.lit(1))).alias("freedom"),
        F.sum((F.col("n") - 1) * F.coalesce(F.col("std"), F.lit(0.0)) * F.coalesce(F.col("std"), F.lit(0.0))).alias("within"),
    )
    left = stats.select("dataset", F.col("model").alias("model_a"), F.col("mean").alias("mean_a"), F.col("n").alias("n_a"))
    right = stats.select("dataset", F.col("model").alias("model_b"), F.col("mean").alias("mean_b"), F.col("n").alias("n_b"))
    spread = F.sqrt(F.col("within") / F.col("freedom") / 2.0 * (1.0 / F.col("n_a") + 1.0 / F.col("n_b")))
    return (
        left.join(right, "dataset").where(F.col("model_a") != F.col("model_b")).join(pooled, "dataset")
        .where((F.col("freedom") > 0) & (F.col("within") > 0))
        .withColumn("q", F.abs(F.col("mean_a") - F.col("mean_b")) / spread)
    )


ROWS_AT_ONCE = 32


@F.pandas_udf(T.DoubleType())
def studentised_range_tail(q: pd.Series, groups: pd.Series, freedom: pd.Series) -> pd.Series:
    """P(Q > q) for the range of ``groups`` normal means over an independent std with ``freedom`` degrees, by quadrature."""
    import math

    import numpy as np

    z, dz = np.linspace(-8.0, 8.0, 801, retstep=True)
    wide = np.linspace(-40.0, 8.0, 9601)
    below = np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) for v in wide])
    density = np.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi)
    at_z = np.interp(z, wide, below)
    node, weight = np.polynomial.legendre.leggauss(80)
    out = np.empty(len(q))
    kinds = pd.DataFrame({"k": groups.to_numpy(), "v": freedom.to_numpy()}).groupby(["k", "v"]).indices
    for (k, v), rows in kinds.items():
        # s is the std estimate over the true one; its density is that of sqrt(chi2_v / v).
        half = 10.0 / math.sqrt(2.0 * v)
        lo, hi = max(1e-9, 1.0 - half), 1.0 + half
        s = 0.5 * (hi - lo) * node + 0.5 * (hi + lo)
        log_f = (v / 2.0) * math.log(v) - math.lgamma(v / 2.0) - (v / 2.0 - 1.0) * math.log(2.0)
        f = np.exp(log_f + (v - 1.0) * np.log(s) - v * s * s / 2.0) * 0.5 * (hi - lo) * weight
        for part in np.array_split(rows, -(-len(rows) // ROWS_AT_ONCE)):
            x = q.to_numpy()[part][:, None, None]
            gap = at_z - np.interp(z - x * s[:, None], wide, below)
            inner = k * (density * np.maximum(gap, 0.0) ** (k - 1)).sum(-1) * dz
            out[part] = np.clip(1.0 - (f * inner).sum(-1) / f.sum(), 0.0, 1.0)
    return pd.Series(out)


def pairwise_test(stats: DataFrame) -> DataFrame:
    """(dataset, model_a, model_b, q, p_value) for all pairs of models of a dataset."""
    p = studentised_range_tail(F.col("q"), F.col("groups").cast("double"), F.col("freedom").cast("double"))
    return pairwise_range(stats).select("dataset", "model_a", "model_b", "q", p.alias("p_value"))


def tested_rank(stats: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Like ``tolerance_rank``, but a new rank starts where the pairwise test against the leader is below ``alpha``."""
    worse = pairwise_test(stats).where(F.col("p_value") < alpha).groupBy("dataset", F.col("model_a").alias("model")).agg(
        F.collect_set("model_b").alias("differs")
    )
    rows = stats.join(worse, ["dataset", "model"], "left").withColumn(
        "differs", F.coalesce("differs", F.array().cast("array<string>"))
    )
    rank = _leader_fold(F.col("entries"), lambda e, lead: F.array_contains(e["differs"], lead["leader"]))
    return (
        rows.groupBy("dataset").agg(_best_first(["differs"]).alias("entries"))
        .select("dataset", F.explode(rank).alias("r")).select("dataset", "r.model", "r.rank")
    )


def ensemble_mean(
    predictions: DataFrame, keys: Sequence[str], size: int = 5, ensembles: int = 3, *, logits: bool = False,
    classes: int | None = None,
) -> DataFrame:
    """Mean prediction of seeds 0-4, 5-9, …; a group with a missing seed gives no ensemble, a seed that is there twice is an error.

    ``keys`` name a predicted row (model, dataset, split, part, row_id). ``logits`` are turned into probabilities first.
    With ``classes`` a prediction is an array of that length, one entry per class.
    """
    value = F.col("prediction")
    if logits:
        value = sigmoid(value) if classes is None else softmax(value)
    numbered = predictions.withColumns({"ensemble": F.floor(F.col("seed") / size).cast("int"), "prediction": value}).where(
        F.col("ensemble") < ensembles
    )
    if classes is None:
        mean = F.avg("prediction")
    else:
        mean = F.array(*[F.avg(F.get("prediction", F.lit(i))) for i in range(classes)])
    if isinstance(predictions.schema["seed"].dataType, T.IntegralType) and size < 64:
        # A bit per seed: numbers of fixed width, which each task adds up before the shuffle.
        seeds = F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("seed", F.lit(size)).cast("int"))))
    else:
        seeds = F.size(F.collect_set("seed"))
    return (
        numbered.groupBy(*keys, "ensemble")
        .agg(F.count(F.lit(1)).alias("_rows"), seeds.alias("_seeds"), mean.alias("prediction"))
        .withColumn("_seeds", F.when(F.col("_rows") == F.col("_seeds"), F.col("_seeds")).otherwise(
            F.raise_error(F.lit("a seed stands twice in an ensemble")).cast("int")))
        .where(F.col("_seeds") == size).drop("_seeds", "_rows")
    )
