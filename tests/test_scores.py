import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from timetab.plans.leaderboard import (
    ensemble_mean, group_stats, pairwise_test, rank_summary, score_matrix, score_table, studentised_range_tail, tolerance_rank, uplift, uplift_summary,
)
from timetab.plans.leaderboard import tested_rank as rank_by_test
from timetab.plans.metrics import (
    FAILED_SCORE, all_scores, classification_report, guarded_score, multiclass_cross_entropy, regression_metrics, roc_auc,
)
from timetab.plans.models import evaluate


def test_regression(spark):
    y, p = np.array([3.0, -0.5, 2.0, 7.0]), np.array([2.5, 0.0, 2.0, 8.0])
    row = regression_metrics(spark.createDataFrame(list(zip(map(float, y), map(float, p))), "y double, prediction double")).first()
    assert row["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert row["mae"] == pytest.approx(0.5) and row["r2"] == pytest.approx(0.9486081370449679)
    flat = regression_metrics(spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, prediction double")).first()
    assert flat["r2"] == 1.0


def test_report(spark):
    rows = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)]
    rep = {r["row"]: r for r in classification_report(spark.createDataFrame(rows, "y int, label int")).collect()}
    assert (rep["0"]["precision"], rep["0"]["recall"], rep["0"]["support"]) == (0.5, 0.5, 2)
    assert (rep["1"]["precision"], rep["1"]["recall"], rep["1"]["f1"]) == (pytest.approx(2 / 3), 1.0, pytest.approx(0.8))
    assert (rep["2"]["precision"], rep["2"]["recall"], rep["2"]["f1"]) == (0.0, 0.0, 0.0)
    assert rep["accuracy"]["precision"] == pytest.approx(0.6)
    assert rep["macro avg"]["recall"] == pytest.approx(0.5) and rep["weighted avg"]["recall"] == pytest.approx(0.6)


def test_cross_entropy(spark):
    df = spark.createDataFrame([(0, [0.7, 0.2, 0.1]), (2, [0.0, 1.0, 0.0])], "y int, probabilities array<double>")
    assert multiclass_cross_entropy(df).first()[0] == pytest.approx((-np.log(0.7) - np.log(2.220446049250313e-16)) / 2)


def test_auc_against_pairs_and_evaluator(spark):
    rng = random.Random(2)
    rows = [(g, rng.randrange(2), float(rng.randrange(12))) for g in ("a", "b") for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, y int, score double").repartition(9)
    got = {r["g"]: r["roc_auc"] for r in roc_auc(df, by=["g"]).collect()}
    for g in ("a", "b"):
        pos, neg = ([s for h, y, s in rows if h == g and y == c] for c in (1, 0))
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
        assert got[g] == pytest.approx(want)
    whole = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0).evaluate(df)
    assert roc_auc(df).first()["roc_auc"] == pytest.approx(whole)
    assert roc_auc(df.where("y = 1")).first()["roc_auc"] is None


def test_guard(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", None), ("d", float("-inf"))], "m string, p double")
    got = {r["m"]: r["s"] for r in df.groupBy("m").agg(guarded_score(F.lit(0.5), "p").alias("s")).collect()}
    assert got == {"a": 0.5, "b": FAILED_SCORE, "c": FAILED_SCORE, "d": FAILED_SCORE}


def test_groups_without_a_name(spark):
    """Rows whose group is null are a group in every score."""
    rows = [(g, i % 2, (i * 7 % 10) / 10) for g in ("a", None) for i in range(40)]
    df = spark.createDataFrame(rows, "part string, y long, prediction double")
    for task in ("binclass", "regression"):
        got = {r["part"]: tuple(r)[1:] for r in all_scores(df, task, ["part"]).collect()}
        assert set(got) == {"a", None} and got["a"] == got[None]
    assert {r["part"] for r in roc_auc(df, "y", "prediction", ["part"]).collect()} == {"a", None}
    many = df.withColumn("prediction", F.array(1 - F.col("prediction"), "prediction"))
    got = {r["part"]: tuple(r)[1:] for r in all_scores(many, "multiclass", ["part"]).collect()}
    assert set(got) == {"a", None} and got["a"] == got[None]


@pytest.mark.parametrize("task", ["binclass", "multiclass", "regression"])
def test_broken_predictions(spark, task):
    """A part with a prediction that is not finite gets the fixed low score; the others keep theirs."""
    odd = {"nan": float("nan"), "inf": float("inf"), "low": float("-inf"), "null": None}
    rows = [(part, i % 2, 0.25 + i % 2 * 0.5) for part in ("good", None, *odd) for i in range(4)] + [(k, 1, v) for k, v in odd.items()]
    df = spark.createDataFrame(rows, "part string, y long, prediction double")
    if task == "multiclass":
        df = df.withColumn("prediction", F.array(F.lit(1.0) - F.col("prediction"), "prediction"))
        df = df.union(spark.sql("SELECT 'whole', 1L, CAST(NULL AS array<double>)"))
    got = {r["part"]: r["score"] for r in evaluate(df, task).collect()}
    bad = {*odd, *(["whole"] if task == "multiclass" else [])}
    assert {k for k, v in got.items() if v == FAILED_SCORE} == bad and set(got) == {"good", None, *bad}
    assert got["good"] == got[None] == (-0.25 if task == "regression" else 1.0)


def stats(spark, rows):
    return spark.createDataFrame(rows, "dataset string, model string, n long, mean double, std double")


def test_tolerance_rank(spark):
    rows = [("d", "x", 15, 0.90, 0.05), ("d", "y", 15, 0.88, 0.01), ("d", "z", 15, 0.80, 0.10), ("e", "x", 1, 0.9, None), ("e", "y", 5, 0.1, 0.1)]
    ranks = tolerance_rank(stats(spark, rows))
    got = {(r["dataset"], r["model"]): r["rank"] for r in ranks.collect()}
    assert got == {("d", "x"): 1, ("d", "y"): 1, ("d", "z"): 2, ("e", "x"): 1, ("e", "y"): 1}
    summary = {r["model"]: tuple(r)[1:] for r in rank_summary(ranks).collect()}
    assert summary["y"] == (1.0, 0.0, 2) and summary["z"] == (2.0, 0.0, 1)


def test_board(spark):
    runs = spark.createDataFrame(
        [(m, d, s, v, k) for m, d, s, v, k in [
            ("mlp", "reg", 0, -2.0, "evaluation"), ("mlp", "reg", 0, -2.0, "evaluation"), ("mlp", "reg", 1, -4.0, "evaluation"),
            ("mlp", "cls", 0, 0.5, "evaluation"), ("new", "reg", 0, -1.5, "evaluation"), ("new", "cls", 0, 0.6, "evaluation"),
            ("new", "gone", 0, 0.6, "evaluation"), ("new", "cls", 1, 0.9, "tuning"), ("odd", "cls", 0, 0.1, "evaluation"),
        ]], "model string, dataset string, seed int, score double, kind string")
    scores = score_table(runs, ["mlp", "new"], "evaluation")
    s = group_stats(scores)
    assert {(r["model"], r["dataset"]): r["n"] for r in s.collect()}[("mlp", "reg")] == 2
    matrix = {r["model"]: r for r in score_matrix(scores, ["reg", "cls"], ["reg"]).collect()}
    assert matrix["mlp"]["reg_mean"] == 3.0 and matrix["mlp"]["cls_std"] is None
    change = {(r["model"], r["dataset"]): r["uplift"] for r in uplift(s, "mlp", ["cls"]).collect()}
    assert set(change) == {("mlp", "reg"), ("mlp", "cls"), ("new", "reg"), ("new", "cls")}
    assert change["new", "reg"] == pytest.approx(50.0) and change["new", "cls"] == pytest.approx(20.0)
    best = uplift_summary(uplift(s, "mlp", ["cls"])).first()
    assert (best["model"], best["median"]) == ("new", pytest.approx(35.0))


@pytest.mark.parametrize("q, groups, freedom", [(3.877, 3, 10), (4.232, 5, 20), (3.314, 3, 1000), (2.95, 2, 20), (6.602, 10, 8)])
def test_studentised_range_table(spark, q, groups, freedom):
    """Upper 5 % points from published tables; the last but one row is q(2, 20), the next q at 1000 is about q at infinity."""
    df = spark.createDataFrame([(q, float(groups), float(freedom))], "q double, k double, v double")
    p = df.select(studentised_range_tail("q", "k", "v")).first()[0]
    if (groups, freedom) == (10, 8):
        assert 0.01 < p < 0.05
    else:
        assert p == pytest.approx(0.05, abs=0.0007)


def test_two_group_test_is_the_t_test(spark):
    """For two groups q is t times the root of 2; t = 2.1009 is the 5 % point with 18 degrees of freedom."""
    half = float(2.10092 / 2 * np.sqrt(2 / 10))
    df = stats(spark, [("d", "a", 10, half, 1.0), ("d", "b", 10, -half, 1.0)])
    assert {round(r["p_value"], 3) for r in pairwise_test(df).collect()} == {0.05}


def test_tested_rank(spark):
    df = stats(spark, [("d", "a", 10, 0.9, 0.01), ("d", "b", 10, 0.899, 0.01), ("d", "c", 10, 0.5, 0.01), ("d", "e", 10, 0.1, 0.01)])
    assert {r["model"]: r["rank"] for r in rank_by_test(df).collect()} == {"a": 1, "b": 1, "c": 2, "e": 3}


def test_ensembles(spark):
    rows = [("m", r, s, float(s + r)) for r in (1, 2) for s in range(15)] + [("n", 1, s, 1.0) for s in range(15) if s != 7]
    df = spark.createDataFrame(rows, "model string, row_id long, seed int, prediction double")
    got = {(r["model"], r["row_id"], r["ensemble"]): r["prediction"] for r in ensemble_mean(df, ["model", "row_id"]).collect()}
    assert got["m", 2, 1] == 9.0 and {e for m, _, e in got if m == "n"} == {0, 2} and len(got) == 8


def test_repeated_runs(spark):
    """Runs of one seed with different scores are an error, or the latest counts; a seed that is stored twice is an error."""
    runs = spark.createDataFrame([("m", "d", 0, 0.9, 1), ("m", "d", 0, 0.8, 2)], "model string, dataset string, seed int, score double, t int")
    assert score_table(runs, latest="t").first()["score"] == 0.8
    with pytest.raises(Exception, match="different scores"):
        score_table(runs).collect()
    seeds = [(1, s, 1.0) for s in (0, 1, 2, 3, 4)]
    for extra in ([(1, 4, 2.0)], [(1, 0, 1.0), (1, 0, 1.0)]):
        with pytest.raises(Exception, match="stands twice"):
            ensemble_mean(spark.createDataFrame(seeds + extra, "row_id long, seed int, prediction double"), ["row_id"]).collect()
    five = spark.createDataFrame([(1, 0, 1.0)] * 5, "row_id long, seed int, prediction double")
    with pytest.raises(Exception, match="stands twice"):
        ensemble_mean(five, ["row_id"]).collect()


def test_ensembles_of_logits_and_classes(spark):
    df = spark.createDataFrame([(1, s, float(s - 2)) for s in range(5)], "row_id long, seed int, prediction double")
    row = ensemble_mean(df, ["row_id"], logits=True).first()
    assert row["prediction"] == pytest.approx(0.5)
    df = spark.createDataFrame([(1, s, [0.0, float(s % 2)]) for s in range(5)], "row_id long, seed int, prediction array<double>")
    assert ensemble_mean(df, ["row_id"], classes=2).first()["prediction"] == [0.0, 0.4]
    p = ensemble_mean(df, ["row_id"], logits=True, classes=2).first()["prediction"]
    e = np.e / (1 + np.e)
    assert p == pytest.approx([(3 * 0.5 + 2 * (1 - e)) / 5, (3 * 0.5 + 2 * e) / 5])
