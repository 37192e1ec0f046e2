"""The model jobs on all features, against plain computations and bounds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from catalog import ORACLES, QUERIES, models
from timetab.operators import scaling
from timetab.plans import models as plans_models
from timetab.plans.leaderboard import ensemble_mean
from timetab.plans.models import evaluate, fit, over_seeds, predict, search

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    """(part, y, features) of the regression as arrays."""
    rows = models._whole_data(spark, SF_DIR).select("row_id", "part", "y", vector_to_array("features").alias("x")).collect()
    assert len({r["row_id"] for r in rows}) == len(rows) == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    return np.array([r["part"] for r in rows]), np.array([r["y"] for r in rows]), np.array([r["x"] for r in rows])


def by_part(spark, name):
    return {r["part"]: r["score"] for r in QUERIES[name](spark, SF_DIR).collect()}


def rmse(a, b=0.0):
    return float(np.sqrt(np.mean((a - b) ** 2)))


def test_features(lines):
    part, _, x = lines
    assert x.shape[1] == 7 and (x[:, 4:].sum(1) == 1).all() and set(np.unique(x[:, 4:])) == {0, 1}
    train = x[part == "train", :4]
    assert np.allclose(train.mean(0), 0, atol=1e-9) and np.allclose(train.std(0), 1, atol=1e-2)
    assert not {n for n in QUERIES if n.endswith("_whole")} & set(ORACLES)


def test_trees_use_many_features(spark, lines):
    part, y, _ = lines
    forest, boosted = by_part(spark, "forest_price_whole"), by_part(spark, "boosted_price_whole")
    one_split = by_part(spark, "forest_price")
    # The prices of the test table are nearly noise, so only the training part must gain from more splits.
    assert 0 > forest["train"] > one_split["train"] and 0 > boosted["train"] > one_split["train"]
    for p in ("val", "test"):
        assert max(-forest[p], -boosted[p]) < 1.1 * rmse(y[part == p], y[part == p].mean())
    got = {r["feature"]: r["importance"] for r in QUERIES["boosted_importance_whole"](spark, SF_DIR).collect()}
    assert len(got) == 7 and sum(got.values()) == pytest.approx(1)
    assert sum(v > 0 for v in got.values()) >= 3


def test_validation_cuts_boosting(spark):
    """Rounds that make the validation loss worse are cut off again."""
    data = models._whole_data(spark, SF_DIR)
    model = fit("boosted", data, "regression", {"rounds": 12, "depth": 6, "rate": 1.0})
    val = data.where("part = 'val'")
    loss = model.model.evaluateEachIteration(val, "squared")
    assert model.getNumTrees == int(np.argmin(loss)) + 1 < 12


def test_seeds_differ(spark):
    got = {(r["run"], r["part"]): r["rmse"] for r in QUERIES["seeds_and_ensemble_whole"](spark, SF_DIR).collect()}
    for p in ("train", "val", "test"):
        single = [got[str(s), p] for s in range(5)]
        assert len(set(single)) == 5
        # The error of a mean of predictions is at most the mean of their errors.
        assert got["ensemble", p] <= np.mean(single)


def test_linear_models(spark, lines):
    part, y, x = lines
    auc = by_part(spark, "linear_elastic_whole")
    data = models._whole_data(spark, SF_DIR, "binclass")
    rows = predict(fit("linear", data, "binclass", {"reg": 0.01, "l1_share": 0.5}), data, "binclass").collect()
    for p in ("train", "val", "test"):
        one, none = (np.array([r["prediction"] for r in rows if r["part"] == p and r["y"] == v]) for v in (1, 0))
        assert len(one) and len(none)
        assert auc[p] == pytest.approx(np.mean((one[:, None] > none) + (one[:, None] == none) / 2), abs=1e-9)
    full = np.c_[np.ones(len(y)), x[:, :6]]
    best = np.linalg.lstsq(full[part == "train"], y[part == "train"], rcond=None)[0]
    floor = {p: rmse(y[part == p], full[part == p] @ best) for p in ("train", "val", "test")}
    trials = QUERIES["tuned_linear_whole"](spark, SF_DIR).collect()
    assert [t["trial"] for t in trials] == [0, 1, 2] and [t["chosen"] for t in trials].count(True) == 1
    assert max(trials, key=lambda t: t["score"])["chosen"]
    # A light penalty stays near least squares.
    assert -max(t["score"] for t in trials) == pytest.approx(floor["val"], rel=0.02)
    quantile = by_part(spark, "quantile_linear_whole")
    # Least squares on all features is the least on the training part, and the mean alone the most.
    assert floor["train"] < -quantile["train"] < rmse(y[part == "train"], y[part == "train"].mean())


def test_early_stop(spark, lines):
    """Far fewer rounds are fitted than asked for, and the scores are those of the rounds kept."""
    part, y, _ = lines
    data = models._whole_data(spark, SF_DIR)
    model = fit("histogram", data, "regression", {"rounds": 100, "depth": 4, "rate": 0.5, "patience": 2})
    assert model.getNumTrees <= model.fitted - 2 and model.fitted < 30
    got = by_part(spark, "boosted_early_whole")
    assert got["val"] == pytest.approx(-np.sqrt(model.losses[model.getNumTrees])) and model.losses[0] >= min(model.losses)
    # The prices of the test table are nearly noise: few rounds stay, and they cost little elsewhere.
    for p in ("train", "val", "test"):
        assert -got[p] < 1.1 * rmse(y[part == p], y[part == p].mean())
    classes = by_part(spark, "boosted_classes_whole")
    assert set(classes) == {"train", "val", "test"} and all(0 < v <= 1 for v in classes.values())


def test_seeds_side_by_side(spark):
    """Fifteen seeds at once give what one after the other gives, in order."""
    data = models._whole_data(spark, SF_DIR).where("row_id % 5 = 0")
    params, seeds = {"trees": 2, "depth": 3}, range(15)
    both = [over_seeds("forest", data, "regression", params, seeds, "lines", at_once=n).groupBy("seed").sum("prediction").collect() for n in (8, 1)]
    serial, parallel = ({r[0]: r[1] for r in rows} for rows in both)
    assert serial == pytest.approx(parallel) and len(serial) == 15 and len({round(v, 6) for v in serial.values()}) > 10
    space = {"reg": ["loguniform", 1e-3, 1.0]}
    assert search("linear", data, "regression", space, 4, at_once=4) == search("linear", data, "regression", space, 4, at_once=1)


def test_search_passes_over_failed_trials(spark, monkeypatch):
    data = models._whole_data(spark, SF_DIR).where("row_id % 50 = 0")
    scores = iter([float("nan"), -2.0, None, -1.0])

    class Row:
        def first(self):
            return {"score": next(scores)}

    monkeypatch.setattr(plans_models, "evaluate", lambda *_: Row())
    best, trials = search("linear", data, "regression", {"reg": ["uniform", 0.1, 1.0]}, 4, at_once=1)
    assert best == trials[3]["params"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_training_rows_come_in_bounded_tasks(spark, monkeypatch):
    """A larger table makes more tasks, not larger ones, and then fewer fits keep copies of it at once."""
    data = models._whole_data(spark, SF_DIR)
    n = data.where("part = 'train'").count()
    monkeypatch.setattr(plans_models, "TASK_VALUES", 20 * (7 + plans_models.ROW_VALUES))
    rows = plans_models.training_rows(data, "train")
    assert rows.rdd.getNumPartitions() == -(-n // 20) > 8 and rows.count() == n
    assert plans_models.fits_at_once(rows, 8) == max(1, 64 // -(-n // 20)) < 8
    rows.unpersist()


def test_seeds_read_the_data_once(spark):
    """All seeds predict in one pass, and seeds are counted in numbers of fixed width."""
    data = models._whole_data(spark, SF_DIR)
    runs = over_seeds("linear", data, "regression", {}, range(3), "lines")
    assert plan_of(runs).count("FileScan parquet") == 1
    got = {(r["seed"], r["part"]): r["count"] for r in runs.groupBy("seed", "part").count().collect()}
    sizes = {r["part"]: r["count"] for r in data.groupBy("part").count().collect()}
    assert got == {(s, p): n for s in range(3) for p, n in sizes.items()}
    keys = ["part", "row_id"]
    mean = ensemble_mean(runs, keys, size=3)
    assert "ObjectHashAggregate" not in plan_of(mean) and mean.count() == sum(sizes.values())
    wide = runs.withColumn("seed", runs["seed"].cast("double"))
    assert sorted(map(tuple, ensemble_mean(wide, keys, size=3).collect())) == sorted(map(tuple, mean.collect()))


def test_scores_and_noise_take_one_pass(spark, monkeypatch):
    """A regression's scores make its predictions once; noise is stored before the passes of the grid."""
    data = models._whole_data(spark, SF_DIR)
    scored = evaluate(predict(fit("linear", data, "regression", {}), data, "regression"), "regression")
    assert plan_of(scored).count("FileScan parquet") == 1
    stored, store = [], scaling.materialise
    monkeypatch.setattr(scaling, "materialise", lambda df, label: stored.append(label) or store(df, label))
    rows = models._numeric_lines(spark, SF_DIR, "1")
    assert len(scaling.fit_quantiles(rows, ["l_tax"], noise="fixed")["l_tax"]) >= 10 and stored == ["noised"]
