import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timetab.functions.columns import Roles
from timetab.plans.models import draw, ensemble_runs, evaluate, fit, fit_boosted, over_seeds, predict, search
from timetab.session import materialise, scratch, shared_folder
from timetab.sources.bundles import cached, load_bundle, load_task, save_bundle
from timetab.sources.runs import flatten_reports, load_predictions, read_reports, save_predictions
from timetab.sources.tables import read_csv, read_tables


def test_union_widens(spark, tmp_path):
    spark.createDataFrame([(1, 1)], "id int, a tinyint").write.parquet(f"{tmp_path}/one")
    spark.createDataFrame([(2**40, 1.5, "x")], "id long, a double, b string").write.parquet(f"{tmp_path}/two")
    out = read_tables(spark, [f"{tmp_path}/one", f"{tmp_path}/two"])
    assert [(f.name, f.dataType.simpleString()) for f in out.schema.fields] == [("id", "bigint"), ("a", "double"), ("b", "string")]
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1.0, None), (2**40, 1.5, "x")]


def test_csv(spark, tmp_path):
    text = "id,day,v\n1,2020-01-02,NA\n2,NA,3.5\n"
    (tmp_path / "a.csv").write_text(text)
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write(text)
    for name in ("a.csv", "b.csv.gz"):
        rows = read_csv(spark, str(tmp_path / name), "id int, day date, v double").orderBy("id").collect()
        assert rows[0]["v"] is None and rows[1]["day"] is None and rows[1]["v"] == 3.5
    assert read_csv(spark, str(tmp_path / "b.csv.gz"), "id int, day date, v double").rdd.getNumPartitions() > 1
    assert dict(read_csv(spark, str(tmp_path / "a.csv")).dtypes)["v"] == "double"


def test_csv_loses_nothing(spark, tmp_path):
    """Types follow all rows, and rows that do not fit a schema fail the read."""
    lines = [f"{i},{i}" for i in range(2000)] + ["2000,12.5", "2001,abc"]
    (tmp_path / "late.csv").write_text("id,v\n" + "\n".join(lines) + "\n")
    df = read_csv(spark, str(tmp_path / "late.csv"))
    assert dict(df.dtypes)["v"] == "string" and df.where("v IS NULL").count() == 0
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ_FILE"):
        read_csv(spark, str(tmp_path / "late.csv"), "id int, v int").collect()


def test_reports_of_all_variants(spark, tmp_path):
    reports = {
        "mlp/d1/ensemble-5/0": {"function": "f", "gpus": ["g"], "config": {"seeds": [0, 1], "data": {"path": ":data/d1"}},
                                "metrics": {p: {"rmse": 1.0, "score": -1.0} for p in ("train", "val", "test")}},
        "linear/d1/evaluation/3": {"config": {"data": {"seed": 3, "path": ":data/d1"}, "seed": 3},
                                   "metrics": {"val": {"score": -2.0}, "test": {"score": -2.5}}, "time": 4.0},
        "forest/d1/evaluation/0": {"config": {"data": {"path": ":data/d1"}}, "metrics": {"test": {"score": -3.0}}},
    }
    for path, body in reports.items():
        (tmp_path / path).mkdir(parents=True)
        (tmp_path / path / "report.json").write_text(json.dumps(body, indent=4))
    rows = {r["model"]: r for r in read_reports(spark, f"{tmp_path}/*/*/*/*/report.json").collect()}
    assert (rows["mlp"]["kind"], rows["mlp"]["seed"], rows["mlp"]["score"], rows["mlp"]["train_score"]) == ("ensemble-5", 0, -1.0, -1.0)
    assert (rows["linear"]["seed"], rows["linear"]["time"], rows["linear"]["train_score"]) == (3, 4.0, 0.0)
    assert (rows["forest"]["path"], rows["forest"]["seed"], rows["forest"]["val_score"]) == (":data/d1", 0, 0.0)


def bundle_frame(spark, labels):
    return spark.createDataFrame([(i, float(i), i % 3, y) for i, y in enumerate(labels)], "row_id long, x double, c int, y double")


def test_bundle(spark, tmp_path):
    roles = Roles(num=["x"], cat=["c"], target="y")
    splits = spark.createDataFrame(
        [(i, s, p) for s in ("default", "other") for i, p in enumerate(["train", "train", "val", "test"])], "row_id long, split string, part string")
    path = f"{tmp_path}/good"
    save_bundle(bundle_frame(spark, [1.0, 2.0, 3.0, 4.0]), roles, splits, path, "demo")
    task = load_task(spark, path)
    assert (task.name, task.score, task.is_regression, task.roles.num) == ("demo", "rmse", True, ["x"])
    loaded = load_bundle(spark, path, "other")
    assert loaded.count() == 4 and dict(loaded.dtypes)["x"] == "float" and dict(loaded.dtypes)["c"] == "bigint"
    assert read_csv(spark, f"{path}/preview", "row_id long, x double, c long, y double").count() == 4
    with pytest.raises(ValueError, match="labels"):
        save_bundle(bundle_frame(spark, [1.0, None, 3.0, 4.0]), roles, splits, f"{tmp_path}/a", "demo")
    clash = splits.unionByName(spark.createDataFrame([(0, "default", "val")], splits.schema))
    with pytest.raises(ValueError, match="overlapping"):
        save_bundle(bundle_frame(spark, [1.0, 2.0, 3.0, 4.0]), roles, clash, f"{tmp_path}/b", "demo")
    save_bundle(bundle_frame(spark, [0.0, 1.0, 0.0, 1.0]), Roles(num=["x"], target="y", task="binclass"), splits, f"{tmp_path}/c", "bin")
    assert load_task(spark, f"{tmp_path}/c").score == "roc-auc"


def test_predictions_append(spark, tmp_path):
    df = spark.createDataFrame([("m", "d", "default", 0, "val", 1, 0.5)], "model string, dataset string, split string, seed int, part string, row_id long, prediction double")
    for seed in (0, 1, 1):  # a run that is written again replaces itself
        save_predictions(df.withColumn("seed", F.lit(seed)), f"{tmp_path}/p")
    assert load_predictions(spark, f"{tmp_path}/p", "d", "m").count() == 2
    save_predictions(df.withColumn("dataset", F.lit("1996")), f"{tmp_path}/q")
    assert load_predictions(spark, f"{tmp_path}/q").first()["dataset"] == "1996"
    assert load_predictions(spark, f"{tmp_path}/p", "other").count() == 0


def test_cached_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert cached(spark, {"q": 1, "at": str(tmp_path)}, build).count() == 3
    assert cached(spark, {"q": 2, "at": str(tmp_path)}, build).count() == 3
    assert len(calls) == 2


class FakeSession:
    """Just the settings that ``shared_folder`` reads."""

    def __init__(self, folder, master="spark://host:7077"):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master, self.applicationId = master, "app-1"

    def getConf(self):
        return self.conf


def test_shared_folder_follows_the_session():
    assert shared_folder(FakeSession("hdfs://shared/folder/")) == "hdfs://shared/folder"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(FakeSession(None))
    local = FakeSession(None, "local[2]")
    assert shared_folder(local) == shared_folder(local)


def test_scratch(spark):
    """Tables made inside the scope are emptied at its end, others stay."""
    outer = materialise(spark.range(3), "outer")
    with scratch(spark):
        inner = materialise(spark.range(5), "inner")
        assert inner.count() == 5
        path = inner.inputFiles()[0].rsplit("/", 1)[0]
    assert outer.count() == 3
    assert spark.read.parquet(path).count() == 0


def test_draw():
    space = {"a": ["uniform", 0, 1], "b": ["loguniform", 1e-3, 1e3], "c": ["int", 2, 4], "d": ["int-power-of-two", 3, 5],
             "e": ["categorical", ["x", "y"]], "f": ["?uniform", 0.0, 1, 2], "g": 5, "h": {"z": ["int", 1, 1]}}
    drawn = [draw(space, random.Random(i)) for i in range(60)]
    assert all(0 <= d["a"] <= 1 and 1e-3 <= d["b"] <= 1e3 and d["c"] in (2, 3, 4) and d["d"] in (8, 16, 32) for d in drawn)
    assert {d["e"] for d in drawn} == {"x", "y"} and any(d["f"] == 0 for d in drawn) and any(1 <= d["f"] <= 2 for d in drawn)
    assert all(d["g"] == 5 and d["h"] == {"z": 1} for d in drawn) and drawn[0] == draw(space, random.Random(0))
    with pytest.raises(ValueError):
        draw({"a": ["normal", 0, 1]}, random.Random(0))


@pytest.fixture(scope="module")
def toy(spark):
    from timetab.operators.scaling import assemble

    rng = random.Random(0)
    rows = []
    for i in range(300):
        x, z = rng.random(), rng.random()
        rows.append((i, "train" if i < 200 else "val", x, z, 3 * x + 0.01 * rng.random()))
    return assemble(spark.createDataFrame(rows, "row_id long, part string, x double, z double, y double"), ["x", "z"]).cache()


def test_boosting_keeps_the_best_round(toy):
    model = fit("boosted", toy, "regression", {"rounds": 6, "depth": 3, "rate": 0.3})
    assert 1 <= model.getNumTrees <= 6
    val = toy.where("part = 'val'")
    full = fit_boosted(toy.where("part = 'train'"), "regression", {"rounds": 6, "depth": 3, "rate": 0.3})
    loss = full.evaluateEachIteration(val, "squared")
    assert model.getNumTrees == loss.index(min(loss)) + 1
    assert model.featureImportances[0] > model.featureImportances[1]


def test_first_trees(toy):
    """The model of the first rounds predicts as a run of so many rounds does."""
    from timetab.plans.models import FirstTrees

    train = toy.where("part = 'train'")
    for task, data in (("regression", toy), ("binclass", toy.withColumn("y", (F.col("y") > 1.5).cast("double")))):
        train = data.where("part = 'train'")
        params = {"depth": 2, "rate": 0.3}
        cut = FirstTrees(fit_boosted(train, task, {**params, "rounds": 5}), 2, task)
        short = fit_boosted(train, task, {**params, "rounds": 2})
        got, want = ({r["row_id"]: r["prediction"] for r in predict(m, data, task).collect()} for m in (cut, short))
        assert all(got[k] == pytest.approx(want[k]) for k in want)
        assert cut.featureImportances.toArray() == pytest.approx(short.featureImportances.toArray())


def test_scores_by_name(spark):
    rows = [(1, "val", 1, 0.9), (2, "val", 1, 0.4), (3, "val", 0, 0.3), (4, "val", 0, 0.1), (5, "test", 0, 0.5)]
    df = spark.createDataFrame(rows, "row_id long, part string, y int, prediction double")
    value = lambda score: {r["part"]: r["score"] for r in evaluate(df, "binclass", score).collect()}
    assert value("accuracy") == value(None) == {"val": 0.75, "test": 1.0}
    assert value("roc-auc") == {"val": 1.0, "test": None}
    assert value("cross-entropy")["val"] == pytest.approx(np.mean(np.log([0.9, 0.4, 0.7, 0.9])))
    with pytest.raises(ValueError, match="no score"):
        evaluate(df, "binclass", "rmse")
    many = spark.createDataFrame([(1, "val", 2, [0.1, 0.2, 0.7]), (2, "val", 0, [0.2, 0.4, 0.4])], "row_id long, part string, y int, prediction array<double>")
    assert evaluate(many, "multiclass").first()["score"] == 0.5
    assert evaluate(many, "multiclass", "cross-entropy").first()["score"] == pytest.approx((np.log(0.7) + np.log(0.2)) / 2)


def test_three_classes(spark, tmp_path):
    """A three-class forest is fitted, predicts one probability per class, and its ensemble is stored and scored."""
    from timetab.operators.scaling import assemble

    rng = random.Random(1)
    rows = [(i, "train" if i < 200 else "test", x := rng.random(), float(int(3 * x))) for i in range(300)]
    data = assemble(spark.createDataFrame(rows, "row_id long, part string, x double, y double"), ["x"])
    runs = over_seeds("forest", data, "multiclass", {"trees": 5, "depth": 4}, range(5), "toy")
    assert {len(r["prediction"]) for r in runs.select("prediction").collect()} == {3}
    labels = data.select(F.lit("toy").alias("dataset"), "row_id", "y")
    out = ensemble_runs(runs.drop("y"), labels, "multiclass", f"{tmp_path}/runs", classes=3).collect()
    assert {(r["model"], r["ensemble"], r["part"]) for r in out} == {("forest-ensemble-5", 0, "train"), ("forest-ensemble-5", 0, "test")}
    assert all(r["score"] > 0.9 for r in out)
    with pytest.raises(ValueError, match="complete"):
        ensemble_runs(runs.drop("y").where("seed < 4"), labels, "multiclass", f"{tmp_path}/runs2", classes=3)
    with pytest.raises(ValueError, match="two classes"):
        fit("boosted", data, "multiclass", {})


def test_search_and_predict(toy):
    best, trials = search("linear", toy, "regression", {"reg": ["loguniform", 1e-4, 10.0]}, 3)
    assert best["reg"] == min(t["params"]["reg"] for t in trials)
    assert predict(fit("linear", toy, "regression", best), toy, "regression").columns == ["row_id", "part", "y", "prediction"]
    labelled = toy.withColumn("y", (F.col("y") > 1.5).cast("double"))
    for model in ("linear", "forest", "boosted"):
        p = predict(fit(model, labelled, "binclass", {"rounds": 2, "trees": 3}), labelled, "binclass")
        assert p.where("prediction < 0 OR prediction > 1").count() == 0


def test_any_report_is_flattened(spark, tmp_path):
    """Every leaf of any nesting is a row; missing numbers are 0, empty objects have no leaf."""
    reports = [{"a": {"b": [1, {"c": 2.5}], "d": None, "e": {}}, "f": "text", "g": True, "h.i": -3}, {"a": 7}, {"deep": {"x": {"y": {"z": [[1], []]}}}}]
    for i, report in enumerate(reports):
        (tmp_path / f"{i}.json").write_text(json.dumps(report))
    got = {(r["file"].rsplit("/", 1)[1], r["path"]): (r["value"], r["number"]) for r in flatten_reports(spark, f"{tmp_path}/*.json").collect()}
    assert got == {
        ("0.json", "a.b.0"): ("1", 1.0), ("0.json", "a.b.1.c"): ("2.5", 2.5), ("0.json", "a.d"): (None, 0.0), ("0.json", "f"): ("text", None),
        ("0.json", "g"): ("true", 1.0), ("0.json", "h.i"): ("-3", -3.0), ("1.json", "a"): ("7", 7.0), ("2.json", "deep.x.y.z.0.0"): ("1", 1.0),
    }
