from statistics import NormalDist

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from timetab.functions.columns import Roles
from timetab.functions.probability import binary_label, class_label, inverse_normal, sigmoid, softmax
from timetab.operators.encoding import (
    dense_codes, encode_frequent, encode_vocabulary, fit_frequent, fit_vocabulary, one_hot,
)
from timetab.operators.quantiles import quantile_grid
from timetab.operators.scaling import (
    assemble, fit_bins, fit_label, fit_quantiles, grid_points, mean_and_std, piecewise_linear, scale_quantile, scale_standard,
)
from timetab.plans.dataset import build_dataset, numeric_policy


def test_frequent_codes(spark):
    values = ["b"] * 50 + ["a"] * 45 + ["r1"] + ["r2"] + [None] * 3
    df = spark.createDataFrame([(v, i % 7) for i, v in enumerate(values)], "c string, n int")
    codes = fit_frequent(df, ["c", "n"], min_share=0.02)
    assert codes.frequent["c"] == ["a", "b"] and codes.has_rare["c"] and not codes.has_rare["n"]
    got = [r["c"] for r in encode_frequent(df, codes).collect()]
    assert got == [1] * 50 + [0] * 45 + [2, 2] + [None] * 3
    own = [r["c"] for r in encode_frequent(df, codes, missing="own").collect()]
    assert own[-3:] == [3] * 3
    assert codes.frequent["n"] == ["0", "1", "2", "3", "4", "5", "6"]


def test_a_share_at_the_border_is_frequent(spark):
    df = spark.createDataFrame([("x",)] * 99 + [("y",)], "c string")
    assert fit_frequent(df, ["c"]).frequent["c"] == ["x", "y"]


def test_vocabulary_is_fitted_on_train_only(spark):
    train = spark.createDataFrame([(10, "b"), (9, "a"), (100, None)], "n int, c string")
    rest = spark.createDataFrame([(9, "zz"), (11, "a"), (None, None)], "n int, c string")
    codes = fit_vocabulary(train, ["n", "c"])
    assert codes.sizes == {"n": 3, "c": 2}
    assert sorted(tuple(r) for r in encode_vocabulary(train, codes).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert sorted(tuple(r) for r in encode_vocabulary(rest, codes).collect()) == [(0, 2), (3, 0), (3, 2)]


def test_large_vocabulary_is_not_broadcast(spark):
    from dataclasses import replace

    df = spark.range(400).select((F.col("id") % 200).cast("string").alias("c"), "id")
    codes = fit_vocabulary(df, ["c"])
    a, b = encode_vocabulary(df, codes), encode_vocabulary(df, codes, limit=0, task_rows=1)
    assert a.exceptAll(b.select(*a.columns)).count() == 0 and b.count() == 400


def test_many_columns_are_one_look_up(spark):
    """A hundred columns need no join where their codes fit together, and one long join where they do not."""
    names = [f"c{i}" for i in range(100)]
    df = spark.range(60).select("id", *[F.when(F.col("id") % 7 != 0, F.concat(F.lit("v"), F.col("id") % (i + 2))).alias(c) for i, c in enumerate(names)])
    codes = fit_vocabulary(df, names)
    plans = []
    for limit in (1 << 20, sum(codes.bytes.values()) // 2, 0):
        out = encode_vocabulary(df, codes, limit=limit, task_rows=10)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        plans.append(plan.count("Join "))
        assert out.columns == df.columns
        for r in out.collect():
            for i, c in enumerate(names):
                seen = sorted({f"v{k % (i + 2)}" for k in range(60) if k % 7 != 0})
                assert r[c] == (seen.index(f"v{r['id'] % (i + 2)}") if r["id"] % 7 != 0 else len(seen))
    assert plans[0] == 0 and max(plans[1:]) <= 8


def test_dense_codes(spark):
    df = spark.createDataFrame([(5.0,), (1.5,), (None,), (5.0,), (10.0,)], "x double")
    assert [r["x_code"] for r in dense_codes(df, ["x"]).orderBy("x").collect()] == [None, 0, 1, 1, 2]


def test_empty_and_constant(spark):
    df = spark.createDataFrame([(0, 2.0), (0, 2.0)], "c int, y double")
    assert df.select(one_hot("c", 0)).first()[0] == []
    scale = fit_label(df)
    assert [r[0] for r in df.select(scale.apply("y")).collect()] == [0.0, 0.0]


def test_one_hot(spark):
    df = spark.createDataFrame([(0,), (2,), (3,)], "c int")
    assert [list(r[0]) for r in df.select(one_hot("c", 3)).collect()] == [[1, 0, 0], [0, 0, 1], [0, 0, 0]]


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantile_grid_is_exact(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    y = np.where(rng.random(n) < 0.4, 3.0, np.round(rng.normal(size=n), 1))  # one hot value
    rows = [(float(a), float(b) if i % 9 else (None if i % 2 else float("nan"))) for i, (a, b) in enumerate(zip(x, y))]
    kept = np.array([b for _, b in rows if b is not None and not np.isnan(b)])
    df = spark.createDataFrame(rows, "x double, y double").repartition(8)
    for points in (2, 10, 13):
        grid = quantile_grid(df, ["x", "y"], points)
        share = np.linspace(0, 1, points)
        assert np.allclose(grid["x"], np.quantile(x, share))
        if len(kept):
            assert np.allclose(grid["y"], np.quantile(kept, share))
        else:
            assert grid["y"] == []
    approx = quantile_grid(df, ["x"], 10, exact=False)["x"]
    assert approx[0] == x.min() and approx[-1] == x.max()


def test_inverse_normal():
    p = np.concatenate([np.logspace(-12, -1, 50), np.linspace(0.01, 0.99, 99), 1 - np.logspace(-9, -1, 20)])
    want = [NormalDist().inv_cdf(v) for v in p]
    assert np.allclose(inverse_normal()(p), want, rtol=1e-12, atol=1e-12)


def test_grid_points():
    assert [grid_points(n) for n in (5, 299, 330, 30_000, 10**9)] == [10, 10, 11, 1000, 1000]


def test_quantile_scaling(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.exponential(size=900), 1)
    train = spark.createDataFrame([(float(v), i) for i, v in enumerate(x)], "x double, row_id long")
    fitted = fit_quantiles(train, ["x"])
    test = spark.createDataFrame([(v,) for v in (-5.0, 0.3, 1.234, 99.0, None, float("nan"))], "x double")
    got = [r["x"] for r in scale_quantile(test, fitted, "uniform").collect()]
    knots, share = np.array(fitted["x"]), np.linspace(0, 1, 30)
    mid = [0.5 * (np.interp(v, knots, share) - np.interp(-v, -knots[::-1], -share[::-1])) for v in (0.3, 1.234)]
    assert got == pytest.approx([0.0, *mid, 1.0, 0.0, 0.0])
    normal = [r["x"] for r in scale_quantile(test, fitted).collect()]
    assert normal[0] == pytest.approx(NormalDist().inv_cdf(1e-7)) and normal[1] == pytest.approx(NormalDist().inv_cdf(mid[0]))
    assert normal[4:] == [0.0, 0.0]
    noisy = fit_quantiles(train, ["x"], noise="fixed", seed=1)["x"]
    assert noisy != fitted["x"] and np.allclose(noisy, fitted["x"], atol=1e-4)
    assert noisy == pytest.approx(fit_quantiles(train.repartition(13), ["x"], noise="fixed", seed=1)["x"])
    assert np.allclose(fit_quantiles(train, ["x"], noise="relative")["x"], fitted["x"], atol=0.02)


def test_standard_scaling(spark):
    train = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (None, 7.0), (float("nan"), 7.0)], "x double, c double")
    fitted = mean_and_std(train, ["x", "c"])
    assert fitted == {"x": (2.0, 1.0), "c": (7.0, 0.0)}
    assert [tuple(r) for r in scale_standard(train, fitted).collect()] == [(-1.0, 0.0), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
    label = fit_label(train.select(F.col("x").alias("y")).dropna())
    assert (label.mean, label.std) == (2.0, 1.0)


def test_piecewise_linear(spark):
    df = spark.createDataFrame([(float(v),) for v in range(5)], "x double")
    assert fit_bins(df, ["x"], 2) == {"x": [0.0, 2.0, 4.0]}
    out = spark.createDataFrame([(-2.0,), (1.0,), (3.0,), (6.0,)], "x double").select(piecewise_linear("x", [0.0, 2.0, 4.0]))
    assert [list(r[0]) for r in out.collect()] == [[-1.0, 0.0], [0.5, 0.0], [1.0, 0.5], [1.0, 2.0]]
    assert fit_bins(spark.createDataFrame([(1.0,)] * 5, "x double"), ["x"], 4) == {"x": [1.0]}


def test_assemble(spark):
    df = spark.createDataFrame([(1.5, 1.0, 0), (2.5, 0.0, 2), (3.5, 1.0, 3)], "x double, b double, c long")
    rows = [list(r[0]) for r in assemble(df, ["x"], ["b"], {"c": 3}).select(vector_to_array("features")).collect()]
    assert rows == [[1.5, 1, 1, 0, 0], [2.5, 0, 0, 0, 1], [3.5, 1, 0, 0, 0]]


def test_probabilities(spark):
    df = spark.createDataFrame([(0.0, [1.0, 2.0, 2.0])], "z double, a array<double>")
    row = df.select(sigmoid("z").alias("p"), softmax("a").alias("s"), class_label("a").alias("c")).first()
    assert row["p"] == 0.5 and sum(row["s"]) == pytest.approx(1) and row["c"] == 1
    halves = spark.createDataFrame([(0.5,), (0.51,), (1.0,)], "p double").select(binary_label("p")).collect()
    assert [r[0] for r in halves] == [0, 1, 1]


@pytest.mark.parametrize("num, cat", [("standard", "ordinal"), ("identity", "one-hot"), ("noisy-quantile", "ordinal"), ("noisy-quantile-old", None)])
def test_build_dataset(spark, num, cat):
    """Changing validation or test rows changes nothing for the other rows."""
    rows = [(i, "train" if i < 60 else "val", float(i % 11), "abc"[i % 3], float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, part string, x double, c string, y double")
    roles = Roles(num=["x"], cat=["c"], target="y")
    a = build_dataset(df, roles, num_policy=num, cat_policy=cat, scale_label=True)
    other = df.withColumn("x", F.when(F.col("part") == "val", F.col("x") + 1000).otherwise(F.col("x"))).withColumn(
        "c", F.when(F.col("part") == "val", F.lit("new")).otherwise(F.col("c")))
    b = build_dataset(other, roles, num_policy=num, cat_policy=cat, scale_label=True)
    left, right = (x.data.where("part = 'train'").orderBy("row_id").collect() for x in (a, b))
    assert [str(r) for r in left] == [str(r) for r in right]
    if cat == "ordinal":
        assert {r["c"] for r in b.data.where("part = 'val'").collect()} == {3}
    if cat == "one-hot":
        assert {tuple(r["c"]) for r in b.data.where("part = 'val'").collect()} == {(0.0, 0.0, 0.0)}
    assert a.label.mean == pytest.approx(29.5)


def test_policies(spark):
    assert (numeric_policy(True), numeric_policy(False)) == ("identity", "noisy-quantile")
    with pytest.raises(ValueError):
        build_dataset(spark.createDataFrame([("train", 1.0)], "part string, x double"), Roles(num=["x"]), num_policy="none")


def test_quantiles_of_crowded_and_odd_columns(spark):
    """Equal steps, single values, a crowded step, infinities, nulls and empty columns give the same grid as sorting."""
    rng = np.random.default_rng(8)
    n = 4000
    data = {
        "even": rng.random(n), "ties": rng.integers(0, 5, n).astype(float), "far": np.where(rng.random(n) < 0.001, 1e12, rng.random(n)),
        "one": np.full(n, 3.0), "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)), "endless": np.where(rng.random(n) < 0.01, np.inf, rng.random(n)),
        "wide": np.where(rng.random(n) < 0.5, -1.5e308, 1.5e308),
    }
    names = list(data)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in np.column_stack(list(data.values()))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).withColumn("empty", F.lit(None).cast("double"))
    for leaf in (100_000, 50):
        got = quantile_grid(df, [*names, "empty"], 41, leaf_rows=leaf)
        assert got["empty"] == [] and list(got["one"]) == [3.0] * 41
        for c in ("even", "ties", "far", "gaps"):
            x = data[c][~np.isnan(data[c])]
            assert got[c] == pytest.approx(list(np.quantile(x, np.linspace(0, 1, 41))), rel=1e-12)
        assert len(got["endless"]) == len(got["wide"]) == 41 and got["endless"][:40] == pytest.approx(list(np.quantile(data["endless"], np.linspace(0, 1, 41))[:40]))
