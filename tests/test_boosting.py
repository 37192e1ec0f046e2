"""Histogram boosting against a plain version on arrays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array

from timetab.plans import boosting
from timetab.plans.boosting import bin_codes, feature_edges, first_of_best, fit_histogram, split_gains




def plain_fit(task, x, y, xv, yv, edges, rounds, depth, rate, l2, patience):
    """Level by level over rows and thresholds; returns the margins of (x, xv) and the number of rounds fitted and kept."""
    k = 1 if task != "multiclass" else int(y.max()) + 1
    base = y.mean() if task == "regression" else 0.0
    m, mv = np.full((len(x), k), base), np.full((len(xv), k), base)

    def derivatives(m, y):
        if task == "regression":
            return m - y[:, None], np.ones_like(m), np.mean((m[:, 0] - y) ** 2)
        if task == "binclass":
            p = 1 / (1 + np.exp(-m))
            return p - y[:, None], p * (1 - p), -np.mean(np.log(np.where(y == 1, p[:, 0], 1 - p[:, 0])))
        p = np.exp(m) / np.exp(m).sum(1, keepdims=True)
        return p - np.eye(k)[y.astype(int)], p * (1 - p), -np.mean(np.log(p[np.arange(len(y)), y.astype(int)]))

    def best_split(rows, g, h):
        options = []
        for f in range(x.shape[1]):
            v = x[rows, f]
            for missing_left in (True, False):
                for e in edges[f]:
                    left = np.where(np.isnan(v), missing_left, v <= e)
                    if 0 < left.sum() < len(left):
                        parts = [(g[rows][s].sum(), h[rows][s].sum()) for s in (left, ~left)]
                        gain = sum(a * a / (b + l2) for a, b in parts) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                        options.append((gain, f, e, missing_left, parts))
        if not options:
            return None
        most = max(o[0] for o in options)
        return next(o for o in options if o[0] >= most - 1e-9 * abs(most)) if most > 1e-9 * abs(g[rows].sum()) else None

    history, states = [derivatives(mv, yv)[2]], [(m.copy(), mv.copy())]
    while len(history) - 1 < rounds and len(history) - 1 - int(np.argmin(history)) < patience:
        g, h, _ = derivatives(m, y)
        for c in range(k):
            nodes = [(np.arange(len(x)), np.arange(len(xv)), -rate * g[:, c].sum() / (h[:, c].sum() + l2))]
            leaves = []
            for _ in range(depth):
                grown = []
                for rows, vrows, value in nodes:
                    found = best_split(rows, g[:, c], h[:, c])
                    if found is None:
                        leaves.append((rows, vrows, value))
                        continue
                    _, f, e, missing_left, parts = found
                    for side in (True, False):
                        own = [r[np.where(np.isnan(z[r, f]), missing_left, z[r, f] <= e) == side] for r, z in ((rows, x), (vrows, xv))]
                        a, b = parts[0 if side else 1]
                        grown.append((*own, -rate * a / (b + l2)))
                nodes = grown
            for rows, vrows, value in leaves + nodes:
                m[rows, c] += value
                mv[vrows, c] += value
        history.append(derivatives(mv, yv)[2])
        states.append((m.copy(), mv.copy()))
    best = int(np.argmin(history))
    return states[best], len(history) - 1, best, history


def made(task, n=360, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    x[:, 3] = 1.0  # constant
    signal = x[:, 0] * 2 + (x[:, 1] > 0) * x[:, 2]
    x[rng.random((n, 4)) < 0.1] = np.nan
    noisy = signal + rng.normal(size=n) * 1.5
    y = noisy if task == "regression" else (noisy > 0).astype(float) if task == "binclass" else np.digitize(noisy, [-1, 1]).astype(float)
    return x, y


def frame(spark, x, y):
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "row_id long, x array<double>, y double")
    return df.select("row_id", array_to_vector("x").alias("features"), "y").repartition(5)


@pytest.mark.parametrize("task", ["regression", "binclass", "multiclass"])
def test_against_plain_version(spark, task, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    monkeypatch.setattr(boosting, "STORE_ROUNDS", 2)
    x, y = made(task)
    (x, xv), (y, yv) = np.split(x, [240]), np.split(y, [240])
    params = {"rounds": 30, "patience": 1, "depth": 2, "rate": 0.9, "bins": 8, "l2": 1.0}
    train = frame(spark, x, y)
    model = fit_histogram(train, task, params, val=frame(spark, xv, yv))
    edges = feature_edges(train.select(vector_to_array("features").alias("x")), 4, 8)
    (m, mv), fitted, best, history = plain_fit(task, x, y, xv, yv, edges, 30, 2, 0.9, 1.0, 1)
    assert (model.fitted, model.getNumTrees) == (fitted, best) and 0 < best < fitted < 30
    assert np.allclose(model.losses, history)
    assert np.allclose(model.margins(bin_codes(xv, edges)).T, mv)
    shown = sorted(model.transform(frame(spark, xv, yv)).collect(), key=lambda r: r["row_id"])
    if task == "regression":
        assert np.allclose([r["prediction"] for r in shown], mv[:, 0])
    else:
        e = np.exp(mv) if task == "multiclass" else np.exp(np.hstack([-mv / 2, mv / 2]))
        assert np.allclose([r["probability"].toArray() for r in shown], e / e.sum(1, keepdims=True))
        assert [r["prediction"] for r in shown] == list((e / e.sum(1, keepdims=True)).argmax(1))
    share = model.featureImportances.toArray()
    assert share.sum() == pytest.approx(1) and share[3] == 0 and share[0] == share.max()


def test_missing_values_choose_a_side(spark):
    x = np.array([[0.0]] * 20 + [[1.0]] * 20 + [[np.nan]] * 20)
    y = np.array([0.0] * 20 + [1.0] * 20 + [1.0] * 20)
    model = fit_histogram(frame(spark, x, y), "regression", {"rounds": 1, "depth": 1, "rate": 1.0, "l2": 0.0})
    got = {tuple(np.nan_to_num(r["features"].toArray(), nan=-1)): r["prediction"] for r in model.transform(frame(spark, x, y)).collect()}
    assert got == pytest.approx({(0.0,): 0.0, (1.0,): 1.0, (-1.0,): 1.0}) and model.getNumTrees == 1


def test_no_split(spark):
    """Constant features or labels give the base score; without validation all rounds stay."""
    x, y = np.ones((30, 2)), np.arange(30.0)
    model = fit_histogram(frame(spark, x, y), "regression", {"rounds": 3, "depth": 2, "rate": 1.0, "l2": 0.0})
    assert model.getNumTrees == 3
    assert {round(r["prediction"], 9) for r in model.transform(frame(spark, x, y)).collect()} == {14.5}
    with pytest.raises(ValueError):
        fit_histogram(frame(spark, x, y).limit(0), "regression", {})


def test_gains():
    sums = np.array([[[1.0, 1.0, 1.0], [2.0, 1.0, 1.0], [-4.0, 1.0, 1.0]]])
    gains, left_g, _ = split_gains(sums, 0.0, 1)
    assert gains.shape == (1, 2, 1) and gains[0, 0, 0] == pytest.approx(9 / 2 + 16 - 1 / 3) and left_g[0, 1, 0] == 2.0
    assert first_of_best(np.array([1.0, 3.0, 3.0 + 1e-12])) == 1
    assert not np.isfinite(split_gains(sums, 0.0, 3)[0]).any()


def test_blocks_reach_python_a_few_at_once(spark, monkeypatch):
    """An Arrow batch of blocks is bounded by bytes, not by Spark's number of rows."""
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    monkeypatch.setattr(boosting, "BATCH_BYTES", 2 * 50 * (2 * 2 + 8 + 8))
    sums = boosting._sums

    def checked(*given):
        inner = sums(*given)

        def run(batches):
            def few():
                for batch in batches:
                    assert batch.num_rows <= 2
                    yield batch

            yield from inner(few())

        return run

    monkeypatch.setattr(boosting, "_sums", checked)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1000, 2))
    rows = [(v.tolist(), float(v[0] > 0)) for v in x]
    train = spark.createDataFrame(rows, "x array<double>, y double").coalesce(1).select(array_to_vector("x").alias("features"), "y")
    model = fit_histogram(train, "regression", {"rounds": 2, "depth": 2})
    assert model.featureImportances.toArray()[0] > 0.9
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
