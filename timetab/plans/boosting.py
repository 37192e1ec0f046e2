"""Boosted trees from histograms: rounds that stop on validation, a direction for missing values, any number of classes.

Features are cut into bins once and stored as bytes. A level of all trees of a round takes one pass: every task sums gradients per (node,
feature, bin) over its rows, the sums are merged per feature, and only the best split of each node and feature reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timetab.session import materialise

BLOCK_ROWS = 1 << 16
BATCH_BYTES = 16 << 20  # of blocks that a Python task holds at once
STORE_ROUNDS = 8  # margins are stored anew after so many rounds
MERGE_TASKS = 16
QUANTILE_ACCURACY = 10_000
TIE = 1e-9
_BLOCK = "block long, n int, val boolean, codes binary, y binary, margins binary"
_SUMS = "feature int, bunch int, sums binary, loss double, held long"
_BEST = "tree int, node int, feature int, cut int, missing_left boolean, gain double, left_g double, left_h double, all_g double, all_h double, loss double, held long"


@dataclass
class Tree:
    """Nodes as lists; a leaf has feature -1. Codes up to ``cut`` go left, missing ones (code 0) as ``missing_left`` says."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    child: list[int] = field(default_factory=lambda: [-1])  # the left one; the right one follows it
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool, gain: float, values: tuple[float, float]) -> tuple[int, int]:
        left = len(self.feature)
        self.feature[node], self.cut[node], self.missing_left[node], self.child[node], self.gain[node] = feature, cut, missing_left, left, gain
        for v in values:
            for column, start in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.child, -1), (self.gain, 0.0)):
                column.append(start)
            self.value.append(v)
        return left, left + 1

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """Node in which each row ends; ``codes`` has one row per feature."""
        feature, cut, child = (np.array(c) for c in (self.feature, self.cut, self.child))
        missing, node = np.array(self.missing_left), np.zeros(codes.shape[1], dtype=np.int64)
        rows = np.arange(codes.shape[1])
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            code = codes[feature[at], rows]
            left = np.where(code == 0, missing[at], code <= cut[at])
            node[rows] = child[at] + ~left
        return node

    def values(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(codes)]


def bin_codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value by feature and row: 0 for a missing one, else one more than the number of edges below it."""
    out = np.empty((x.shape[1], len(x)), dtype=np.uint16)
    for f, e in enumerate(edges):
        out[f] = np.where(np.isnan(x[:, f]), 0, np.searchsorted(e, x[:, f], side="left") + 1)
    return out


def gradients(task: str, margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second derivative of the loss, by tree of the round and row, and the loss of each row."""
    if task == "regression":
        gap = margins[0] - y
        return gap[None], np.ones((1, len(y))), gap**2
    if task == "binclass":
        p = 1.0 / (1.0 + np.exp(-margins[0]))
        return (p - y)[None], (p * (1 - p))[None], np.logaddexp(0.0, np.where(y == 1, -margins[0], margins[0]))
    p = class_shares(margins)
    own = np.arange(len(margins))[:, None] == y[None, :]
    return p - own, p * (1 - p), -np.log(np.maximum(p[own.argmax(0), np.arange(len(y))], 1e-300))


def class_shares(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=0))
    return e / e.sum(axis=0)


def split_gains(sums: np.ndarray, l2: float, leaf_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gains of all splits of some nodes on one feature: ``sums`` has (g, h, rows) by node and bin, bin 0 being the missing values.

    Returns gain by node, direction of the missing (left, right) and cut, and g and h of the left side.
    """
    total = sums.sum(axis=1)
    known = np.cumsum(sums[:, 1:], axis=1)[:, :-1]  # a cut after each bin but the last
    left = np.stack([known + sums[:, :1], known], axis=1)
    right = total[:, None, None] - left

    def score(part: np.ndarray) -> np.ndarray:
        return part[..., 0] ** 2 / np.maximum(part[..., 1] + l2, 1e-300)

    gain = score(left) + score(right) - score(total)[:, None, None]
    fits = (left[..., 2] >= leaf_rows) & (right[..., 2] >= leaf_rows)
    return np.where(fits, gain, -np.inf), left[..., 0], left[..., 1]


def first_of_best(gains: np.ndarray) -> int:
    """The first place whose value is the largest, but for rounding."""
    most = gains.max()
    return int(np.flatnonzero(gains >= most - TIE * abs(most))[0])


class HistogramModel:
    """A fitted model: per round one tree, or one per class."""

    def __init__(self, task: str, edges: list[np.ndarray], base: np.ndarray, rounds: list[list[Tree]], fitted: int, losses: list[float]):
        self.task, self.edges, self.base, self.rounds = task, edges, base, rounds
        self.fitted, self.losses = fitted, losses

    @property
    def getNumTrees(self) -> int:  # noqa: N802  as MLlib's models call it
        return len(self.rounds)

    @property
    def featureImportances(self):  # noqa: N802
        """Share of each feature in the gain of all splits."""
        total = np.zeros(len(self.edges))
        for tree in (t for trees in self.rounds for t in trees):
            for f, gain in zip(tree.feature, tree.gain):
                if f >= 0:
                    total[f] += gain
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    def margins(self, codes: np.ndarray) -> np.ndarray:
        out = np.repeat(self.base[:, None], codes.shape[1], axis=1)
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[k] += tree.values(codes)
        return out

    def transform(self, data: DataFrame) -> DataFrame:
        """Adds ``prediction``, and for classes ``probability``."""

        @F.pandas_udf("array<double>")
        def margins(features: pd.Series) -> pd.Series:
            x = np.stack(features.to_numpy()).astype(np.float64) if len(features) else np.empty((0, len(self.edges)))
            return pd.Series(list(self.margins(bin_codes(x, self.edges)).T))

        out = data.withColumn("_margins", margins(vector_to_array("features")))
        if self.task == "regression":
            return out.withColumn("prediction", F.col("_margins")[0]).drop("_margins")
        if self.task == "binclass":
            one = 1.0 / (1.0 + F.exp(-F.col("_margins")[0]))
            shares = F.array(1.0 - one, one)
        else:
            e = F.transform("_margins", lambda m: F.exp(m - F.array_max("_margins")))
            shares = F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
        out = out.withColumn("_shares", shares).drop("_margins")
        best = (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double")
        return out.withColumns({"probability": array_to_vector("_shares"), "prediction": best}).drop("_shares")


def feature_edges(rows: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """Upper edges of the bins but the last, from quantiles of each feature's values: at most ``bins - 1``."""
    shares = [i / bins for i in range(1, bins)]
    value = [F.when(~F.isnan(F.col("x")[f]), F.col("x")[f]) for f in range(features)]
    found = rows.agg(*[F.percentile_approx(v, shares, QUANTILE_ACCURACY).alias(f"q{f}") for f, v in enumerate(value)],
                     *[F.max(v).alias(f"m{f}") for f, v in enumerate(value)]).first()
    edges = []
    for f in range(features):
        e = np.unique(np.array(found[f"q{f}"] or [], dtype=np.float64))
        edges.append(e[e < found[f"m{f}"]] if len(e) else e)
    return edges


def _store(rows: DataFrame, edges: list[np.ndarray], base: np.ndarray) -> DataFrame:
    """Blocks of binned rows with their labels and first margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for val in (False, True):
                own = batch.filter(pc.equal(batch.column("val"), val))
                for a in range(0, own.num_rows, BLOCK_ROWS):
                    part = own.slice(a, BLOCK_ROWS)
                    x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    codes = bin_codes(x, edges)
                    yield pa.RecordBatch.from_pylist([{
                        "block": number, "n": part.num_rows, "val": val, "codes": codes.tobytes(),
                        "y": part.column("y").to_numpy(zero_copy_only=False).tobytes(), "margins": np.repeat(base, part.num_rows).tobytes(),
                    }], schema=schema)
                    number += 1

    schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("val", pa.bool_()), ("codes", pa.binary()), ("y", pa.binary()), ("margins", pa.binary())])
    return rows.mapInArrow(run, _BLOCK)


@contextmanager
def _few_at_once(spark: SparkSession, features: int, outputs: int) -> Iterator[None]:
    """Blocks reach Python in batches of ``BATCH_BYTES``: Spark counts a block as one row, and would send thousands of them together."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(1, BATCH_BYTES // (BLOCK_ROWS * (2 * features + 8 + 8 * outputs)))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _opened(block: dict, features: int, outputs: int, rounds: list[list[Tree]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, labels and present margins of a stored block, ``rounds`` being those after it was stored."""
    codes = np.frombuffer(block["codes"], dtype=np.uint16).reshape(features, block["n"])
    margins = np.frombuffer(block["margins"]).reshape(outputs, block["n"]).copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            margins[k] += tree.values(codes)
    return codes, np.frombuffer(block["y"]), margins


def _restored(blocks: DataFrame, features: int, outputs: int, rounds: list[list[Tree]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{**block, "margins": _opened(block, features, outputs, rounds)[2].tobytes()} for block in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return materialise(blocks.mapInArrow(run, _BLOCK), "margins")


def _sums(task: str, features: int, outputs: int, widths: list[int], rounds: list[list[Tree]], growing: list[Tree], active: list[list[int]], with_loss: bool):
    """A task's sums of (g, h, rows) per feature, by active node and bin, over its training rows; the loss over its validation rows."""
    slots = sum(map(len, active))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((slots, w, 3)) for w in widths]
        loss, held = 0.0, 0
        for batch in batches:
            for block in batch.to_pylist():
                if block["val"] and not with_loss:
                    continue
                codes, y, margins = _opened(block, features, outputs, rounds)
                g, h, losses = gradients(task, margins, y)
                if block["val"]:
                    loss, held = loss + float(losses.sum()), held + len(y)
                    continue
                first = 0
                for k, nodes in enumerate(active):
                    place = np.full(len(growing[k].feature), -1, dtype=np.int64)
                    place[nodes] = np.arange(first, first + len(nodes))
                    first += len(nodes)
                    at = place[growing[k].leaves(codes)]
                    rows = np.flatnonzero(at >= 0)
                    for f, w in enumerate(widths):
                        cell = at[rows] * w + codes[f, rows]
                        for j, weights in enumerate((g[k][rows], h[k][rows], None)):
                            sums[f][..., j] += np.bincount(cell, weights, minlength=slots * w).reshape(slots, w)
        bunch = TaskContext.get().partitionId() // MERGE_TASKS
        yield pa.RecordBatch.from_pylist([
            {"feature": f, "bunch": bunch, "sums": s.tobytes(), "loss": loss if f == 0 else 0.0, "held": held if f == 0 else 0} for f, s in enumerate(sums)
        ], schema=pa.schema([("feature", pa.int32()), ("bunch", pa.int32()), ("sums", pa.binary()), ("loss", pa.float64()), ("held", pa.int64())]))

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(s) for s in pdf["sums"]], axis=0)
    return pd.DataFrame({"feature": pdf["feature"].iloc[:1], "bunch": pdf["bunch"].iloc[:1], "sums": [total.tobytes()],
                         "loss": [pdf["loss"].sum()], "held": [pdf["held"].sum()]})


def _best_splits(widths: list[int], active: list[list[int]], l2: float, leaf_rows: int):
    slots = [(k, node) for k, nodes in enumerate(active) for node in nodes]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        merged = _added(pdf).iloc[0]
        sums = np.frombuffer(merged["sums"]).reshape(len(slots), widths[key[0]], 3)
        gains, left_g, left_h = split_gains(sums, l2, leaf_rows)
        out = []
        for i, (k, node) in enumerate(slots):
            total, flat = sums[i].sum(axis=0), gains[i].ravel()
            best = first_of_best(flat) if flat.size and np.isfinite(flat).any() else None
            direction, cut = (0, 0) if best is None else np.unravel_index(best, gains[i].shape)
            out.append((
                k, node, key[0], int(cut) + 1, direction == 0, -np.inf if best is None else flat[best],
                0.0 if best is None else left_g[i][direction, cut], 0.0 if best is None else left_h[i][direction, cut], total[0], total[1],
                merged["loss"], merged["held"],
            ))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _BEST.split(", ")])

    return run


def fit_histogram(train: DataFrame, task: str, params: dict, seed: int = 0, val: DataFrame | None = None) -> HistogramModel:
    """Boosted trees on ``features`` and ``y``; for classes ``y`` is the 0-based class. Missing features are NaN.

    Parameters: ``rounds`` (at most), ``patience`` (stop after so many rounds without a lower loss on ``val``), ``depth``, ``rate``, ``bins``,
    ``leaf_rows``, ``l2`` and ``min_gain``. The model keeps the rounds up to the lowest validation loss. Of equally good splits the one on the
    first feature with the lowest cut is taken, missing values going left. Nothing is drawn at random; the seed has no effect.
    """
    rounds, depth, rate = params.get("rounds", 100), params.get("depth", 5), params.get("rate", 0.1)
    l2, leaf_rows, least = params.get("l2", 1.0), params.get("leaf_rows", 1), params.get("min_gain", 0.0)
    patience, bins = params.get("patience", 10), params.get("bins", 64)
    if not 2 <= bins < 1 << 16:
        raise ValueError("bins must be 2 to 65535")

    def taken(rows: DataFrame, val: bool) -> DataFrame:
        return rows.select(vector_to_array("features").alias("x"), F.col("y").cast("double").alias("y"), F.lit(val).alias("val"))

    spark, rows = train.sparkSession, taken(train, False)
    known = rows.agg(F.max(F.size("x")).alias("features"), F.avg("y").alias("mean"), F.max("y").alias("most")).first()
    if known["features"] is None:
        raise ValueError("no training rows")
    features = known["features"]
    edges = feature_edges(rows, features, bins)
    outputs = 1 if task != "multiclass" else int(known["most"]) + 1
    base = np.full(outputs, known["mean"] if task == "regression" else 0.0)
    widths = [len(e) + 2 for e in edges]
    every = rows if val is None else rows.unionByName(taken(val, True))
    blocks = materialise(_store(every, edges, base), "binned").persist(StorageLevel.MEMORY_AND_DISK)

    done: list[list[Tree]] = []
    losses: list[float] = []
    stored = 0
    try:
        while len(done) < rounds or (val is not None and len(losses) <= len(done)):
            if len(done) - stored >= STORE_ROUNDS:
                with _few_at_once(spark, features, outputs):
                    older, blocks = blocks, _restored(blocks, features, outputs, done[stored:]).persist(StorageLevel.MEMORY_AND_DISK)
                older.unpersist()
                stored = len(done)
            trees, active = [Tree() for _ in range(outputs)], [[0] for _ in range(outputs)]
            for level in range(depth):
                with_loss = level == 0 and val is not None
                partial = blocks.mapInArrow(_sums(task, features, outputs, widths, done[stored:], trees, active, with_loss), _SUMS)
                partial = partial.groupBy("feature", "bunch").applyInPandas(_added, _SUMS)
                # Rows: nodes of the level times features.
                splits = partial.groupBy("feature").applyInPandas(_best_splits(widths, active, l2, leaf_rows), _BEST)
                with _few_at_once(spark, features, outputs):
                    found = splits.toPandas()
                if with_loss:
                    held = found["held"].max()
                    losses.append(float(found["loss"].max()) / held if held else np.inf)
                    best = int(np.argmin(losses))
                    if len(losses) - 1 - best >= patience or len(done) >= rounds:
                        return HistogramModel(task, edges, base, done[:best], len(done), losses)
                following: list[list[int]] = [[] for _ in range(outputs)]
                for (k, node), own in found.sort_values("feature").groupby(["tree", "node"]):
                    row = own.iloc[first_of_best(own["gain"].to_numpy())] if np.isfinite(own["gain"]).any() else own.iloc[0]
                    if node == 0:
                        trees[k].value[0] = -rate * row["all_g"] / max(row["all_h"] + l2, 1e-300)
                    if not np.isfinite(row["gain"]) or row["gain"] <= max(least, TIE * abs(row["all_g"])):
                        continue
                    sides = ((row["left_g"], row["left_h"]), (row["all_g"] - row["left_g"], row["all_h"] - row["left_h"]))
                    values = tuple(-rate * g / max(h + l2, 1e-300) for g, h in sides)
                    following[k] += trees[k].split(node, int(row["feature"]), int(row["cut"]), bool(row["missing_left"]), row["gain"], values)
                active = following
                if not any(active):
                    break
            done.append(trees)
        return HistogramModel(task, edges, base, done, len(done), losses)
    finally:
        blocks.unpersist()
