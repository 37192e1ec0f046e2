"""Feature scaling fitted on the training part; the fitted parameters are a few numbers per column."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timetab.functions.columns import finite
from timetab.functions.probability import inverse_normal
from timetab.operators.ordering import HASH_RANGE, hash_order
from timetab.operators.quantiles import quantile_grid
from timetab.session import materialise

# Quantile scaling clips this close to 0 and 1; fewest and most grid points, rows per point; noise sizes.
EDGE = 1e-7
MIN_POINTS, MAX_POINTS, ROWS_PER_POINT = 10, 1000, 30
NOISE = 1e-5
RELATIVE_NOISE = 1e-3


def mean_and_std(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column, nulls and NaN left out, from one aggregate."""
    parts = []
    for c in columns:
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        parts += [F.avg(v).alias(f"m_{c}"), F.stddev_pop(v).alias(f"s_{c}")]
    row = train.agg(*parts).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in columns}


def scale_standard(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std, a constant column only centred, missing values 0."""
    return df.withColumns({
        c: finite((F.col(c).cast("double") - m) / (s if s > 0 else 1.0)) for c, (m, s) in fitted.items()
    })


def scale_identity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in columns})


def grid_points(rows: int) -> int:
    return max(min(rows // ROWS_PER_POINT, MAX_POINTS), MIN_POINTS)


def normal_noise(seed: int, row_id: str, column: str) -> Column:
    """A standard normal number per row and column that is the same on every run (Box-Muller on two hashes)."""
    unit = [(hash_order(f"{seed}/{column}/{i}", row_id).cast("double") + 0.5) / float(HASH_RANGE) for i in (0, 1)]
    return F.sqrt(-2.0 * F.log(unit[0])) * F.cos(2.0 * math.pi * unit[1])


def fit_quantiles(
    train: DataFrame, columns: Sequence[str], *, noise: str | None = None, seed: int = 0, row_id: str = "row_id",
    exact: bool = True,
) -> dict[str, list[float]]:
    """Quantile grid per column. ``noise`` breaks ties in the training values only: "fixed" or "relative" size."""
    points = grid_points(train.count())
    if noise is not None:
        size = {c: NOISE for c in columns}
        if noise == "relative":
            size = {c: RELATIVE_NOISE / max(s, RELATIVE_NOISE) for c, (_, s) in mean_and_std(train, columns).items()}
        train = train.withColumns({
            c: F.col(c).cast("double") + size[c] * normal_noise(seed, row_id, c) for c in columns
        })
        # The grid takes several passes; the noise is worked out once.
        train = materialise(train.select(*columns), "noised")
    return quantile_grid(train, columns, points, exact)


def _place_in(grid: list[float], normal: bool):
    """Arrow UDF: the share of the fitted grid below each value, ties taken at their middle; missing values give 0."""
    edge, to_normal = EDGE, inverse_normal()

    @F.pandas_udf(T.DoubleType())
    def place(values: pd.Series) -> pd.Series:
        import numpy as np

        knots = np.asarray(grid)
        share = np.linspace(0.0, 1.0, len(knots))
        x = values.to_numpy(dtype="float64", na_value=np.nan)
        out = 0.5 * (np.interp(x, knots, share) - np.interp(-x, -knots[::-1], -share[::-1]))
        out = np.where(x - edge < knots[0], 0.0, np.where(x + edge > knots[-1], 1.0, out))
        if normal:
            out = to_normal(np.clip(out, edge, 1.0 - edge))
        return pd.Series(np.where(np.isnan(x), 0.0, out))

    return place


def scale_quantile(df: DataFrame, fitted: dict[str, list[float]], output: str = "normal") -> DataFrame:
    """Map each value to its place in the fitted grid, as a share (``uniform``) or on the normal scale; missing is 0."""
    normal = output == "normal"
    return df.withColumns({
        c: _place_in(grid, normal)(F.col(c).cast("double")) if grid else F.lit(0.0) for c, grid in fitted.items()
    })


@dataclass(frozen=True)
class LabelScale:
    mean: float
    std: float

    def apply(self, y: str | Column) -> Column:
        return ((F.col(y) if isinstance(y, str) else y) - self.mean) / self.std

    def invert(self, prediction: str | Column) -> Column:
        return (F.col(prediction) if isinstance(prediction, str) else prediction) * self.std + self.mean


def fit_label(train: DataFrame, y: str = "y") -> LabelScale:
    """Mean and std of the label; a constant one is only centred."""
    mean, std = mean_and_std(train, [y])[y]
    return LabelScale(mean, std if std > 0 else 1.0)


def fit_bins(train: DataFrame, columns: Sequence[str], bins: int, exact: bool = True) -> dict[str, list[float]]:
    """Distinct quantile edges per column for the piecewise-linear encoding."""
    grids = quantile_grid(train, columns, bins + 1, exact)
    return {c: sorted(set(g)) for c, g in grids.items()}


def piecewise_linear(c: str, edges: list[float]) -> Column:
    """One entry per bin: how far the value has passed through it. The first bin is open below, the last above."""
    x = F.col(c).cast("double")
    parts = []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        v = (x - low) / (high - low)
        if i > 0:
            v = F.greatest(v, F.lit(0.0))
        if i < len(edges) - 2:
            v = F.least(v, F.lit(1.0))
        parts.append(v)
    return F.array(*parts)


def assemble(
    df: DataFrame, num: Sequence[str], bin_: Sequence[str] = (), codes: dict[str, int] | None = None,
    output: str = "features",
) -> DataFrame:
    """One sparse-friendly vector of numeric, binary and one-hot coded columns (``codes``: code column -> size)."""
    parts = [*num, *bin_]
    if codes:
        hot = {c: f"_hot_{c}" for c in codes}
        # A code past the last seen one stands for "unseen" and becomes all zeros.
        sized = df.withColumns({f"_in_{c}": F.least(F.col(c), F.lit(n)).cast("double") for c, n in codes.items()})
        for c, n in codes.items():
            field = sized.schema[f"_in_{c}"].name
            meta = {"ml_attr": {"type": "nominal", "name": field, "vals": [str(i) for i in range(n + 1)]}}
            sized = sized.withColumn(field, F.col(field).alias(field, metadata=meta))
        encoder = OneHotEncoder(
            inputCols=[f"_in_{c}" for c in codes], outputCols=list(hot.values()), dropLast=True, handleInvalid="error"
        )
        df = encoder.fit(sized).transform(sized).drop(*[f"_in_{c}" for c in codes])
        parts += list(hot.values())
    out = VectorAssembler(inputCols=parts, outputCol=output, handleInvalid="keep").transform(df)
    return out.drop(*[p for p in parts if p.startswith("_hot_")])
