"""Exact-size seeded sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetab.operators.ordering import LEAF_ROWS, hash_order, order_cutoffs


def exact_sample(df: DataFrame, fraction: float, key: str, seed: int = 0, also: Sequence[str] = (), leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """floor(fraction * n) rows without replacement, the same ones on every run.

    Rows are ordered by a seeded hash of the unique ``key`` and the first ones kept. Only the border key is searched
    for, so the sample itself is a filter and moves no rows.
    """
    hashed = df.withColumn("_h", hash_order(seed, key, *also))
    border = order_cutoffs(hashed.select("_h", key), ["_h", key], lambda n: [int(fraction * n)], leaf_rows=leaf_rows)[0]
    return hashed.where(~border.reached()).drop("_h")
