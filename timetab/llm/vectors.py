"""Vectors as blocks of whole numbers; shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 2**53  # whole numbers up to here are exact as doubles


def usable(vector: Column, factor: int) -> Column:
    """True for a vector that has components, none of them null, NaN, infinite, or beyond ``MOST`` when multiplied by ``factor``."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(MOST / factor)))
    return F.coalesce((F.size(vector) > 0) & sound, F.lit(False))


def whole(flat: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x)."""
    return np.floor(flat.astype(np.float64) * factor).astype(np.int64)


def exact_integers(values: np.ndarray) -> np.ndarray:
    """The same numbers as Python's integers, which have no largest one."""
    return np.array(values.astype(np.int64).ravel().tolist(), dtype=object).reshape(values.shape)


def narrowed(values: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    for kind in (np.int8, np.int16, np.int32):
        info = np.iinfo(kind)
        if values.size == 0 or (values.min() >= info.min and values.max() <= info.max):
            return values.astype(kind)
    return values


def block_rows(rows: DataFrame, vector: str, cells: int, make: Callable[[pa.Table, np.ndarray], dict], schema: str) -> DataFrame:
    """One row ``make(rows, components)`` per block of rows whose vectors have one length, ``cells`` components at most (one row at
    least). ``rows`` must have usable vectors of doubles; nothing is shuffled."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[pa.Table]] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lengths = table[vector].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths).tolist():
                waiting.setdefault(dims, []).append(table.filter(pa.array(lengths == dims)))
                room = max(1, cells // dims)
                if sum(t.num_rows for t in waiting[dims]) >= room:
                    ready = pa.concat_tables(waiting[dims])
                    full = ready.num_rows - ready.num_rows % room
                    for a in range(0, full, room):
                        yield block(ready.slice(a, room), dims)
                    waiting[dims] = [ready.slice(full)]
        for dims, left in waiting.items():
            ready = pa.concat_tables(left)
            if ready.num_rows:
                yield block(ready, dims)

    def block(table: pa.Table, dims: int) -> pa.RecordBatch:
        flat = table[vector].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_pylist([make(table.drop_columns([vector]), flat.reshape(-1, dims))], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return rows.mapInArrow(blocks, schema)
