"""Train / validation / test splits by date, by month, by sliding window over positions, and their random twins."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timetab.operators.ordering import HASH_RANGE, LEAF_ROWS, Cutoff, hash_order, order_cutoffs
from timetab.session import materialise

PARTS = ("train", "val", "test")


def part_by_bounds(time: str, val_from: Any, test_from: Any, end: Any = None) -> Column:
    """Part name by date bounds; rows without a time, and rows at or after ``end``, if given, get null."""
    t = F.col(time)
    out = F.when(t < F.lit(val_from), "train").when(t < F.lit(test_from), "val")
    return out.when(t.isNotNull() if end is None else t < F.lit(end), "test")


def split_by_dates(df: DataFrame, id_: str, time: str, val_from: Any, test_from: Any, end: Any = None) -> DataFrame:
    part = part_by_bounds(time, val_from, test_from, end)
    return (
        df.select(F.col(id_).alias("row_id"), F.lit("default").alias("split"), part.alias("part"))
        .where(F.col("part").isNotNull())
    )


def split_by_months(
    df: DataFrame, id_: str, time: str, val: tuple[int, Sequence[int]], test: tuple[int, Sequence[int]]
) -> DataFrame:
    """Validation and test are given as (year, months); train is everything before the first validation row."""
    t = F.col(time)
    in_val = (F.year(t) == val[0]) & F.month(t).isin(list(val[1]))
    in_test = (F.year(t) == test[0]) & F.month(t).isin(list(test[1]))
    first = df.where(in_val).agg(F.min(t).cast("string")).first()[0]
    if first is None:
        raise ValueError(f"no validation rows in {val}, so the train part has no end")
    before = t < F.lit(first).cast(df.schema[time].dataType)
    part = F.when(in_val, "val").when(in_test, "test").when(before, "train")
    return (
        df.select(F.col(id_).alias("row_id"), F.lit("default").alias("split"), part.alias("part"))
        .where(F.col("part").isNotNull())
    )


def window_sizes(rows: int, size: int, windows: int = 3) -> int:
    """Rows of the train part of each window; val and test have ``size`` rows, window i starts at row i*size."""
    train = rows - (windows - 1) * size - 2 * size
    if train <= 0:
        raise ValueError(f"{rows} rows are too few for {windows} windows with {size} validation and test rows")
    return train


def _window_cutoffs(
    df: DataFrame, id_: str, time: str, size: int | float, windows: int, leaf_rows: int = LEAF_ROWS
) -> tuple[int, int, list[tuple[Cutoff, Cutoff, Cutoff, Cutoff]]]:
    """Rows per train and per val or test part, and each window's start, validation start, test start and end."""
    fixed: dict[str, int] = {}

    def borders(n: int) -> list[int]:
        fixed["size"] = int(size * n) if isinstance(size, float) else size
        fixed["train"] = window_sizes(n, fixed["size"], windows)
        return [
            i * fixed["size"] + at for i in range(windows)
            for at in (0, fixed["train"], fixed["train"] + fixed["size"], fixed["train"] + 2 * fixed["size"])
        ]

    cuts = order_cutoffs(df.select(time, id_), [time, id_], borders, leaf_rows=leaf_rows)
    return fixed["train"], fixed["size"], [tuple(cuts[4 * i : 4 * i + 4]) for i in range(windows)]


def _inside(cuts: tuple[Cutoff, Cutoff, Cutoff, Cutoff]) -> str:
    return f"({cuts[0].condition()} AND NOT ({cuts[3].condition()}))"


def _part(cuts: tuple[Cutoff, Cutoff, Cutoff, Cutoff], val: Cutoff, test: Cutoff) -> Column:
    """Part of the rows inside a window, null outside."""
    return F.expr(f"""
        CASE WHEN NOT {_inside(cuts)} THEN NULL WHEN {test.condition()} THEN 'test' WHEN {val.condition()} THEN 'val'
        ELSE 'train' END
    """)


def _emit(df: DataFrame, id_: str, named: list[tuple[str, Column]]) -> DataFrame:
    """One output row per split a row belongs to, in a single scan."""
    entries = F.array(*[
        F.when(part.isNotNull(), F.struct(F.lit(name).alias("split"), part.alias("part"))) for name, part in named
    ])
    hits = F.explode(F.filter(entries, lambda e: e.isNotNull()))
    return df.select(F.col(id_).alias("row_id"), hits.alias("e")).select("row_id", "e.split", "e.part")


def _sliding(windows: list[tuple[Cutoff, Cutoff, Cutoff, Cutoff]]) -> list[tuple[str, Column]]:
    return [(f"sliding-window-{i}", _part(cuts, cuts[1], cuts[2])) for i, cuts in enumerate(windows)]


def _random(
    df: DataFrame, id_: str, train: int, size: int, seed: int,
    windows: list[tuple[Cutoff, Cutoff, Cutoff, Cutoff]], leaf_rows: int = LEAF_ROWS,
) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """Window i is cut at two places of its rows' hash order; all windows are searched together, one key range each.

    The hashes are stored, since every round of the search and the split itself read them.
    """
    df = materialise(df.withColumns({
        f"_h{i}": F.lit(i * HASH_RANGE) + hash_order(seed, F.lit(i), id_) for i in range(len(windows))
    }), "hashed")
    keys = ", ".join(f"IF({_inside(cuts)}, _h{i}, NULL)" for i, cuts in enumerate(windows))
    rows = df.select(F.explode(F.expr(f"array_compact(array({keys}))")).alias("key"), id_)
    total = train + 2 * size
    found = order_cutoffs(
        rows, ["key", id_], [i * total + at for i in range(len(windows)) for at in (train, train + size)],
        known=(0, len(windows) * HASH_RANGE - 1, len(windows) * total), leaf_rows=leaf_rows,
    )
    out = []
    for i, cuts in enumerate(windows):
        val, test = (c.renamed({"key": f"_h{i}"}) for c in found[2 * i : 2 * i + 2])
        out.append((f"random-{i}", _part(cuts, val, test)))
    return df, out


def split_sliding(
    df: DataFrame, id_: str, time: str, size: int | float, windows: int = 3, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """Windows over the rows sorted by (time, id), each ``size`` rows (or share of the rows) later than the one before.

    Only the border rows are searched for; every row is then placed by comparison with those literals.
    """
    _, _, cuts = _window_cutoffs(df, id_, time, size, windows, leaf_rows)
    return _emit(df, id_, _sliding(cuts))


def split_random(df: DataFrame, id_: str, time: str, size: int | float, windows: int = 3, seed: int = 0, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The same windows with their rows shuffled by a seeded hash, cut to the same sizes."""
    df = df.select(time, id_)
    train, rows, cuts = _window_cutoffs(df, id_, time, size, windows, leaf_rows)
    hashed, named = _random(df, id_, train, rows, seed, cuts, leaf_rows)
    return _emit(hashed, id_, named)


def all_splits(
    df: DataFrame, id_: str, time: str, size: int | float, default: Column, windows: int = 3, seed: int = 0,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """The default split, the sliding windows and their random twins as one (row_id, split, part) table."""
    df = df.select(time, id_, default.alias("_default"))
    train, rows, cuts = _window_cutoffs(df, id_, time, size, windows, leaf_rows)
    hashed, random = _random(df, id_, train, rows, seed, cuts, leaf_rows)
    return _emit(hashed, id_, [("default", F.col("_default")), *_sliding(cuts), *random])


def overlaps(splits: DataFrame) -> DataFrame:
    """Rows that stand in more than one part of a split; empty for a sound split."""
    return splits.groupBy("split", "row_id").agg(F.count(F.lit(1)).alias("n_parts")).where(F.col("n_parts") > 1)


def split_spans(df: DataFrame, splits: DataFrame, id_: str, time: str) -> DataFrame:
    """Rows, first and last time and whole days covered, per split and part."""
    return (
        df.select(F.col(id_).alias("row_id"), time).join(splits, "row_id")
        .groupBy("split", "part")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("start"), F.max(time).alias("end"))
        .withColumn("days", F.datediff("end", "start"))
    )
