"""Equi-joins that stay balanced: broadcast behind a size check, salted hot keys beyond it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetab.session import BROADCAST_BYTES, broadcast_if_small, materialise

TASK_ROWS = 5_000_000  # a key with more rows than this is dealt out to as many tasks as it takes


def hot_values(df: DataFrame, key: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``(key, salts)`` of every value with more than ``task_rows`` rows: how many tasks such a value needs.

    Rows are counted map-side, on the key alone. The table has less than ``rows / task_rows`` rows.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > task_rows) & F.col(key).isNotNull())
    return materialise(counts.select(key, F.ceil(F.col("n") / F.lit(task_rows)).cast("int").alias("_salts")), "hot")


def lookup_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", limit: int = BROADCAST_BYTES, task_rows: int = TASK_ROWS
) -> DataFrame:
    """``big`` joined to ``small`` (unique on ``on``).

    ``small`` is stored, so that it is made once, and broadcast when its measured size fits ``limit``. Otherwise both sides
    shuffle on the key plus a salt (see ``salted_join``).
    """
    on = list(on)
    hinted, fits = broadcast_if_small(materialise(small, "small"), limit)
    if fits:
        return big.join(hinted, on, how)
    return salted_join(big, hinted, on, how, task_rows=task_rows)


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", hot: DataFrame | None = None, task_rows: int = TASK_ROWS
) -> DataFrame:
    """The shuffled form of ``lookup_join``: a hot key of ``big`` gets as many salts as its counted rows need.

    The matching row of ``small`` is repeated once per salt. Rows with a null key match nothing and go anywhere. The salt
    hashes the row and the partition it was read in: equal rows spread too, and a task that is run again gives every row the
    same salt as before. ``hot`` is the table of ``hot_values`` where the caller has it.
    """
    on = list(on)
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in big.columns], F.spark_partition_id())
    hot = hot_values(big, on[0], task_rows) if hot is None else hot
    # Bounded by rows / task_rows; Spark checks its size before it broadcasts the stored table.
    left = big.join(hot, on[0], "left").withColumn(
        "_salt", F.when(F.col(f"`{on[0]}`").isNull(), F.pmod(spread, F.lit(1 << 16))).otherwise(
            F.coalesce(F.pmod(spread, F.col("_salts")), F.lit(0))).cast("int")
    ).drop("_salts")
    right = small.join(hot, on[0], "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_salts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which a null key meets a null key; the keys of ``left`` stay."""
    names = {c: f"_right_{c}" for c in on}
    condition = None
    for c, other in names.items():
        same = F.col(f"`{c}`").eqNullSafe(F.col(f"`{other}`"))
        condition = same if condition is None else condition & same
    return left.join(right.withColumnsRenamed(names), condition, how).drop(*names.values())


def chain_left_joins(base: DataFrame, tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Left-join feature tables, each unique on ``key``, one after the other.

    A column that is already there gets the suffix ``_i`` of its table. All sides hash on the same key, so ``base``
    shuffles at most once for the whole chain.
    """
    for i, table in enumerate(tables):
        taken = set(base.columns) - {key}
        table = table.withColumnsRenamed({c: f"{c}_{i}" for c in table.columns if c in taken})
        base = base.join(table, key, "left")
    return base


def with_suffix(df: DataFrame, keep: Sequence[str], suffix: str = "_right") -> DataFrame:
    """Rename all columns but ``keep``, ahead of a join with a table that has the same names."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in keep})


def update_join(
    base: DataFrame, fixes: DataFrame, on: str, order: Sequence[str] = (), limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Overwrite columns of ``base`` with the non-null values of ``fixes``; rows without a fix stay as they are.

    Of several fixes for one id, each column takes its last non-null value in ``order`` (largest value by default).
    """
    columns = [c for c in fixes.columns if c in base.columns and c != on]
    latest = fixes.groupBy(on).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*[F.col(o) for o in order], F.col(c)))).alias(f"_fix_{c}")
        for c in columns
    ])
    joined = lookup_join(base, latest, [on], "left", limit)
    return joined.withColumns({
        c: F.coalesce(F.col(f"_fix_{c}").cast(base.schema[c].dataType), F.col(c)) for c in columns
    }).select(*base.columns)


def in_table(df: DataFrame, ids: DataFrame, on: str, limit: int = BROADCAST_BYTES, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows whose id is in ``ids``; hot ids are dealt out as in ``lookup_join``."""
    return lookup_join(df, ids.select(on).distinct(), [on], "left_semi", limit, task_rows).select(*df.columns)


def not_in_table(df: DataFrame, ids: DataFrame, on: str, limit: int = BROADCAST_BYTES, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows whose id is not in ``ids``, rows without an id among them."""
    return lookup_join(df, ids.select(on).distinct(), [on], "left_anti", limit, task_rows).select(*df.columns)


def gather(df: DataFrame, split: DataFrame, part: str | None = None, on: str = "row_id") -> DataFrame:
    """Rows of one split (and part) with their part name; ``row_id`` carries identity, never the row order."""
    wanted = split if part is None else split.where(F.col("part") == part)
    return df.join(wanted.select(on, "part"), on)
