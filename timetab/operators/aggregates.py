"""Generated per-entity aggregates, histograms and covariance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The last letter of a column name says what the column holds.
NUMERIC_SUFFIXES = ("P", "A", "T", "L")
CATEGORY_SUFFIX = "M"
DATE_SUFFIX = "D"


def numeric_aggregates(df: DataFrame, c: str) -> list[Column]:
    """max, min, mean and sample std; a column that is not numeric has no mean and std."""
    numeric = isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))
    v = F.col(c).cast("double") if numeric else F.lit(None).cast("double")
    return [
        F.max(c).alias(f"max_{c}"), F.min(c).alias(f"min_{c}"), F.avg(v).alias(f"mean_{c}"),
        F.stddev_samp(v).alias(f"std_{c}"),
    ]


def category_aggregates(c: str, order: Sequence[str]) -> list[Column]:
    """First and last value in the given order, null kept."""
    key = F.struct(*order)
    return [F.max_by(c, key).alias(f"last_{c}"), F.min_by(c, key).alias(f"first_{c}")]


def distinct_per_entity(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``n_unique_<column>`` per entity, null counted as a value: one long aggregate for all columns, not one Expand branch each."""
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)])
    values = df.select(key, F.explode(pairs).alias("e")).select(key, "e.c", "e.v").distinct()
    return values.groupBy(key).agg(*[F.count_if(F.col("c") == i).alias(f"n_unique_{c}") for i, c in enumerate(columns)])


def date_aggregates(c: str) -> list[Column]:
    """max and min as dates; mean as fractional epoch days, std in days."""
    days = F.unix_date(F.col(c).cast("date")).cast("double")
    return [
        F.max(F.col(c).cast("date")).alias(f"max_{c}"), F.min(F.col(c).cast("date")).alias(f"min_{c}"),
        F.avg(days).alias(f"mean_{c}"), F.stddev_samp(days).alias(f"std_{c}"),
    ]


def entity_features(df: DataFrame, key: str, order: Sequence[str], group_index: str | None = None) -> DataFrame:
    """One row per entity with the aggregates each column's last letter asks for.

    Numbers and dates have fixed-width states and hash-aggregate map-side; categories need their first and last value
    and aggregate apart, so that they do not pull the wide numeric part into a sort. Both sides hash on ``key``.
    ``group_index`` adds the largest index of the entity's rows.
    """
    rest = [c for c in df.columns if c != key]
    plain: list[Column] = []
    for c in rest:
        if c.endswith(NUMERIC_SUFFIXES):
            plain += numeric_aggregates(df, c)
        elif c.endswith(DATE_SUFFIX):
            plain += date_aggregates(c)
    if group_index is not None:
        plain.append(F.max(group_index).alias(f"max_{group_index}"))
    named = [c for c in rest if c.endswith(CATEGORY_SUFFIX)]
    if not named:
        return df.groupBy(key).agg(*plain)
    ends = df.groupBy(key).agg(*[a for c in named for a in category_aggregates(c, order)])
    # Null keys match in neither join below; they are one entity in all parts.
    out = ends.join(distinct_per_entity(df, key, named).withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    if not plain:
        return out
    wide = df.groupBy(key).agg(*plain)
    return wide.join(out.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def histogram(df: DataFrame, c: str, bins: int = 100, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Counts in equal steps between the smallest and largest value kept; the last step holds the largest value."""
    rows = df.where(keep(F.col(c))) if keep else df
    low, high = rows.agg(F.min(c).cast("double"), F.max(c).cast("double")).first()
    if low is None:
        return rows.select(F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("n")).limit(0)
    if low == high:
        high = low + 1.0
    step = F.least(F.floor((F.col(c).cast("double") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def any_of_group(columns: Sequence[str]) -> list[Column]:
    """Attributes that are constant inside the group."""
    return [F.any_value(c).alias(c) for c in columns]


def list_mean(c: str | Column) -> Column:
    """Mean of an array column; null for an empty one."""
    c = F.col(c) if isinstance(c, str) else c
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(c) > 0, total / F.size(c))


def conditional_total(value: Column, condition: Column) -> Column:
    """Sum over the rows that meet the condition; 0, not null, where none does."""
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))
