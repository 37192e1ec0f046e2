"""One-pass column profile and the column decisions that follow from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unpivot_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long (column, value) table of the given columns, values as text."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("e")).select("e.column", "e.value")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, value) for all columns at once; counted map-side, so a hot value costs one row per task."""
    return unpivot_text(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _typed(df: DataFrame, c: str) -> dict[str, str]:
    """The slot that a column's values are counted in: numbers and times keep a fixed width, the rest is text."""
    kind = df.schema[c].dataType
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return {"whole": "bigint"}
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return {"real": "double"}
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return {"time": "timestamp_ntz"}
    return {"text": "string"}


_SLOTS = {"whole": "bigint", "real": "double", "time": "timestamp_ntz", "text": "string"}


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Per column: rows, nulls, null share, distinct values without and with null.

    Exact distinct counts come from one scan and one long aggregate over all columns, rather than one Expand branch of the
    full row per column: each value takes the slot of its type, and the other slots are null.
    """
    columns = list(columns or df.columns)
    pairs = []
    for i, c in enumerate(columns):
        own = _typed(df, c)
        pairs.append(F.struct(F.lit(i).alias("c"), *[
            (F.col(c) if name in own else F.lit(None)).cast(kind).alias(name) for name, kind in _SLOTS.items()
        ]))
    long = df.select(F.explode(F.array(*pairs)).alias("e")).select("e.*")
    used = [s for s in _SLOTS if any(s in _typed(df, c) for c in columns)]
    known = F.coalesce(*[F.when(F.col(s).isNotNull(), True) for s in used], F.lit(False))
    if exact:
        counts = long.groupBy("c", *used).agg(F.count(F.lit(1)).alias("n"))
        base = counts.groupBy("c").agg(
            F.sum("n").alias("n_rows"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_null"), F.count_if(known).alias("n_distinct"),
        )
    else:
        base = long.groupBy("c").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_if(~known).alias("n_null"),
            F.approx_count_distinct(F.when(known, F.xxhash64(*used))).alias("n_distinct"),
        )
    label = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("c") + 1)
    return base.select(label.alias("column"), "n_rows", "n_null", "n_distinct").withColumns({
        "null_share": F.col("n_null") / F.col("n_rows"),
        "n_distinct_with_null": F.col("n_distinct") + (F.col("n_null") > 0).cast("bigint"),
    })


FEW_VALUES = 1000


def profile_of_few(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The profile for decisions about columns with few values: exact where there are few, estimated where there are many.

    One scan estimates all columns. Only those estimated at no more than ``FEW_VALUES`` are counted exactly, so values of
    near-unique columns are never shuffled. The estimate of a column with fewer than a hundred values is far below the border.
    """
    rough = profile(df, columns, exact=False).collect()
    few = [r["column"] for r in rough if r["n_distinct"] <= FEW_VALUES]
    many = [r for r in rough if r["n_distinct"] > FEW_VALUES]
    schema = "column string, n_rows long, n_null long, n_distinct long, null_share double, n_distinct_with_null long"
    rest = df.sparkSession.createDataFrame([tuple(r) for r in many], schema)
    return profile(df, few).unionByName(rest) if few else rest


def ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """Smallest and largest value per column from a single aggregate."""
    row = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns}


def all_null_columns(stats: DataFrame) -> list[str]:
    return [r["column"] for r in stats.where(F.col("n_null") == F.col("n_rows")).select("column").collect()]


def two_valued_columns(stats: DataFrame) -> list[str]:
    """Columns with exactly two values, null counting as one."""
    return [r["column"] for r in stats.where(F.col("n_distinct_with_null") == 2).select("column").collect()]


def uninformative(stats: DataFrame, text: Sequence[str], null_share: float = 0.95, text_values: int = 50) -> DataFrame:
    """The profile with a verdict per column: mostly null, one value only, or text with too many values."""
    drop = (
        (F.col("null_share") > null_share) | (F.col("n_distinct") == 1)
        | (F.col("column").isin(list(text)) & (F.col("n_distinct") > text_values))
    )
    return stats.withColumn("drop", drop)


def drop_uninformative(df: DataFrame, null_share: float = 0.95, text_values: int = 50) -> DataFrame:
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if text_values * 2 > FEW_VALUES:
        raise ValueError(f"text_values must not be above {FEW_VALUES // 2}")
    verdict = uninformative(profile_of_few(df), text, null_share, text_values)
    return df.drop(*[r["column"] for r in verdict.where("drop").select("column").collect()])


# Whole-number types from narrow to wide with the bounds a range must stay strictly inside.
WHOLE_TYPES = [
    ("tinyint", -(2**7), 2**7 - 1),
    ("smallint", -(2**15), 2**15 - 1),
    ("int", -(2**31), 2**31 - 1),
    ("bigint", -(2**63), 2**63 - 1),
]
FLOAT_TOP = 3.4028234663852886e38


def narrowed_types(df: DataFrame) -> dict[str, str]:
    """For each numeric column the smallest type that strictly holds its range; all-null columns keep theirs."""
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    real = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not whole and not real:
        return {}
    out = {}
    for c, (low, high) in ranges(df, whole + real).items():
        if low is None:
            continue
        if c in whole:
            fit = [name for name, bottom, top in WHOLE_TYPES if low > bottom and high < top]
            if fit:
                out[c] = fit[0]
        elif -FLOAT_TOP < low and high < FLOAT_TOP:
            out[c] = "float"
    return out


def narrow(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in narrowed_types(df).items()})
