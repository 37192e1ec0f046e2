"""Row filters and null handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timetab.operators.joins import lookup_join


def at_least(df: DataFrame, c: str, low: float) -> DataFrame:
    return df.where(F.col(c) >= low)


def plausible(size: str, price: str, *, min_size: float, bad_sizes: list, min_price: float, bad_prices: list) -> Column:
    """Sizes and prices above a floor and not one of the values known to be wrong."""
    return (
        (F.col(size) > min_size) & ~F.col(size).isin(bad_sizes)
        & (F.col(price) > min_price) & ~F.col(price).isin(bad_prices)
    )


def drop_at_minimum(df: DataFrame, c: str, fixes: DataFrame, on: str) -> DataFrame:
    """Drop rows whose ``c`` is the smallest of the table, unless their id will be fixed. A null ``c`` needs a fix too."""
    low = df.agg(F.min(c)).first()[0]
    known = fixes.select(on).distinct().withColumn("_known", F.lit(True))
    kept = lookup_join(df, known, [on], "left")
    return kept.where((F.col(c) != F.lit(low)) | F.col("_known")).drop("_known")
