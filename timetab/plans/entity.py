"""Entity tables: aggregate each raw table to one row per entity, join them, turn dates into days, drop dead columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timetab.functions.calendar import days_from, mean_days_from
from timetab.operators.aggregates import DATE_SUFFIX, entity_features
from timetab.operators.joins import chain_left_joins
from timetab.operators.profiling import drop_uninformative
from timetab.session import materialise


def dates_to_days(df: DataFrame, anchor: str) -> DataFrame:
    """Date columns (and mean dates) as whole days from the anchor; a std is a length already and stays."""
    out = {}
    for f in df.schema.fields:
        if f.name == anchor or not f.name.endswith(DATE_SUFFIX):
            continue
        if isinstance(f.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            out[f.name] = days_from(anchor, f.name)
        elif f.name.startswith("mean_"):
            out[f.name] = mean_days_from(anchor, f.name)
    return df.withColumns(out) if out else df


def entity_table(
    base: DataFrame, static: Sequence[DataFrame], grouped: Sequence[tuple[DataFrame, Sequence[str]]], key: str,
    anchor: str, drop_dead: bool = True,
) -> DataFrame:
    """``static`` tables have one row per entity, ``grouped`` ones many, with the columns that order them.

    The largest value of the first order column is a feature too.

    The joined table is written once, since both the profile and the result read it.
    """
    tables = [*static, *[entity_features(t, key, order, order[0] if order else None) for t, order in grouped]]
    joined = dates_to_days(chain_left_joins(base, tables, key), anchor)
    if not drop_dead:
        return joined
    return drop_uninformative(materialise(joined, "entities"))


def sex_flag(df: DataFrame, c: str, value: str) -> DataFrame:
    return df.withColumn(c, (F.col(c) == value).cast("float"))
