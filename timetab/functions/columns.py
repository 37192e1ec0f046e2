"""Rules that find columns by name, roles with fixed types, and small cleaning expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column types a role is stored with.
ROLE_TYPES = {"num": "float", "bin": "float", "cat": "bigint", "meta": "bigint"}
TARGET_TYPES = {"regression": "float", "binclass": "bigint", "multiclass": "bigint"}


def pick(
    df: DataFrame, *, prefix: str | tuple = (), suffix: str | tuple = (), contains: str | None = None,
    also: Iterable[str] = (), exclude: Iterable[str] = (),
) -> list[str]:
    """Column names, in table order, that match any of the rules and are not excluded."""
    extra, out = set(also), set(exclude)
    return [
        c for c in df.columns
        if c not in out and (
            (bool(prefix) and c.startswith(prefix)) or (bool(suffix) and c.endswith(suffix))
            or (contains is not None and contains in c) or c in extra
        )
    ]


@dataclass(frozen=True)
class Roles:
    """Which columns are numeric, binary, categorical and meta features, and which one is the target."""

    num: Sequence[str] = ()
    bin: Sequence[str] = ()
    cat: Sequence[str] = ()
    meta: Sequence[str] = ()
    target: str | None = None
    task: str = field(default="regression")

    @property
    def features(self) -> list[str]:
        return [*self.num, *self.bin, *self.cat]

    def select(self, df: DataFrame, row_id: str = "row_id", cast_cat: bool = True) -> DataFrame:
        """Project to row id, roles and target with their stored types. Dates in meta become epoch microseconds."""
        kinds = df.schema

        def stored(role: str, c: str) -> Column:
            if role == "cat" and not cast_cat:
                return F.col(c)
            if role == "meta" and isinstance(kinds[c].dataType, (T.TimestampType, T.TimestampNTZType)):
                return F.unix_micros(F.col(c).cast("timestamp")).alias(c)
            if role == "meta" and isinstance(kinds[c].dataType, T.DateType):
                return F.unix_date(c).cast("bigint").alias(c)
            return F.col(c).cast(ROLE_TYPES[role]).alias(c)

        columns = [stored(role, c) for role in ROLE_TYPES for c in getattr(self, role)]
        if self.target is not None:
            columns.append(F.col(self.target).cast(TARGET_TYPES[self.task]).alias("y"))
        return df.select(F.col(row_id).cast("bigint").alias("row_id"), *columns)


def cast_by_name(df: DataFrame, ids: Sequence[str], dates: Callable[[str], bool]) -> DataFrame:
    """Ids to bigint, columns the date rule accepts to date; values that do not parse become null."""
    wanted = {c: F.col(c).try_cast("bigint") for c in df.columns if c in ids}
    wanted |= {c: F.col(c).try_cast("date") for c in df.columns if c not in ids and dates(c)}
    return df.withColumns(wanted) if wanted else df


def sentinel_to_null(c: str, sentinel: int = -1) -> Column:
    return F.nullif(F.col(c), F.lit(sentinel))


def mapped(c: str, values: dict, strict: bool = False) -> Column:
    """Replace each key of ``values`` by its value; any other input becomes null, or with ``strict`` is an error."""
    out = None
    for k, v in values.items():
        out = F.when(F.col(c) == k, v) if out is None else out.when(F.col(c) == k, v)
    if strict:
        out = out.when(F.col(c).isNotNull(), F.raise_error(F.concat(F.lit(f"unknown value in {c}: "), F.col(c).cast("string"))).cast("int"))
    return out


def presence(c: str) -> Column:
    return F.col(c).isNotNull().cast("float")


def decimal_comma(c: str, strict: bool = False) -> Column:
    """Parse a number whose first comma is a decimal comma; strict raises on junk, lenient gives null."""
    dotted = F.regexp_replace(F.col(c), "^([^,]*),", "$1.")
    return dotted.cast("float") if strict else dotted.try_cast("float")


def finite(c: str | Column) -> Column:
    """NaN and null to 0, infinities to the largest double of their sign."""
    c = F.col(c) if isinstance(c, str) else c
    top = F.lit(1.7976931348623157e308)
    known = F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.greatest(known, -top), top)


def log_target(value: str, per: str | None = None) -> Column:
    return F.log(F.col(value)) if per is None else F.log(F.col(value) / F.col(per))
