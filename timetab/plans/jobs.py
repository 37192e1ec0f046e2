"""Whole dataset builds by the shape of the raw data: raw tables in; feature rows, roles and all seven splits out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timetab.functions.calendar import add_calendar, from_epoch_seconds
from timetab.functions.columns import Roles, log_target, mapped, pick, presence, sentinel_to_null
from timetab.operators.cleaning import at_least, drop_at_minimum
from timetab.operators.encoding import dense_codes, encode_frequent, fit_frequent
from timetab.operators.joins import lookup_join, update_join
from timetab.operators.profiling import profile_of_few
from timetab.operators.sampling import exact_sample
from timetab.operators.splits import all_splits, part_by_bounds
from timetab.plans.entity import entity_table
from timetab.plans.history import HORIZONS, history_features, purchase_flags
from timetab.session import materialise
from timetab.sources.bundles import save_bundle

# Calendar features by kind of time column, and the yes/no words of two-valued text columns.
DATE_PARTS = ["day_of_week", "day_of_month", "day_of_year"]
TIME_PARTS = ["day_of_week", "minute_of_day", "hour_of_day"]
YES_NO = {"N": 0, "Y": 1}


@dataclass(frozen=True)
class Timeline:
    """How rows are split: the time column, date bounds of the default split, and the window size (rows or share).

    ``part`` replaces the bounds by a column expression that names the part, or is null for rows outside all parts.
    """

    time: str
    val_from: Any = None
    test_from: Any = None
    end: Any = None
    window: int | float = 0.1
    windows: int = 3
    seed: int = 0
    part: Column | None = None

    def default(self, kind: T.DataType) -> Column:
        if self.part is not None:
            return self.part
        bounds = [None if b is None else F.lit(str(b)).cast(kind) for b in (self.val_from, self.test_from, self.end)]
        return part_by_bounds(self.time, *bounds)

    def splits(self, df: DataFrame, row_id: str) -> DataFrame:
        rows = df.select(row_id, self.time)
        return all_splits(
            rows, row_id, self.time, self.window, self.default(df.schema[self.time].dataType), self.windows, self.seed
        )


@dataclass(frozen=True)
class Build:
    rows: DataFrame
    roles: Roles
    splits: DataFrame
    row_id: str

    def save(self, path: str, name: str) -> None:
        save_bundle(self.rows, self.roles, self.splits, path, name, row_id=self.row_id)


def _finish(df: DataFrame, roles: Roles, timeline: Timeline, row_id: str) -> Build:
    """Store the finished rows once; the splits and every later use read that table."""
    columns = [row_id, timeline.time, *roles.features, *roles.meta, roles.target]
    rows = materialise(df.select(*dict.fromkeys(columns)), "build")
    return Build(rows, roles, timeline.splits(rows, row_id), row_id)


def _merge_rare(df: DataFrame, columns: Sequence[str], timeline: Timeline, fit_on: str, missing: str = "null") -> DataFrame:
    """Frequent-value codes, learned from the default training part or from all rows."""
    if not columns:
        return df
    kind = df.schema[timeline.time].dataType
    seen = df if fit_on == "all" else df.where(timeline.default(kind) == "train")
    return encode_frequent(df, fit_frequent(seen.select(*columns), columns), missing)


def event_log(
    df: DataFrame, row_id: str, target: str, timeline: Timeline, *, fraction: float = 0.025, least: float | None = 1.0,
    log: bool = True, skip: Sequence[str] = (), also_num: Sequence[str] = (), parts: Sequence[str] = tuple(TIME_PARTS),
    fit_on: str = "train",
) -> Build:
    """Rows of a service log, one per event: roles by the column prefixes num, cat and bin, an exact sample, log target."""
    if least is not None:
        df = at_least(df, target, least)
    cat = pick(df, prefix="cat", exclude=skip)
    coded = _merge_rare(df, cat, timeline, fit_on)
    picked = add_calendar(exact_sample(coded, fraction, row_id, timeline.seed), timeline.time, list(parts))
    picked = picked.withColumn("_y", log_target(target) if log else F.col(target))
    num = pick(picked, prefix="num", also=[*parts, *also_num], exclude=[*skip, target])
    roles = Roles(num=num, bin=pick(picked, prefix="bin", exclude=skip), cat=cat, meta=[timeline.time], target="_y")
    return _finish(picked, roles, timeline, row_id)


def sensor_log(
    df: DataFrame, row_id: str, epoch: str, target: str, timeline: Timeline, *, flag_word: str = "available",
    meta: Sequence[str] = (), fraction: float = 0.025,
) -> Build:
    """Measurements with a time in epoch seconds; columns with the flag word in their name are binary."""
    timed = exact_sample(df, fraction, row_id, timeline.seed).withColumn(timeline.time, from_epoch_seconds(epoch).cast("timestamp_ntz"))
    parts = ["day_of_week", "day_of_month", "minute_of_day", "hour_of_day", "month"]
    timed = add_calendar(timed, timeline.time, parts)
    outside = [row_id, epoch, target, timeline.time, *meta]
    flags = pick(timed, contains=flag_word, exclude=outside)
    num = [c for c in timed.columns if c not in outside and c not in flags]
    return _finish(timed, Roles(num=num, bin=flags, meta=[timeline.time, *meta], target=target), timeline, row_id)


def quotes(
    df: DataFrame, row_id: str, target: str, timeline: Timeline, *, ordinal: tuple[str, ...] = ("A", "B"), fit_on: str = "train",
) -> Build:
    """A wide table of quotes: -1 in ordinal columns means missing, two-valued columns become flags, text becomes codes."""
    outside = [row_id, target, timeline.time]
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    df = df.withColumns({c: sentinel_to_null(c) for c in pick(df, suffix=ordinal, exclude=outside) if c in numeric})
    df = add_calendar(df, timeline.time, [*DATE_PARTS, "month"])
    stats = {r["column"]: r for r in profile_of_few(df, [c for c in df.columns if c not in outside]).collect()}
    live = [c for c, r in stats.items() if r["n_null"] < r["n_rows"]]
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    flags = [c for c in live if stats[c]["n_distinct_with_null"] == 2]
    as_flag = {
        c: presence(c) if stats[c]["n_null"] else mapped(c, YES_NO, strict=True).cast("float") if c in text else F.col(c).cast("float")
        for c in flags
    }
    cat = [c for c in df.columns if c in live and c in text and c not in flags]
    num = [c for c in df.columns if c in live and c not in text and c not in flags]
    coded = _merge_rare(df.withColumns(as_flag), cat, timeline, fit_on)
    bin_ = [c for c in df.columns if c in flags]
    return _finish(coded, Roles(num, bin_, cat, [timeline.time], target, "binclass"), timeline, row_id)


def property_sales(
    df: DataFrame, macro: DataFrame, fixes: DataFrame, row_id: str, timeline: Timeline, *, price: str, area: str, distance: str,
    keep: Column, cat: Sequence[str], fit_on: str = "train",
) -> Build:
    """Sales with a macro series by day and a fix table: rows at the smallest distance need a fix, log price per area."""
    fixed = update_join(drop_at_minimum(df, distance, fixes, row_id), fixes, row_id)
    joined = add_calendar(lookup_join(fixed.where(keep), macro, [timeline.time]), timeline.time, [*DATE_PARTS, "month", "year"])
    joined = materialise(joined.withColumn("_y", log_target(price, per=area)), "sales")
    outside = [row_id, timeline.time, price, "_y", *cat]
    stats = profile_of_few(joined, [c for c in joined.columns if c not in outside])
    flags = [r["column"] for r in stats.where(F.col("n_distinct_with_null") == 2).collect()]
    coded = _merge_rare(joined, cat, timeline, fit_on, missing="own")
    if flags:
        ranks = dense_codes(coded, flags, "_rank")
        coded = ranks.withColumns({c: F.col(f"{c}_rank").cast("float") for c in flags}).drop(*[f"{c}_rank" for c in flags])
    num = [c for c in joined.columns if c not in outside and c not in flags]
    return _finish(coded, Roles(num, flags, list(cat), [timeline.time], "_y"), timeline, row_id)


def offers(
    events: DataFrame, anchors: DataFrame, row_id: str, target: str, timeline: Timeline, *, date: str, quantity: str, amount: str,
    matches: dict[str, tuple[str, str]], combinations: Sequence[Sequence[str]], carry: Sequence[str] = (),
    horizons: Sequence[int] = tuple(HORIZONS), min_days: int | None = 0,
) -> Build:
    """One row per anchored entity with the features of its history, calendar parts of the anchor, and never/ever flags."""
    features = history_features(
        events, anchors, id_=row_id, date=date, anchor_date=timeline.time, matches=matches, quantity=quantity, amount=amount,
        carry=[*carry, target], horizons=horizons, min_days=min_days,
    )
    dated = add_calendar(features, timeline.time, DATE_PARTS)
    flagged = purchase_flags(dated, list(matches), combinations)
    bin_ = [c for c in flagged.columns if c not in dated.columns]
    num = [c for c in dated.columns if c not in (row_id, target, timeline.time)]
    return _finish(flagged, Roles(num=num, bin=bin_, meta=[timeline.time], target=target, task="binclass"), timeline, row_id)


def credit(
    base: DataFrame, static: Sequence[DataFrame], grouped: Sequence[tuple[DataFrame, Sequence[str]]], row_id: str, target: str,
    timeline: Timeline, *, bin_flags: dict[str, Column] | None = None, drop: Sequence[str] = (), fraction: float = 0.25,
    fit_on: str = "train",
) -> Build:
    """Entity tables joined to the base, dead columns dropped, text as codes, an exact sample, calendar parts.

    Fractions, truth values and counts are numeric features; other whole numbers and dates that are left over are none.
    """
    wide = entity_table(base, static, grouped, row_id, timeline.time).drop(*drop)
    outside = [row_id, target, timeline.time]
    wide = wide.withColumns({c: e.cast("float") for c, e in (bin_flags or {}).items()})
    flags = list(bin_flags or {})
    cat = [f.name for f in wide.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in [*outside, *flags]]
    coded = _merge_rare(wide, cat, timeline, fit_on)
    sampled = add_calendar(exact_sample(coded, fraction, row_id, timeline.seed), timeline.time, DATE_PARTS)
    fractions = {f.name for f in sampled.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.BooleanType))}
    num = [
        c for c in sampled.columns
        if c not in [*outside, *flags, *cat] and (c in fractions or c.startswith("n_unique_") or c in DATE_PARTS)
    ]
    roles = Roles(num=num, bin=flags, cat=cat, meta=[timeline.time], target=target, task="binclass")
    return _finish(sampled, roles, timeline, row_id)


def split_view(build: Build, split: str = "default") -> DataFrame:
    """Rows of one split by role, with their part: what a model is trained on."""
    rows = build.roles.select(build.rows, build.row_id)
    return rows.join(build.splits.where(F.col("split") == split).select("row_id", "part"), "row_id")
