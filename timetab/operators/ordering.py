"""Positions, prefix sums and order statistics over a whole table, without a one-partition window.

The order columns must be without nulls. Where a position has to be unique (``global_position``), they must
also be unique together: append the row id.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timetab.operators.joins import null_safe_join
from timetab.session import materialise, store_bucketed

LEAF_ROWS = 250_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number inside its partition in the low 33 bits
HASH_DIGITS = 15
HASH_RANGE = 16**HASH_DIGITS
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def hash_order(seed: Any, *keys: str | Column) -> Column:
    """A seeded pseudo-random whole number per row: the first 15 hex digits of md5(seed|key|…).

    Sorting by it shuffles the rows the same way on every run, every layout and every engine that has md5.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("long")


def _offsets(per_part: list, names: Sequence[str]) -> list[tuple]:
    """Exclusive running totals over the range partitions; one row per partition."""
    per_part = sorted(per_part, key=lambda r: r["pid"])
    totals = {n: [0, *itertools.accumulate(r[n] for r in per_part)] for n in names}
    return [(r["pid"], *[totals[n][i] for n in names]) for i, r in enumerate(per_part)]


def global_position(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Add the 0-based place of every row in the sorted table.

    One range shuffle on the full key, so a value of the first column that holds a third of the rows is still
    spread by the next column. The sorted table is written once; only the row count per partition reaches the driver.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("pid", F.spark_partition_id())
        .withColumn("mid", F.monotonically_increasing_id())
    )
    table = materialise(placed, "sorted")
    counts = table.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect()
    starts = df.sparkSession.createDataFrame(_offsets(counts, ["n"]), "pid int, start long")
    within = F.col("mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        table.join(F.broadcast(starts), "pid")
        .withColumn(name, F.col("start") + within)
        .select(*df.columns, name)
    )


def prefix_totals(
    df: DataFrame, order: Sequence[str], totals: dict[str, str], within: Sequence[str] = ()
) -> DataFrame:
    """Add, per entry of ``totals`` (new name -> column), the sum of that column over all rows before this one.

    ``order`` must be unique: pre-aggregate first, which also takes the weight off hot keys. ``within`` names leading
    order columns; sums then start anew in each of their groups (nulls are a group), and ``<new name>_total`` is the sum of the group.
    """
    within, rest = list(within), list(order)[len(within) :]
    if list(order)[: len(within)] != within:
        raise ValueError("the groups must lead the order")
    # Bucketed by range, so that the running sums below need no further shuffle.
    table = store_bucketed(df.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "pid")
    kinds = {n: "double" if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else "long"
             for n, c in totals.items()}
    # One row per range partition, and per group that begins in it.
    sums = table.groupBy("pid", *within).agg(*[F.sum(c).cast(kinds[n]).alias(n) for n, c in totals.items()])
    if within:
        earlier = Window.partitionBy(*within).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select(
            "pid", *within,
            *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).cast(kinds[n]).alias(f"start_{n}") for n in totals],
            *[F.sum(n).over(Window.partitionBy(*within)).alias(f"{n}_total") for n in totals],
        )
        placed = null_safe_join(table, starts, ["pid", *within])
    else:
        schema = "pid int, " + ", ".join(f"`start_{n}` {kinds[n]}" for n in totals)
        placed = table.join(
            F.broadcast(df.sparkSession.createDataFrame(_offsets(sums.collect(), list(totals)), schema)), "pid"
        )
    before = Window.partitionBy("pid", *within).orderBy(*rest).rowsBetween(Window.unboundedPreceding, -1)
    running = {
        n: (F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"start_{n}")).cast(kinds[n]) for n, c in totals.items()
    }
    extra = [f"{n}_total" for n in totals] if within else []
    return placed.withColumns(running).select(*df.columns, *totals, *extra)


def _as_number(kind: T.DataType, c: Column) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, _WHOLE):
        return c.cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.cast("double")
    raise TypeError(f"cannot order by {kind.simpleString()}: hash it or take its code first")


def _literal(kind: T.DataType, value: Any) -> str:
    """SQL text of a typed literal; it is folded to a constant, so comparisons with a column push down."""
    text = value.isoformat(sep=" ") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else str(value)
    return f"CAST('{text}' AS {kind.simpleString()})"


def _number(value: int | float) -> str:
    return f"CAST('{value!r}' AS {'BIGINT' if isinstance(value, int) else 'DOUBLE'})"


@dataclass(frozen=True)
class Cutoff:
    """The order key that stands at one position of the sorted table; ``values`` is None past the last row."""

    order: tuple[str, ...]
    kinds: tuple[T.DataType, ...]
    values: tuple | None

    def renamed(self, names: dict[str, str]) -> Cutoff:
        """The same key under other column names."""
        return Cutoff(tuple(names.get(c, c) for c in self.order), self.kinds, self.values)

    def condition(self) -> str:
        """SQL text that is true for rows at or after this key, in column order."""
        if self.values is None:
            return "false"
        out = ""
        for name, kind, value in reversed(list(zip(self.order, self.kinds, self.values))):
            v = _literal(kind, value)
            out = f"(`{name}` > {v} OR (`{name}` = {v} AND {out}))" if out else f"`{name}` >= {v}"
        return out

    def reached(self) -> Column:
        return F.expr(self.condition())


@dataclass(frozen=True)
class _Bracket:
    """Rows that agree on ``fixed`` leading key numbers and lie in [low, high] of the next one."""

    fixed: tuple
    low: Any
    high: Any
    before: int
    rows: int = field(compare=False)

    def holds(self) -> str:
        same = [f"k{i} = {_number(v)}" for i, v in enumerate(self.fixed)]
        return " AND ".join([*same, f"k{len(self.fixed)} BETWEEN {_number(self.low)} AND {_number(self.high)}"])

    def step(self, steps: int) -> str:
        """Which of ``steps`` equal steps between low and high a row lies in."""
        k = f"k{len(self.fixed)}"
        if self.high == self.low:
            return "0"
        if isinstance(self.low, int) and self.high - self.low < 1 << 62:
            share = f"double({k} - {_number(self.low)}) / {_number(float(self.high - self.low + 1))}"
        else:
            share = f"(double({k}) - {_number(float(self.low))}) / {_number(float(self.high) - float(self.low))}"
        return f"least(int(floor({share} * {steps})), {steps - 1})"


def _first_that_holds(brackets: list[_Bracket], result: Callable[[int, _Bracket], str]) -> Column:
    cases = " ".join(f"WHEN {b.holds()} THEN {result(i, b)}" for i, b in enumerate(brackets))
    return F.expr(f"CASE {cases} END")


def order_cutoffs(
    df: DataFrame,
    order: Sequence[str],
    positions: Sequence[int] | Callable[[int], Sequence[int]],
    *,
    leaf_rows: int = LEAF_ROWS,
    steps: int = 16_384,
    known: tuple[int, int, int] | None = None,
) -> list[Cutoff]:
    """Exact order keys at the given 0-based positions, by narrowing scans instead of a sort.

    ``positions`` may be a function of the number of rows, which is counted anyway. ``known`` gives bounds of the first
    key and the number of rows where the caller has them, and saves that first scan.

    Each round counts the rows of the still-open brackets in ``steps`` equal steps (a map-side aggregate with at most
    ``steps`` rows per bracket) and keeps the step that holds the position. A single hot value is one step, and the
    search goes on in the next key column. What is left, at most ``leaf_rows`` rows, is ranked.
    """
    kinds = tuple(df.schema[c].dataType for c in order)
    named = [f"k{i}" for i in range(len(order))]
    keyed = df.select(*order, *[_as_number(k, F.col(c)).alias(n) for n, k, c in zip(named, kinds, order)])
    if known is None:
        real = [F.isnan(k) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(False) for k, kind in zip(named, kinds)]
        first = keyed.agg(
            F.count(F.lit(1)), F.min("k0"), F.max("k0"), *[F.count(F.when(~nan, F.col(k))) for k, nan in zip(named, real)]
        ).first()
        total, low, high = first[0], first[1], first[2]
        if any(n != total for n in first[3:]):
            raise ValueError(f"null or NaN in order columns {list(order)}")
    else:
        low, high, total = known
    if callable(positions):
        positions = positions(total)
    found: dict[int, tuple | None] = {p: None for p in positions if p >= total}
    open_: dict[int, _Bracket] = {p: _Bracket((), low, high, 0, total) for p in set(positions) if p < total}
    last = len(order) - 1

    def settled(b: _Bracket) -> bool:
        return b.rows <= leaf_rows or (len(b.fixed) == last and b.low == b.high)

    while any(not settled(b) for b in open_.values()):
        wide = list({b for b in open_.values() if not settled(b)})
        place = _first_that_holds(wide, lambda i, b: f"struct({i} AS b, {b.step(steps)} AS i)")
        stats = [f(k).alias(f"{side}{j}") for j, k in enumerate(named) for side, f in (("lo", F.min), ("hi", F.max))]
        counted = (
            keyed.withColumn("place", place).where(F.col("place").isNotNull())
            .groupBy("place").agg(F.count(F.lit(1)).alias("n"), *stats).collect()
        )
        for p, b in list(open_.items()):
            if settled(b):
                continue
            passed, at = b.before, wide.index(b)
            for s in sorted((s for s in counted if s["place"]["b"] == at), key=lambda s: s["place"]["i"]):
                if passed + s["n"] > p:
                    break
                passed += s["n"]
            depth = len(b.fixed)
            low, high = s[f"lo{depth}"], s[f"hi{depth}"]
            if low == high and depth < last:
                open_[p] = _Bracket((*b.fixed, low), s[f"lo{depth + 1}"], s[f"hi{depth + 1}"], passed, s["n"])
            else:
                open_[p] = _Bracket(b.fixed, low, high, passed, s["n"])

    leaves = list(set(open_.values()))
    if leaves:
        # A leaf larger than leaf_rows is one repeated key: grouping leaves a single row of it.
        inside = (
            keyed.withColumn("leaf", _first_that_holds(leaves, lambda i, b: str(i))).where(F.col("leaf").isNotNull())
            .groupBy("leaf", *order, *named).agg(F.count(F.lit(1)).alias("n"))
        )
        upto = Window.partitionBy("leaf").orderBy(*named).rowsBetween(Window.unboundedPreceding, 0)
        wanted = [(leaves.index(b), p - b.before, p) for p, b in open_.items()]
        hit = " OR ".join(f"(leaf = {i} AND upto > {at} AND upto - n <= {at})" for i, at, _ in wanted)
        rows = inside.withColumn("upto", F.sum("n").over(upto)).where(hit).collect()
        for i, at, p in wanted:
            row = next(r for r in rows if r["leaf"] == i and r["upto"] - r["n"] <= at < r["upto"])
            found[p] = tuple(row[c] for c in order)
    return [Cutoff(tuple(order), kinds, found[p]) for p in positions]


def newest_share(df: DataFrame, time: str, parts: int = 5, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Rows of the newest 1/parts of the table, ties at the border kept."""
    cut = order_cutoffs(df.select(time), [time], lambda n: [n // parts * (parts - 1)], leaf_rows=leaf_rows)[0]
    return df.where(cut.reached())


def time_folds(df: DataFrame, time: str, folds: int = 9, name: str = "fold", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Number the rows 0..folds-1 by time quantile; fold i holds low < t <= high, the oldest rows are in fold 0."""

    def last_rows(n: int) -> list[int]:
        step = -(-n // folds)
        return [min(n - 1, step * (i + 1)) for i in range(folds)]

    cuts = order_cutoffs(df.select(time), [time], last_rows, leaf_rows=leaf_rows)
    kind = df.schema[time].dataType
    cases = " ".join(f"WHEN `{time}` <= {_literal(kind, c.values[0])} THEN {i}" for i, c in enumerate(cuts[:-1]))
    return df.withColumn(name, F.expr(f"CASE {cases} ELSE {folds - 1} END"))


def nth_smallest(df: DataFrame, group: Sequence[str], value: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """The row with the n-th smallest value per group (1-based); Spark limits each group to n rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(value, *tie))
    return df.withColumn("rn", rank).where(F.col("rn") <= n).where(F.col("rn") == n).drop("rn")


def preview(df: DataFrame, order: Sequence[str], rows: int = 20) -> DataFrame:
    return df.orderBy(*order).limit(rows)
