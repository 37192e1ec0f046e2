"""Category codes, fitted on the training part (or on all rows) and applied everywhere."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timetab.operators.joins import TASK_ROWS, salted_join
from timetab.operators.ordering import global_position
from timetab.operators.profiling import value_counts
from timetab.session import BROADCAST_BYTES, materialise


@dataclass(frozen=True)
class FrequentCodes:
    """Frequent categories per column in sorted order, and whether rarer ones exist."""

    frequent: dict[str, list[str]]
    has_rare: dict[str, bool]

    def size(self, c: str) -> int:
        return len(self.frequent[c]) + int(self.has_rare[c])

    def code(self, c: str, missing: str = "null") -> Column:
        """0..k-1 for frequent values, k for all others; null stays null, or takes the next free code ("own")."""
        k = len(self.frequent[c])
        text = F.col(c).cast("string")
        known = F.lit(None).cast("int")
        if k:
            table = F.create_map(*[F.lit(x) for i, v in enumerate(self.frequent[c]) for x in (v, i)])
            known = F.try_element_at(table, text)
        code = F.coalesce(known, F.lit(k))
        empty = F.lit(self.size(c)) if missing == "own" else F.lit(None)
        return F.when(F.col(c).isNull(), empty).otherwise(code).cast("bigint")


def _ordered(df: DataFrame, c: str, values: list[str]) -> list[str]:
    numeric = isinstance(df.schema[c].dataType, T.NumericType)
    return sorted(values, key=float) if numeric else sorted(values, key=lambda v: v.encode())


def fit_frequent(df: DataFrame, columns: Sequence[str], min_share: float = 0.01) -> FrequentCodes:
    """Values with at least ``min_share`` of all rows (missing ones included) keep a code, the rest share one.

    All columns are counted in one pass, and at most 1/min_share values per column reach the driver.
    """
    often = F.col("n") >= F.lit(min_share * df.count())
    rows = value_counts(df, columns).where(F.col("value").isNotNull()).groupBy("column").agg(
        F.collect_list(F.when(often, F.col("value"))).alias("frequent"), F.bool_or(~often).alias("has_rare")
    ).collect()
    kept = {r["column"]: r for r in rows}
    return FrequentCodes(
        {c: _ordered(df, c, list(kept[c]["frequent"])) if c in kept else [] for c in columns},
        {c: c in kept and kept[c]["has_rare"] for c in columns},
    )


def encode_frequent(df: DataFrame, codes: FrequentCodes, missing: str = "null") -> DataFrame:
    return df.withColumns({c: codes.code(c, missing) for c in codes.frequent})


@dataclass(frozen=True)
class Vocabulary:
    """All categories seen in training as a (column, value, code, n) table, their number and their bytes per column."""

    table: DataFrame
    sizes: dict[str, int]
    bytes: dict[str, int]


def fit_vocabulary(train: DataFrame, columns: Sequence[str]) -> Vocabulary:
    """Codes 0.. per column in sorted order of its distinct training values, however many there are.

    The places come from one range shuffle over the distinct values; only two numbers per column reach the driver.
    """
    numeric = [c for c in columns if isinstance(train.schema[c].dataType, T.NumericType)]
    distinct = value_counts(train, columns).where(F.col("value").isNotNull()).select(
        "column", F.when(F.col("column").isin(numeric), F.col("value").try_cast("double")).otherwise(F.lit(0.0)).alias("number"),
        "value", "n",
    )
    placed = global_position(distinct, ["column", "number", "value"], "place")
    firsts = {r["column"]: (r["first"], r["size"], r["bytes"]) for r in placed.groupBy("column").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("size"), F.sum(F.octet_length("value") + 16).alias("bytes")
    ).collect()}
    first = F.lit(0)
    for c, (start, _, _) in firsts.items():
        first = F.when(F.col("column") == c, F.lit(start)).otherwise(first)
    table = placed.select("column", "value", (F.col("place") - first).cast("bigint").alias("code"), "n")
    sizes, widths = ({c: firsts.get(c, (0, 0, 0))[i] for c in columns} for i in (1, 2))
    return Vocabulary(table, sizes, widths)


def encode_vocabulary(
    df: DataFrame, vocabulary: Vocabulary, suffix: str = "", limit: int = BROADCAST_BYTES, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Replace categories by their code (or add ``<column><suffix>``); unseen and missing ones get the next free code.

    Columns whose codes fit ``limit`` together, the smallest first, are looked up in one packed dictionary, without a join or
    shuffle. The others meet their codes in one long join, however many they are. Which values are hot is known from
    the counts of the training rows, so the rows are not read again to find out.
    """
    packed, room = [], limit
    for c in sorted(vocabulary.sizes, key=lambda c: vocabulary.bytes[c]):
        if vocabulary.bytes[c] <= room:
            packed.append(c)
            room -= vocabulary.bytes[c]
    long = [c for c in vocabulary.sizes if c not in packed]
    out = df
    if packed:
        out = out.withColumn("_codes", _packed_codes(vocabulary, packed)(*[F.col(c).cast("string") for c in packed]))
    if long:
        out = _long_codes(out, vocabulary, long, task_rows)
    codes = {c: F.col("_codes")[c] for c in packed} | {c: F.col("_long")[c] for c in long}
    return out.withColumns({c + suffix: F.coalesce(codes[c], F.lit(size).cast("bigint")) for c, size in vocabulary.sizes.items()}).drop("_codes", "_long")


def _packed_codes(vocabulary: Vocabulary, columns: list[str]):
    """A function from the columns' texts to a struct of their codes; its dictionary was measured against the limit."""
    rows = vocabulary.table.where(F.col("column").isin(columns)).select("column", "value", "code").toArrow().to_pandas()
    known = {c: own.sort_values("code")["value"].tolist() for c, own in rows.groupby("column")}
    shared = vocabulary.table.sparkSession.sparkContext.broadcast({c: known.get(c, []) for c in columns})

    def look_up(*texts: pa.Array) -> pa.Array:
        # Codes are places in the sorted values.
        found = [pc.index_in(t.cast(pa.string()), value_set=pa.array(shared.value[c], pa.string())) for c, t in zip(columns, texts)]
        return pa.StructArray.from_arrays([x.cast(pa.int64()) for x in found], names=columns)

    return F.arrow_udf(look_up, T.StructType([T.StructField(c, T.LongType()) for c in columns]))


def _long_codes(df: DataFrame, vocabulary: Vocabulary, columns: list[str], task_rows: int) -> DataFrame:
    """``df`` with a struct ``_long`` of the columns' codes: one join of (column, text) pairs, then one back to the rows."""
    rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    pairs = F.array(*[F.struct(F.lit(i).alias("_nth"), F.col(c).cast("string").alias("_text")) for i, c in enumerate(columns)])
    long = rows.select("_row", F.explode(pairs).alias("_pair")).select("_row", "_pair.*").where(F.col("_text").isNotNull())
    number = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    known = vocabulary.table.where(F.col("column").isin(columns)).select(
        F.to_json(F.struct(number[F.col("column")].alias("n"), F.col("value").alias("t"))).alias("_key"), F.col("code").alias("_code"), "n"
    )
    keyed = long.select("_row", "_nth", F.to_json(F.struct(F.col("_nth").alias("n"), F.col("_text").alias("t"))).alias("_key"))
    hot = known.where(F.col("n") > task_rows).select("_key", F.ceil(F.col("n") / F.lit(task_rows)).cast("int").alias("_salts"))
    found = salted_join(keyed, known.drop("n"), ["_key"], hot=hot).groupBy("_row").agg(
        F.struct(*[F.max(F.when(F.col("_nth") == i, F.col("_code"))).alias(c) for i, c in enumerate(columns)]).alias("_long")
    )
    return rows.join(found, "_row", "left").drop("_row")


def dense_codes(df: DataFrame, columns: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Dense rank minus one of each value inside its column; null stays null."""
    out = encode_vocabulary(df, fit_vocabulary(df, columns), suffix)
    return out.withColumns({c + suffix: F.when(F.col(c).isNotNull(), F.col(c + suffix)) for c in columns})


def one_hot(code: str | Column, size: int) -> Column:
    """Array of ``size`` zeros with a one at the code; a code past the end (unseen) gives zeros only, size 0 no entries."""
    c = F.col(code) if isinstance(code, str) else code
    if size == 0:
        return F.array().cast("array<float>")
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == c).cast("float"))
