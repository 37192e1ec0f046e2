"""Readers for raw tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type both fit: wider integer, double for integer with float, text as the last resort."""
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if type(a) in _WHOLE and type(b) in _WHOLE:
        return a if _WHOLE.index(type(a)) >= _WHOLE.index(type(b)) else b
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    if {type(a), type(b)} == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    return T.StringType()


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables; columns are matched by name and widened to a common type, absent ones are null."""
    kinds: dict[str, T.DataType] = {}
    for t in tables:
        for f in t.schema.fields:
            kinds[f.name] = common_type(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    cast = [t.select(*[F.col(c).cast(kinds[c]).alias(c) for c in t.columns]) for t in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def read_tables(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Parquet scan of one path or glob, or of several whose column types may differ."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return union_tables([spark.read.parquet(p) for p in paths])


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, *, null: str = "NA", gzip: bool | None = None,
) -> DataFrame:
    """CSV scan with header and a null token, plain or gzip.

    Without a schema, each column gets the type that all its rows fit, which costs one more scan; text is the last resort. A
    row that does not fit the schema fails the read. A gzip file is one task by nature, so its rows are dealt out right
    after the scan: where the path ends in ``.gz``, or as ``gzip`` says for folders and globs.
    """
    reader = spark.read.option("header", True).option("nullValue", null).option("mode", "FAILFAST")
    df = reader.option("inferSchema", True).csv(path) if schema is None else reader.schema(schema).csv(path)
    if path.endswith(".gz") if gzip is None else gzip:
        df = df.repartition(max(spark.sparkContext.defaultParallelism, 2))
    return df
