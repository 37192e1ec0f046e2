"""Run reports (nested JSON) and stored predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timetab.session import materialise

# The report fields that are read; the three logged variants have different subsets of them.
REPORT_SCHEMA = """
    function string, gpus array<string>, single_model_function string, prediction_type string, time double,
    config struct<seed: int, seeds: array<int>, data: struct<path: string, seed: int, split: string>>,
    metrics struct<
        train: struct<rmse: double, mae: double, r2: double, score: double>,
        val: struct<rmse: double, mae: double, r2: double, score: double>,
        test: struct<rmse: double, mae: double, r2: double, score: double>
    >
"""
REPORT_LAYOUT = r"([^/]+)/([^/]+)/([^/]+)/(\d+)/report\.json$"


def read_reports(spark: SparkSession, glob: str, layout: str = REPORT_LAYOUT) -> DataFrame:
    """One row per report: model, dataset, kind and seed from its path, scores from its body, missing numbers as 0.

    ``layout`` has four groups, in that order.
    """
    raw = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(glob)
    file = F.input_file_name()
    parts = {n: F.regexp_extract(file, layout, i + 1) for i, n in enumerate(("model", "dataset", "kind", "seed"))}
    zero = F.lit(0.0)
    return raw.select(
        parts["model"].alias("model"), parts["dataset"].alias("dataset"), parts["kind"].alias("kind"),
        F.coalesce(F.col("config.seed"), parts["seed"].try_cast("int")).alias("seed"),
        F.col("config.data.path").alias("path"),
        F.coalesce("metrics.train.score", zero).alias("train_score"),
        F.coalesce("metrics.val.score", zero).alias("val_score"),
        F.coalesce("metrics.test.score", zero).alias("score"),
        F.coalesce("time", zero).alias("time"),
    )


def flatten_reports(spark: SparkSession, glob: str) -> DataFrame:
    """``(file, path, value, number)`` of every leaf of any JSON report, one file each, without a schema.

    ``path`` joins the keys with dots, places of arrays are numbers; ``value`` is the leaf as text and ``number`` as a double, 0 where it is
    null. Empty objects and arrays have no leaf. Each level of nesting is one narrow step, and no file is read twice.
    """
    read = spark.read.option("wholetext", True).text(glob).select(
        F.input_file_name().alias("file"), F.lit("").alias("path"), F.parse_json("value").alias("v")
    )
    nested = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
    level, leaves = materialise(read, "reports"), None
    while True:
        flat = level.where(~nested).select(
            "file", "path", F.variant_get("v", "$", "string").alias("value"),
            F.coalesce(F.try_variant_get("v", "$", "double"), F.when(F.is_variant_null("v"), F.lit(0.0))).alias("number"),
        )
        leaves = flat if leaves is None else leaves.unionAll(flat)
        deeper = level.where(nested)
        if not deeper.limit(1).count():
            return leaves
        inner = deeper.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(
            F.coalesce("key", F.col("pos").cast("string")).alias("step"), F.col("value").alias("inner")))
        level = materialise(inner.select("file", F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), "step").alias("path"), F.col("inner").alias("v")), "reports")


PREDICTION_COLUMNS = ["model", "dataset", "split", "seed", "part", "row_id", "prediction"]


_RUN = {"dataset": "string", "model": "string", "split": "string", "seed": "int"}


def save_predictions(df: DataFrame, path: str) -> None:
    """Write runs to the predictions table, one folder per dataset, model, split and seed; a run that is there is replaced."""
    # Few files a run, and several tasks where a run is large.
    out = df.select(*PREDICTION_COLUMNS).hint("rebalance", *_RUN)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_RUN).parquet(path)


def load_predictions(spark: SparkSession, path: str, dataset: str | None = None, model: str | None = None) -> DataFrame:
    found = spark.read.parquet(path).schema
    # Folder names keep the type of the columns, also where all of them look like numbers.
    df = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType() if _RUN.get(f.name) == "string" else f.dataType) for f in found])).parquet(path)
    if dataset is not None:
        df = df.where(F.col("dataset") == dataset)
    if model is not None:
        df = df.where(F.col("model") == model)
    return df.select(*PREDICTION_COLUMNS)
