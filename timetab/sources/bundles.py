"""Dataset bundles: features by role, splits and task metadata in one folder."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timetab.functions.columns import Roles
from timetab.operators.splits import overlaps
from timetab.plans.metrics import DEFAULT_SCORE
from timetab.session import shared_folder


@dataclass(frozen=True)
class Task:
    name: str
    task_type: str
    score: str
    roles: Roles

    @property
    def is_regression(self) -> bool:
        return self.task_type == "regression"


def save_bundle(
    df: DataFrame, roles: Roles, splits: DataFrame, path: str, name: str, *, row_id: str = "row_id",
    score: str | None = None, preview_rows: int = 20,
) -> None:
    """Write features (roles cast), a short CSV preview, splits (one folder per split) and metadata.

    Labels must not be missing or NaN and no row may stand in two parts of one split; both are checked before anything
    is written.
    """
    rows = roles.select(df, row_id)
    spark = df.sparkSession
    if rows.where(F.col("y").isNull() | F.isnan(F.col("y").cast("double"))).limit(1).count():
        raise ValueError("missing labels")
    clash = overlaps(splits).limit(1).collect()
    if clash:
        raise ValueError(f"overlapping parts: {clash[0]}")
    rows.write.parquet(f"{path}/features")
    splits.select("row_id", "split", "part").write.partitionBy("split").parquet(f"{path}/splits")
    stored = spark.read.parquet(f"{path}/features")
    stored.orderBy("row_id").limit(preview_rows).write.option("header", True).csv(f"{path}/preview")
    if score is None and roles.task == "binclass":
        score = "roc-auc"
    info = {"name": name, "task_type": roles.task, "score": score, "roles": asdict(roles)}
    spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.text(f"{path}/info")


def load_task(spark: SparkSession, path: str) -> Task:
    """Task metadata; without a stored score it is accuracy for classification and RMSE for regression."""
    info = json.loads(spark.read.text(f"{path}/info").first()[0])
    score = info.get("score") or DEFAULT_SCORE[info["task_type"]]
    return Task(info["name"], info["task_type"], score, Roles(**info["roles"]))


def load_bundle(spark: SparkSession, path: str, split: str = "default") -> DataFrame:
    """Feature rows of one split with their part; only that split's folder is read."""
    features = spark.read.parquet(f"{path}/features")
    parts = spark.read.parquet(f"{path}/splits").where(F.col("split") == split).select("row_id", "part")
    return features.join(parts, "row_id")


def cached(spark: SparkSession, arguments: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored result for these arguments, or ``build()`` stored under their hash.

    The arguments are kept next to the data and compared, so two sets that share a hash are told apart.
    """
    text = json.dumps(arguments, sort_keys=True, default=str)
    path = f"{shared_folder(spark)}/timetab/cached-{hashlib.md5(text.encode()).hexdigest()}"
    try:  # the arguments are written last, so where they are, the data is whole
        stored = spark.read.text(f"{path}/arguments").first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    if stored is not None:
        if stored[0] != text:
            raise ValueError(f"different arguments share {path}")
        return spark.read.parquet(f"{path}/data")
    build().write.mode("overwrite").parquet(f"{path}/data")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/arguments")
    return spark.read.parquet(f"{path}/data")
