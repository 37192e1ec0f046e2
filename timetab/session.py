"""Where intermediate tables live, and how large a table is before it may be broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
BUCKET_BYTES = 256 * 1024 * 1024
MAX_BUCKETS = 100_000  # Spark's own limit
JOBS_AT_ONCE = 8
POOL = "timetab-side-by-side"
_LOCAL_FOLDERS: dict[str, str] = {}
_MADE: list[str] = []

_FIXED_WIDTH = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4,
    T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16,
}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster without it is an error,
    since a machine-local folder there would be lost with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="timetab-")
    return _LOCAL_FOLDERS[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/timetab/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Tables that operators store inside this scope are emptied at its end: use their results, or store them, before.

    Without it they stay in the shared folder until they are removed there.
    """
    before, _MADE[:] = list(_MADE), []
    try:
        yield
    finally:
        made, _MADE[:] = list(_MADE), before
        nothing = spark.createDataFrame([], "nothing int")
        for path in made:
            nothing.coalesce(1).write.mode("overwrite").parquet(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_bucketed(rows: DataFrame, key: str, size: int = 0) -> DataFrame:
    """Store a table in the shared folder, bucketed by ``key``: grouping it by the key, or joining on it, moves none of its rows.

    ``size``: its bytes, where they are known; a bucket then holds about ``BUCKET_BYTES`` at most.
    """
    spark = rows.sparkSession
    # At least the session's number of shuffle partitions: with fewer, Spark would shuffle the table in a join.
    buckets = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
    name = f"timetab_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, key).option("path", fresh_path(spark, "bucketed")).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018  resolves the files before the name goes
    spark.sql(f"DROP TABLE {name}")  # only the name: the files are external
    return table


def measured_bytes(df: DataFrame) -> int:
    """Data size from one aggregate: fixed widths times rows, plus the real length of strings and arrays."""
    fixed = 0
    parts = [F.lit(0).cast("double")]
    for field in df.schema.fields:
        kind, c = field.dataType, F.col(f"`{field.name}`")
        if type(kind) in _FIXED_WIDTH:
            fixed += _FIXED_WIDTH[type(kind)]
        elif isinstance(kind, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)).cast("double"))
            fixed += 8
        else:
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)).cast("double"))
    row = df.agg(F.count(F.lit(1)), F.sum(sum(parts[1:], parts[0]))).first()
    return int(row[0] * fixed + (row[1] or 0))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``(broadcast hint on df, True)`` when its measured size fits the limit, else ``(df, False)``."""
    if measured_bytes(df) <= limit:
        return F.broadcast(df), True
    return df, False


def side_by_side(spark: SparkSession, calls: Sequence[Callable[[], Any]], most: int = JOBS_AT_ONCE) -> list[Any]:
    """The results of ``calls`` in their order, at most ``most`` running at a time.

    Each runs in a thread with the caller's job properties, in one scheduler pool; with ``spark.scheduler.mode`` FAIR the jobs share the
    executors evenly, and otherwise a job takes what the ones before it leave free.
    """
    def pooled(call: Callable[[], Any]) -> Any:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", POOL)
        return call()

    with ThreadPoolExecutor(max(1, min(most, len(calls)))) as threads:
        return [f.result() for f in [threads.submit(inheritable_thread_target(spark)(pooled), c) for c in calls]]
