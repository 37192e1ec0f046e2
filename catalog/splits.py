"""Date, month, sliding-window and random splits, their spans and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import query, table
from timetab.operators.joins import gather
from timetab.operators.splits import (
    all_splits, overlaps, part_by_bounds, split_by_dates, split_by_months, split_random, split_sliding, split_spans,
)
from timetab.plans.dataset import part_sizes


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts")


@query("""
    SELECT o_orderkey AS row_id, 'default' AS split,
           CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'val'
                ELSE 'test' END AS part
    FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'
""")
def split_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train before 1999, validation 1999, test 2000; later orders belong to no part."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    bounds = [F.lit(d).cast("date") for d in ("1999-01-01", "2000-01-01", "2001-01-01")]
    return split_by_dates(orders, "o_orderkey", "d", *bounds)


@query("""
    SELECT o_orderkey AS row_id, 'default' AS split,
           CASE WHEN year(o_orderdate) = 2000 AND month(o_orderdate) IN (4, 5, 6) THEN 'val'
                WHEN year(o_orderdate) = 2000 AND month(o_orderdate) IN (7, 8, 9) THEN 'test'
                WHEN o_orderdate < TIMESTAMP '2000-04-01' THEN 'train' END AS part
    FROM orders WHERE o_orderdate < TIMESTAMP '2000-10-01'
""")
def split_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation and test by year and months, train before the first validation row."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return split_by_months(orders, "o_orderkey", "o_orderdate", (2000, [4, 5, 6]), (2000, [7, 8, 9]))


def _sliding_sql(table_: str, id_: str, time: str) -> str:
    return f"""
        pos AS (SELECT {id_} AS id, row_number() OVER (ORDER BY {time}, {id_}) - 1 AS p, count(*) OVER () AS n FROM {table_}),
        win AS (
            SELECT id, i, p - i * (n // 10) AS q, n - 4 * (n // 10) AS train, n // 10 AS v FROM pos, range(3) r(i)
        ),
        sliding AS (
            SELECT id AS row_id, 'sliding-window-' || i AS split,
                   CASE WHEN q < train THEN 'train' WHEN q < train + v THEN 'val' ELSE 'test' END AS part
            FROM win WHERE q >= 0 AND q < train + 2 * v
        ),
        shuffled AS (
            SELECT *, row_number() OVER (PARTITION BY i ORDER BY substr(md5('0|' || i || '|' || id), 1, 15), id) - 1 AS r
            FROM win WHERE q >= 0 AND q < train + 2 * v
        ),
        twin AS (
            SELECT id AS row_id, 'random-' || i AS split,
                   CASE WHEN r < train THEN 'train' WHEN r < train + v THEN 'val' ELSE 'test' END AS part
            FROM shuffled
        )
    """


_EVENT_WINDOWS = _sliding_sql("events", "event_id", "ts")


@query(f"WITH {_EVENT_WINDOWS} SELECT * FROM sliding")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three windows over the events in time order, validation and test a tenth of the rows each."""
    events = _events(spark, sf_dir)
    return split_sliding(events, "event_id", "ts", 0.1)


@query(f"WITH {_EVENT_WINDOWS} SELECT * FROM twin")
def random_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows with their rows shuffled."""
    events = _events(spark, sf_dir)
    return split_random(events, "event_id", "ts", 0.1)


@query(f"""
    WITH {_sliding_sql("orders", "o_orderkey", "o_orderdate")}, every AS (
        SELECT * FROM sliding UNION ALL SELECT * FROM twin UNION ALL
        SELECT o_orderkey, 'default', CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train'
               WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'val' ELSE 'test' END FROM orders
    )
    SELECT split, part, count(*) AS n_rows, min(row_id) AS first_id, max(row_id) AS last_id, sum(row_id)::BIGINT AS id_sum
    FROM every GROUP BY split, part
""")
def seven_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven splits of the orders, where many rows share a date, summed up per part."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    bounds = [F.lit(d).cast("timestamp_ntz") for d in ("1999-01-01", "2000-01-01")]
    splits = all_splits(orders, "o_orderkey", "o_orderdate", 0.1, part_by_bounds("o_orderdate", *bounds))
    return splits.groupBy("split", "part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"),
        F.sum("row_id").alias("id_sum"),
    )


@query(f"""
    WITH {_EVENT_WINDOWS}
    SELECT split, part, count(*) AS n_rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start,
           strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "end", date_diff('day', min(ts)::DATE, max(ts)::DATE) AS days
    FROM sliding JOIN events ON row_id = event_id GROUP BY split, part
""")
def window_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time span and size of every part of every window."""
    events = _events(spark, sf_dir)
    spans = split_spans(events, split_sliding(events, "event_id", "ts", 0.1), "event_id", "ts")
    text = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")}
    return spans.withColumns(text | {"days": F.col("days").cast("bigint")})


@query(f"WITH {_EVENT_WINDOWS} SELECT split, part, count(*) AS n_rows FROM twin GROUP BY split, part")
def part_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per part of the random twins."""
    events = _events(spark, sf_dir)
    return part_sizes(split_random(events, "event_id", "ts", 0.1))


@query(f"""
    WITH {_EVENT_WINDOWS}
    SELECT 'any window' AS split, row_id, count(*) AS n_parts FROM sliding GROUP BY row_id HAVING count(*) > 1
""")
def window_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows used by more than one window, found by the overlap check with all windows taken as one split."""
    events = _events(spark, sf_dir)
    splits = split_sliding(events, "event_id", "ts", 0.1)
    return overlaps(splits.withColumn("split", F.lit("any window")))


@query(f"""
    WITH {_EVENT_WINDOWS}
    SELECT event_id AS row_id, round(value, 2) AS value, part FROM sliding JOIN events ON row_id = event_id
    WHERE split = 'sliding-window-1' AND part = 'val'
""")
def gather_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation rows of one window with their values."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    splits = split_sliding(events, "event_id", "ts", 0.1).where(F.col("split") == "sliding-window-1")
    rows = events.select(F.col("event_id").alias("row_id"), F.round("value", 2).alias("value"))
    return gather(rows, splits, "val")


@query("""
    SELECT o_orderkey AS row_id, 'default' AS split,
           CASE WHEN d < TIMESTAMP '1999-01-01' THEN 'train' WHEN d < TIMESTAMP '2000-01-01' THEN 'val' ELSE 'test' END AS part
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS d FROM orders) WHERE d IS NOT NULL
""")
def split_without_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a date, made for the purpose, belong to no part."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("d"))
    bounds = [F.lit(d).cast("timestamp_ntz") for d in ("1999-01-01", "2000-01-01")]
    return split_by_dates(orders, "o_orderkey", "d", *bounds)
