from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timetab.operators.splits import (
    all_splits, overlaps, part_by_bounds, split_by_dates, split_by_months, split_random, split_sliding, split_spans, window_sizes,
)


@pytest.fixture(scope="module")
def hundred(spark):
    """100 rows, two per minute, ids against the time order."""
    start = datetime(2024, 1, 1)
    rows = [(1000 - i, start + timedelta(minutes=i // 2)) for i in range(100)]
    return spark.createDataFrame(rows, "id long, t timestamp_ntz")


def place(df):
    rows = sorted((r["t"], r["id"]) for r in df.collect())
    return {id_: i for i, (_, id_) in enumerate(rows)}


def test_sliding_sizes(spark, hundred):
    """With 100 rows and validation of 10: train 60, window i shifted by 10 i."""
    at = place(hundred)
    got = {}
    for r in split_sliding(hundred, "id", "t", 10).collect():
        got.setdefault((r["split"], r["part"]), set()).add(at[r["row_id"]])
    for i in range(3):
        name = f"sliding-window-{i}"
        assert got[name, "train"] == set(range(10 * i, 10 * i + 60))
        assert got[name, "val"] == set(range(10 * i + 60, 10 * i + 70))
        assert got[name, "test"] == set(range(10 * i + 70, 10 * i + 80))


def test_random_twins(spark, hundred):
    slid, twin = split_sliding(hundred, "id", "t", 10), split_random(hundred, "id", "t", 10)
    for i in range(3):
        rows = {r["row_id"] for r in slid.where(f"split = 'sliding-window-{i}'").collect()}
        mixed = [(r["part"], r["row_id"]) for r in twin.where(f"split = 'random-{i}'").collect()]
        assert {id_ for _, id_ in mixed} == rows and len(mixed) == len(rows)
        assert [sum(p == part for p, _ in mixed) for part in ("train", "val", "test")] == [60, 10, 10]
    train = {r["row_id"] for r in twin.where("split = 'random-0' AND part = 'train'").collect()}
    assert train != {r["row_id"] for r in slid.where("split = 'sliding-window-0' AND part = 'train'").collect()}


def test_all_splits_are_disjoint(spark, hundred):
    default = part_by_bounds("t", *[F.lit(x).cast("timestamp_ntz") for x in ("2024-01-01 00:20", "2024-01-01 00:40")])
    splits = all_splits(hundred, "id", "t", 0.1, default)
    assert overlaps(splits).count() == 0
    names = {r["split"] for r in splits.select("split").distinct().collect()}
    assert names == {"default"} | {f"{k}-{i}" for k in ("sliding-window", "random") for i in range(3)}
    again = all_splits(hundred.repartition(16), "id", "t", 0.1, default)
    assert splits.exceptAll(again).count() == 0 and again.exceptAll(splits).count() == 0


def test_too_few_rows():
    assert window_sizes(100, 10) == 60
    with pytest.raises(ValueError):
        window_sizes(40, 10)


def test_date_bounds(spark):
    rows = [(i, d) for i, d in enumerate(["2023-05-31", "2023-06-01", "2023-06-30", "2023-07-01", "2023-07-31", "2023-08-01"])]
    df = spark.createDataFrame(rows, "id long, d string").withColumn("d", F.col("d").cast("date"))
    bounds = [F.lit(x).cast("date") for x in ("2023-06-01", "2023-07-01", "2023-08-01")]
    closed = {r["row_id"]: r["part"] for r in split_by_dates(df, "id", "d", *bounds).collect()}
    assert closed == {0: "train", 1: "val", 2: "val", 3: "test", 4: "test"}
    assert split_by_dates(df, "id", "d", *bounds[:2]).where("part = 'test'").count() == 3


def test_rows_without_time(spark):
    df = spark.createDataFrame([(1, "2023-01-01"), (2, None), (3, "2024-01-01")], "id long, d string").withColumn("d", F.col("d").cast("date"))
    bounds = [F.lit(x).cast("date") for x in ("2023-06-01", "2023-07-01")]
    assert {r["row_id"]: r["part"] for r in split_by_dates(df, "id", "d", *bounds).collect()} == {1: "train", 3: "test"}
    with pytest.raises(ValueError, match="no validation rows"):
        split_by_months(df, "id", "d", (2015, [2]), (2015, [4]))


def test_month_split(spark):
    rows = list(enumerate(["2014-11-30", "2015-01-15", "2015-02-28", "2015-04-01", "2015-05-18", "2015-03-01"]))
    df = spark.createDataFrame(rows, "id long, d string").withColumn("d", F.col("d").cast("date"))
    got = {r["row_id"]: r["part"] for r in split_by_months(df, "id", "d", (2015, [2, 3]), (2015, [4, 5])).collect()}
    assert got == {0: "train", 1: "train", 2: "val", 5: "val", 3: "test", 4: "test"}


def test_spans_and_overlap(spark, hundred):
    splits = split_sliding(hundred, "id", "t", 10)
    spans = {(r["split"], r["part"]): r for r in split_spans(hundred, splits, "id", "t").collect()}
    for i in range(3):
        parts = [spans[f"sliding-window-{i}", p] for p in ("train", "val", "test")]
        assert parts[0]["end"] <= parts[1]["start"] and parts[1]["end"] <= parts[2]["start"]
    double = splits.unionByName(splits.where("part = 'val'").withColumn("part", F.lit("train")))
    assert overlaps(double).count() == 30
