"""The paths that large tables take, forced on the test tables by small bounds; the SQL is that of the plain queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import ORACLES, query, table
from catalog.encoders import _orders
from catalog.neighbours import K, _shown
from timetab.operators.encoding import encode_vocabulary, fit_vocabulary
from timetab.operators.joins import in_table, lookup_join, not_in_table, update_join, with_suffix
from timetab.operators.neighbours import nearest
from timetab.operators.ordering import newest_share, time_folds
from timetab.operators.sampling import exact_sample
from timetab.operators.splits import all_splits, part_by_bounds, split_random, split_sliding

LEAF = 20  # rows that the search for a position may rank
HOT = 30  # rows of a key that one task may get
CELL, PIVOTS, ROUND, LANE = 8, 16, 4, 8


@query(ORACLES["quarter_sample"])
def quarter_sample_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample, its border found by narrowing scans."""
    return exact_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 0.25, "o_orderkey", leaf_rows=LEAF)


@query(ORACLES["seven_splits"])
def seven_splits_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven splits by narrowing scans; a date that many orders share is searched on in the order key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    bounds = [F.lit(d).cast("timestamp_ntz") for d in ("1999-01-01", "2000-01-01")]
    splits = all_splits(orders, "o_orderkey", "o_orderdate", 0.1, part_by_bounds("o_orderdate", *bounds), leaf_rows=LEAF)
    return splits.groupBy("split", "part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"), F.sum("row_id").alias("id_sum")
    )


@query(ORACLES["sliding_windows"])
def sliding_windows_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sliding windows by narrowing scans."""
    return split_sliding(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id", "ts", 0.1, leaf_rows=LEAF)


@query(ORACLES["random_twins"])
def random_twins_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The random twins by narrowing scans."""
    return split_random(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id", "ts", 0.1, leaf_rows=LEAF)


@query(ORACLES["order_folds"])
def order_folds_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time folds by narrowing scans."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return time_folds(orders, "o_orderdate", leaf_rows=LEAF).select("o_orderkey", F.col("fold").cast("bigint").alias("fold"))


@query(ORACLES["recent_share"])
def recent_share_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifth by narrowing scans."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return newest_share(orders, "o_orderdate", leaf_rows=LEAF).select("o_orderkey")


@query(ORACLES["neighbours_without_self"])
def neighbours_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest other vectors with small cells, few pivots and several widening rounds."""
    v = table(spark, sf_dir, "embeddings")
    return _shown(nearest(v, v, K, exclude_self=True, cell_rows=CELL, pivots=PIVOTS, widen=ROUND, lane_packs=LANE))


@query(ORACLES["neighbours_causal"])
def neighbours_causal_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest older vectors on the same path."""
    v = table(spark, sf_dir, "embeddings")
    return _shown(nearest(v, v, K, time="vec_id", exclude_self=True, cell_rows=CELL, pivots=PIVOTS, widen=ROUND, lane_packs=LANE))


@query(ORACLES["dimension_join"])
def dimension_join_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension join shuffled, each nation dealt out to as many tasks as its customers need."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("key"), F.col("c_acctbal").alias("balance"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.max("s_acctbal").alias("balance"))
    named = lookup_join(customers, nations, ["key"], limit=0, task_rows=HOT)
    return lookup_join(named, with_suffix(suppliers, ["key"]), ["key"], limit=0, task_rows=HOT)


@query(ORACLES["update_customers"])
def update_customers_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The updated customers through the shuffled join."""
    fixes = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_totalprice").alias("c_acctbal"),
        F.when(F.col("o_totalprice") > 250000, "BIG").alias("c_mktsegment"),
    )
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return update_join(base, fixes, "c_custkey", ["o_orderkey"], limit=0)


@query(ORACLES["membership"])
def membership_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi and anti join through the shuffled join."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    large = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey"))
    yes = in_table(customers, large, "c_custkey", limit=0, task_rows=HOT).withColumn("has_large", F.lit(True))
    return yes.unionByName(not_in_table(customers, large, "c_custkey", limit=0, task_rows=HOT).withColumn("has_large", F.lit(False)))


@query(ORACLES["ordinal_unseen"])
def ordinal_unseen_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes through shuffled joins, hot values known from the vocabulary's counts."""
    orders = _orders(spark, sf_dir).select("o_orderkey", "part", "month", "o_orderpriority")
    codes = fit_vocabulary(orders.where("part = 'train'"), ["month", "o_orderpriority"])
    return encode_vocabulary(orders, codes, limit=0, task_rows=HOT)
