"""Filters, sentinel and flag columns, name-based casts, update and lookup joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import query, table
from timetab.functions.columns import (
    Roles, cast_by_name, log_target, mapped, pick, presence, sentinel_to_null,
)
from timetab.operators.cleaning import at_least, drop_at_minimum, plausible
from timetab.operators.encoding import dense_codes
from timetab.operators.joins import in_table, lookup_join, not_in_table, update_join, with_suffix
from timetab.operators.ordering import global_position
from timetab.operators.profiling import drop_uninformative
from timetab.operators.sampling import exact_sample


@query("""
    WITH fixes AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1)
    SELECT p_partkey, nullif(CASE WHEN p_size <= 8 THEN -1 ELSE p_size END, -1)::BIGINT AS size_known,
           coalesce(CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END, 'NA') AS kind,
           round(ln(p_retailprice / p_size), 6) AS log_price
    FROM part WHERE (p_retailprice <> (SELECT min(p_retailprice) FROM part) OR p_partkey IN (SELECT id FROM fixes))
      AND p_size > 5 AND p_size <> 13 AND p_retailprice > 905 AND p_retailprice <> 910 AND p_retailprice <> 1500
""")
def clean_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without the cheapest ones (unless they get a fix), odd sizes and placeholder prices, with a log target."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    fixes = table(spark, sf_dir, "lineitem").where((F.col("l_quantity") == 50) & (F.col("l_discount") == 0.1)).select(
        F.col("l_partkey").alias("p_partkey")
    )
    kept = drop_at_minimum(part, "p_retailprice", fixes, "p_partkey").where(plausible(
        "p_size", "p_retailprice", min_size=5, bad_sizes=[13], min_price=905, bad_prices=[910.0, 1500.0]
    ))
    marked = kept.withColumns({
        "size_known": F.when(F.col("p_size") <= 8, -1).otherwise(F.col("p_size")).cast("bigint"),
        "kind": F.when(F.col("p_type") != "PROMO", F.col("p_type")),
    })
    return marked.na.fill("NA", ["kind"]).select(
        "p_partkey", sentinel_to_null("size_known").alias("size_known"), "kind",
        F.round(log_target("p_retailprice", "p_size"), 6).alias("log_price"),
    )


@query("SELECT event_id, round(ln(value), 6) AS y FROM events WHERE value >= 1.0")
def target_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a value of at least one, and its logarithm as target."""
    events = at_least(table(spark, sf_dir, "events").select("event_id", "value"), "value", 1.0)
    return events.select("event_id", F.round(log_target("value"), 6).alias("y"))


@query("""
    WITH q AS (SELECT l_quantity, dense_rank() OVER (ORDER BY l_quantity) - 1 AS c FROM (SELECT DISTINCT l_quantity FROM lineitem)),
         f AS (SELECT l_returnflag, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS c FROM (SELECT DISTINCT l_returnflag FROM lineitem))
    SELECT CASE l_linestatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 END::BIGINT AS status,
           (CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END IS NOT NULL)::INT::DOUBLE AS returned,
           (l_discount > 0.05 AND l_tax < 0.04)::INT::DOUBLE AS bargain,
           q.c AS quantity_code, f.c AS flag_code, count(*) AS n
    FROM lineitem JOIN q USING (l_quantity) JOIN f USING (l_returnflag) GROUP BY ALL
""")
def flags_and_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-valued text to numbers, presence of a value, comparison flags and dense codes, counted per combination."""
    lines = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    coded = dense_codes(lines, ["l_quantity", "l_returnflag"])
    marked = coded.withColumn("given", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    return marked.groupBy(
        mapped("l_linestatus", {"O": 0, "F": 1}).cast("bigint").alias("status"),
        presence("given").cast("double").alias("returned"),
        ((F.col("l_discount") > 0.05) & (F.col("l_tax") < 0.04)).cast("double").alias("bargain"),
        F.col("l_quantity_code").alias("quantity_code"), F.col("l_returnflag_code").alias("flag_code"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT strftime(CASE WHEN l_linenumber > 1 THEN l_shipdate END, '%Y-%m-%d') AS shipped_D, l_orderkey AS case_id,
           count(*) AS n
    FROM lineitem GROUP BY 1, 2
""")
def casts_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and date columns typed by their names; text that is no date becomes null."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.when(F.col("l_linenumber") > 1, day).otherwise("unknown").alias("shipped_D")
    )
    typed = cast_by_name(raw, ["case_id"], lambda c: c.endswith("D"))
    return typed.groupBy(F.col("shipped_D").cast("string").alias("shipped_D"), F.col("case_id").cast("bigint").alias("case_id")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("""
    SELECT o_orderkey AS row_id, o_totalprice::FLOAT::DOUBLE AS o_totalprice, o_custkey AS o_custkey,
           epoch_us(o_orderdate) AS o_orderdate, (o_orderstatus = 'F')::INT::BIGINT AS y
    FROM orders
""")
def role_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order columns picked by name and stored by role: numbers as float, categories and times as integers."""
    orders = table(spark, sf_dir, "orders").withColumn("shipped", (F.col("o_orderstatus") == "F").cast("int"))
    roles = Roles(
        num=pick(orders, suffix="price"), cat=pick(orders, contains="cust"), meta=pick(orders, suffix="date"),
        target="shipped", task="binclass",
    )
    return roles.select(orders, "o_orderkey").withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query("""
    WITH f AS (
        SELECT o_custkey AS id, o_totalprice AS bal, CASE WHEN o_totalprice > 250000 THEN 'BIG' END AS seg,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn
        FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
    ), s AS (
        SELECT id, seg FROM (SELECT id, seg, row_number() OVER (PARTITION BY id ORDER BY rn) AS k FROM f WHERE seg IS NOT NULL) WHERE k = 1
    )
    SELECT c_custkey, c_name, coalesce(bal, c_acctbal) AS c_acctbal, coalesce(s.seg, c_mktsegment) AS c_mktsegment
    FROM customer LEFT JOIN (SELECT * FROM f WHERE rn = 1) b ON c_custkey = b.id LEFT JOIN s ON c_custkey = s.id
""")
def update_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with values overwritten by the last non-null fix; fixes come from urgent finished orders, several each."""
    fixes = table(spark, sf_dir, "orders").where(
        (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    ).select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_totalprice").alias("c_acctbal"),
        F.when(F.col("o_totalprice") > 250000, "BIG").alias("c_mktsegment"),
    )
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return update_join(base, fixes, "c_custkey", ["o_orderkey"])


@query("""
    SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS has_large FROM customer
""")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with and without a large order, by semi and anti join."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    large = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey"))
    yes = in_table(customers, large, "c_custkey").withColumn("has_large", F.lit(True))
    return yes.unionByName(not_in_table(customers, large, "c_custkey").withColumn("has_large", F.lit(False)))


@query("""
    WITH macro AS (SELECT l_shipdate AS day, sum(l_quantity) AS shipped, count(*) AS n_lines FROM lineitem GROUP BY 1)
    SELECT o_orderkey, shipped, n_lines FROM orders JOIN macro ON o_orderdate = day
""")
def macro_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a daily series joined on the calendar day; days missing from the series drop out."""
    macro = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("day")).agg(
        F.sum("l_quantity").alias("shipped"), F.count(F.lit(1)).alias("n_lines")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("day"))
    return lookup_join(orders, macro, ["day"]).select("o_orderkey", "shipped", "n_lines")


@query("""
    SELECT c.c_custkey, c.c_nationkey AS key, n_name, c.c_acctbal AS balance, s.s_acctbal AS balance_right
    FROM customer c JOIN nation ON c_nationkey = n_nationkey
         JOIN (SELECT s_nationkey, max(s_acctbal) AS s_acctbal FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey
""")
def dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers joined to two dimensions on the nation; the clashing balance of the right side gets a suffix."""
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("key"), F.col("c_acctbal").alias("balance")
    )
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.max("s_acctbal").alias("balance"))
    return lookup_join(lookup_join(customers, nations, ["key"]), with_suffix(suppliers, ["key"]), ["key"])


@query("""
    SELECT o_orderkey, o_custkey FROM (
        SELECT *, row_number() OVER (ORDER BY substr(md5('0|' || o_orderkey), 1, 15), o_orderkey) AS rn, count(*) OVER () AS n FROM orders
    ) WHERE rn <= floor(0.25 * n)
""")
def quarter_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact seeded quarter of the orders."""
    return exact_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 0.25, "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders")
def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every order in time."""
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return global_position(orders, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""
    SELECT l_orderkey, l_quantity, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3
""")
def live_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines after constant, empty and too-diverse text columns, added for the purpose, are dropped again."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate")
    padded = lines.withColumns({
        "constant": F.lit(1), "empty": F.lit(None).cast("string"), "day": F.date_format("l_shipdate", "yyyy-MM-dd"),
    }).drop("l_shipdate")
    kept = drop_uninformative(padded)
    return kept.groupBy(*kept.columns).agg(F.count(F.lit(1)).alias("n"))
