"""Whole dataset builds on stand-in tables, from raw rows to the rows of a split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import query, table
from catalog.features import COMBINATIONS, MATCHES, history_sql, rounded_history
from timetab.plans import jobs
from timetab.plans.jobs import Timeline, split_view
from timetab.session import fresh_path
from timetab.sources.bundles import load_bundle


@query("""
    WITH e AS (SELECT event_id, ts, event_type, value, user_id FROM events WHERE value >= 1.0),
         tr AS (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-20'),
         ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (
             SELECT event_type FROM tr GROUP BY 1 HAVING count(*) >= 0.01 * (SELECT count(*) FROM tr))),
         s AS (SELECT *, row_number() OVER (ORDER BY substr(md5('0|' || event_id), 1, 15), event_id) AS rn, count(*) OVER () AS n FROM e)
    SELECT event_id AS row_id, user_id::FLOAT::DOUBLE AS num_user, isodow(ts)::DOUBLE AS day_of_week,
           (hour(ts) * 60 + minute(ts))::DOUBLE AS minute_of_day, hour(ts)::DOUBLE AS hour_of_day,
           (event_type = 'error')::INT::DOUBLE AS bin_error, coalesce(ty.code, (SELECT count(*) FROM ty)) AS cat_type,
           epoch_us(ts) AS ts, round(ln(value)::FLOAT::DOUBLE, 4) AS y,
           CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' WHEN ts < TIMESTAMP '2024-01-24' THEN 'val' ELSE 'test' END AS part
    FROM s LEFT JOIN ty USING (event_type) WHERE rn <= floor(0.5 * n) AND ts < TIMESTAMP '2024-01-29'
""")
def job_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service log: threshold, rare codes, exact half, calendar, log target, default split with a closed end."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("cat_type"), F.col("event_type").alias("cat_skipped"), "value",
        F.col("user_id").alias("num_user"), (F.col("event_type") == "error").cast("int").alias("bin_error"),
    )
    built = jobs.event_log(
        events, "event_id", "value", Timeline("ts", "2024-01-20", "2024-01-24", "2024-01-29"), fraction=0.5, skip=["cat_skipped"]
    )
    wide = split_view(built)
    single = {c: F.col(c).cast("double") for c in ("num_user", "day_of_week", "minute_of_day", "hour_of_day", "bin_error")}
    return wide.withColumns(single | {"y": F.round(F.col("y").cast("double"), 4)})


@query("""
    WITH s AS (SELECT *, row_number() OVER (ORDER BY substr(md5('0|' || event_id), 1, 15), event_id) AS rn, count(*) OVER () AS n FROM events),
         t AS (SELECT *, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS t FROM s WHERE rn <= floor(0.4 * n))
    SELECT CASE WHEN t < TIMESTAMP '2024-01-20' THEN 'train' WHEN t < TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END AS part,
           count(*) AS n, sum(isodow(t)::BIGINT)::DOUBLE AS weekdays, sum((hour(t) * 60 + minute(t))::BIGINT)::DOUBLE AS minutes,
           sum((event_type = 'view')::INT)::DOUBLE AS available, sum(user_id)::DOUBLE AS users, sum(day(t) + 100 * month(t))::DOUBLE AS days
    FROM t GROUP BY 1
""")
def job_sensor_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements with epoch seconds and availability flags, summed up per part of the default split."""
    built = _sensor_build(spark, sf_dir)
    total = {"weekdays": "day_of_week", "minutes": "minute_of_day", "available": "view_available", "users": "users"}
    return split_view(built).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("double")).alias(n) for n, c in total.items()],
        F.sum((F.col("day_of_month") + 100 * F.col("month")).cast("double")).alias("days"),
    )


@query("""
    WITH s AS (SELECT *, row_number() OVER (ORDER BY substr(md5('0|' || event_id), 1, 15), event_id) AS rn, count(*) OVER () AS n FROM events),
         t AS (SELECT *, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS t FROM s WHERE rn <= floor(0.4 * n))
    SELECT event_id AS row_id, user_id::FLOAT::DOUBLE AS users, isodow(t)::DOUBLE AS day_of_week, day(t)::DOUBLE AS day_of_month,
           (hour(t) * 60 + minute(t))::DOUBLE AS minute_of_day, hour(t)::DOUBLE AS hour_of_day, month(t)::DOUBLE AS month,
           (event_type = 'view')::INT::DOUBLE AS view_available, epoch_us(t) AS "when", value::FLOAT::DOUBLE AS y,
           CASE WHEN t < TIMESTAMP '2024-01-20' THEN 'train' WHEN t < TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END AS part
    FROM t
""")
def job_sensor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same build, row by row with every feature."""
    rows = split_view(_sensor_build(spark, sf_dir))
    return rows.withColumns({c: F.col(c).cast("double") for c, t in rows.dtypes if t == "float"})


def _sensor_build(spark: SparkSession, sf_dir: str) -> jobs.Build:
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("fact_time"), "value",
        F.col("user_id").alias("users"), (F.col("event_type") == "view").cast("int").alias("view_available"),
    )
    return jobs.sensor_log(raw, "event_id", "fact_time", "value", Timeline("when", "2024-01-20", "2024-01-25"), fraction=0.4)


@query("""
    WITH q AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_orderpriority,
                      CASE WHEN o_totalprice > 300000 THEN NULL ELSE o_custkey END AS rank_A,
                      CASE WHEN o_totalprice < 100000 THEN 'N' ELSE 'Y' END AS large,
                      CASE WHEN o_totalprice > 400000 THEN 1 END AS huge_B FROM orders)
    SELECT o_orderkey AS row_id, rank_A::FLOAT::DOUBLE AS rank_A, isodow(o_orderdate)::DOUBLE AS day_of_week,
           day(o_orderdate)::DOUBLE AS day_of_month, dayofyear(o_orderdate)::DOUBLE AS day_of_year, month(o_orderdate)::DOUBLE AS month,
           (large = 'Y')::INT::DOUBLE AS large, (huge_B IS NOT NULL)::INT::DOUBLE AS huge_B,
           dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority, epoch_us(o_orderdate) AS o_orderdate, y::BIGINT AS y,
           CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'val' ELSE 'test' END AS part
    FROM q
""")
def job_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with sentinels, an empty column, yes/no text, a one-value column and text, saved as a bundle and loaded."""
    price = F.col("o_totalprice")
    raw = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").cast("int").alias("won"), "o_orderpriority",
        F.when(price > 300000, -1).otherwise(F.col("o_custkey")).cast("bigint").alias("rank_A"), F.lit(-1).alias("empty_A"),
        F.when(price < 100000, "N").otherwise("Y").alias("large"), F.when(price > 400000, 1).otherwise(-1).alias("huge_B"),
    )
    built = jobs.quotes(raw, "o_orderkey", "won", Timeline("o_orderdate", "1999-01-01", "2000-01-01"))
    path = fresh_path(spark, "quotes")
    built.save(path, "quotes")
    rows = load_bundle(spark, path)
    return rows.withColumns({c: F.col(c).cast("double") for c in (*built.roles.num, *built.roles.bin)})


@query("""
    WITH fix AS (SELECT l_partkey AS id, max(l_quantity) AS size FROM lineitem WHERE l_tax = 0.08 AND l_quantity > 48 GROUP BY 1),
         macro AS (SELECT o_orderdate::DATE AS day, avg(o_totalprice) AS level FROM orders GROUP BY 1),
         base AS (
             SELECT p_partkey, DATE '1996-01-01' + (p_partkey % 1500)::INT AS day, p_retailprice AS price, p_brand, p_type,
                    coalesce(fix.size, p_size) AS area, (p_size > 25)::INT AS big
             FROM part LEFT JOIN fix ON p_partkey = id
             WHERE p_size <> (SELECT min(p_size) FROM part) OR id IS NOT NULL
         ),
         kept AS (SELECT * FROM base JOIN macro USING (day) WHERE area > 5 AND price > 905 AND price NOT IN (910, 1500))
    SELECT p_partkey AS row_id, area::FLOAT::DOUBLE AS area, level::FLOAT::DOUBLE AS level, isodow(day)::DOUBLE AS day_of_week,
           year(day)::DOUBLE AS year, big::DOUBLE AS big,
           CASE WHEN p_type = 'PROMO' THEN (SELECT count(DISTINCT p_type) - 1 FROM kept) ELSE dense_rank() OVER (ORDER BY nullif(p_type, 'PROMO') NULLS LAST) - 1 END AS kind,
           round(ln(price / area)::FLOAT::DOUBLE, 4) AS y,
           CASE WHEN day < DATE '1999-01-01' THEN 'train' WHEN day < DATE '1999-07-01' THEN 'val' ELSE 'test' END AS part
    FROM kept
""")
def job_property_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with fixes, outliers, a daily macro series and a missing category."""
    day = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("p_partkey") % 1500).cast("int"))
    sales = table(spark, sf_dir, "part").select(
        "p_partkey", day.alias("day"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("area"),
        F.col("p_size").alias("km"), (F.col("p_size") > 25).cast("int").alias("big"),
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("kind"),
    )
    fixes = table(spark, sf_dir, "lineitem").where((F.col("l_tax") == 0.08) & (F.col("l_quantity") > 48)).select(
        F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("area")
    )
    macro = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.avg("o_totalprice").alias("level"))
    keep = (F.col("area") > 5) & (F.col("price") > 905) & ~F.col("price").isin(910.0, 1500.0)
    built = jobs.property_sales(
        sales, macro, fixes, "p_partkey", Timeline("day", "1999-01-01", "1999-07-01"), price="price", area="area", distance="km",
        keep=keep, cat=["kind"], fit_on="all",
    )
    wide = split_view(built)
    single = {c: F.col(c).cast("double") for c in ("area", "day_of_week", "year", "big")}
    shown = wide.withColumns(single | {"level": F.col("level").cast("double"), "y": F.round(F.col("y").cast("double"), 4)})
    return shown.select("row_id", "area", "level", "day_of_week", "year", "big", "kind", "y", "part")


@query("""
    WITH a AS (SELECT o_custkey AS id, max(o_orderdate) AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
         n AS (SELECT count(*) AS n, floor(0.1 * count(*))::BIGINT AS v FROM a),
         parts AS (
             SELECT 'default' AS split, CASE WHEN d < TIMESTAMP '2000-06-01' THEN 'train' WHEN d < TIMESTAMP '2001-01-01' THEN 'val'
                    ELSE 'test' END AS part, count(*) AS n_rows FROM a GROUP BY ALL
             UNION ALL
             SELECT k || '-' || i, p, CASE p WHEN 'train' THEN n - 4 * v ELSE v END
             FROM n, range(3) r(i), (VALUES ('sliding-window'), ('random')) kinds(k), (VALUES ('train'), ('val'), ('test')) ps(p)
         )
    SELECT split, part, n_rows, 118 AS features FROM parts
""")
def job_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers anchored at their last order, target: it was worth more than the mean; rows per split and part."""
    built = _offers_build(spark, sf_dir)
    return built.splits.groupBy("split", "part").agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "features", F.lit(len(built.roles.features))
    )


@query(f"""
    WITH f AS ({history_sql("any_value(anchor_large) AS large")})
    SELECT f.*, CASE WHEN anchor_date < '2000-06-01' THEN 'train' WHEN anchor_date < '2001-01-01' THEN 'val' ELSE 'test' END AS part FROM f
""")
def job_offers_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same build, row by row: the default split, the target and all 118 features."""
    built = _offers_build(spark, sf_dir)
    rows = built.rows.join(built.splits.where("split = 'default'").select(F.col("row_id").alias("id"), "part"), "id")
    return rounded_history(rows).withColumn("large", F.col("large").cast("bigint"))


def _offers_build(spark: SparkSession, sf_dir: str) -> jobs.Build:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"), "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey"
    )
    last = lines.groupBy(F.col("o_custkey").alias("id")).agg(F.max_by(
        F.struct("d", "p_brand", "p_type", "l_suppkey", "o_totalprice"), F.struct("d", "o_orderkey", -F.col("l_linenumber"), -F.col("l_partkey"), -F.col("l_suppkey"))
    ).alias("a")).select(
        "id", F.col("a.d").alias("anchor_date"), F.col("a.p_brand").alias("anchor_brand"), F.col("a.p_type").alias("anchor_type"),
        F.col("a.l_suppkey").alias("anchor_supplier"), (F.col("a.o_totalprice") > 250000).cast("int").alias("large"),
    )
    events = lines.select(F.col("o_custkey").alias("id"), "d", "p_brand", "p_type", "l_suppkey", "l_quantity", "l_extendedprice")
    return jobs.offers(
        events, last, "id", "large", Timeline("anchor_date", "2000-06-01", "2001-01-01"), date="d", quantity="l_quantity",
        amount="l_extendedprice", matches=MATCHES, combinations=COMBINATIONS,
    )


@query("""
    WITH s AS (SELECT *, row_number() OVER (ORDER BY substr(md5('0|' || o_orderkey), 1, 15), o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
    SELECT CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'val' ELSE 'test' END AS part,
           count(*) AS n_rows, round(avg((o_orderstatus = 'F')::INT), 8) AS share, 16 AS features
    FROM s WHERE rn <= floor(0.25 * n) GROUP BY 1
""")
def job_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with aggregated lines, dead columns dropped, a quarter sampled: rows, features and target share per part."""
    built = _credit_build(spark, sf_dir)
    return split_view(built).groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("y"), 8).alias("share")).withColumn(
        "features", F.lit(len(built.roles.features))
    )


@query("""
    WITH s AS (SELECT *, row_number() OVER (ORDER BY substr(md5('0|' || o_orderkey), 1, 15), o_orderkey) AS rn, count(*) OVER () AS n FROM orders),
    l AS (SELECT *, (l_shipdate::DATE - DATE '1970-01-01')::DOUBLE AS days,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS up,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS down FROM lineitem),
    g AS (
        SELECT l_orderkey, max(l_extendedprice) AS max_price_A, min(l_extendedprice) AS min_price_A, avg(l_extendedprice) AS mean_price_A,
               stddev_samp(l_extendedprice) AS std_price_A, max(days) AS hi, min(days) AS lo, avg(days) AS mid, stddev_samp(days) AS std_shipped_D,
               count(DISTINCT l_returnflag) AS n_unique_flag_M, max(l_linestatus) AS status,
               max(l_returnflag) FILTER (WHERE up = 1) AS f, max(l_returnflag) FILTER (WHERE down = 1) AS t
        FROM l GROUP BY l_orderkey
    )
    SELECT o_orderkey AS case_id, o_totalprice, max_price_A, min_price_A, round(mean_price_A, 6) AS mean_price_A, round(std_price_A, 3) AS std_price_A,
           hi - (o_orderdate::DATE - DATE '1970-01-01') AS max_shipped_D, lo - (o_orderdate::DATE - DATE '1970-01-01') AS min_shipped_D,
           trunc(mid - (o_orderdate::DATE - DATE '1970-01-01')) AS mean_shipped_D, round(std_shipped_D, 4) AS std_shipped_D, n_unique_flag_M,
           isodow(o_orderdate)::BIGINT AS day_of_week, day(o_orderdate)::BIGINT AS day_of_month, dayofyear(o_orderdate)::BIGINT AS day_of_year,
           (status = 'O')::INT::DOUBLE AS max_status_L, CASE f WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END::BIGINT AS first_flag_M,
           CASE t WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END::BIGINT AS last_flag_M, (o_orderstatus = 'F')::INT::BIGINT AS target,
           CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'val' ELSE 'test' END AS part
    FROM s LEFT JOIN g ON o_orderkey = l_orderkey WHERE rn <= floor(0.25 * n)
""")
def job_credit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same build, row by row with every feature."""
    built = _credit_build(spark, sf_dir)
    rows = built.rows.join(built.splits.where("split = 'default'").select(F.col("row_id").alias("case_id"), "part"), "case_id")
    whole = {"target", "day_of_week", "day_of_month", "day_of_year", "n_unique_flag_M", "first_flag_M", "last_flag_M"}
    shown = {c: F.col(c).cast("bigint") for c in whole} | {
        c: F.col(c).cast("double") for c in ("max_status_L", "max_shipped_D", "min_shipped_D", "mean_shipped_D")
    } | {"mean_price_A": F.round("mean_price_A", 6), "std_price_A": F.round("std_price_A", 3), "std_shipped_D": F.round("std_shipped_D", 4)}
    return rows.withColumns(shown).select("case_id", *built.roles.features, "target", "part")


def _credit_build(spark: SparkSession, sf_dir: str) -> jobs.Build:
    base = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").cast("date").alias("date_decision"),
        (F.col("o_orderstatus") == "F").cast("int").alias("target"),
    )
    static = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), "o_totalprice", F.lit(1).alias("dead"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("num_group1"), F.col("l_partkey").alias("num_group2"),
        F.col("l_suppkey").alias("num_group3"),
        F.col("l_extendedprice").alias("price_A"), F.col("l_returnflag").alias("flag_M"), F.col("l_shipdate").alias("shipped_D"),
        F.col("l_linestatus").alias("status_L"),
    )
    return jobs.credit(
        base, [static], [(lines, ["num_group1", "num_group2", "num_group3"])], "case_id", "target", Timeline("date_decision", "1999-01-01", "2000-01-01"),
        bin_flags={"max_status_L": F.col("max_status_L") == "O"}, drop=["min_status_L"],
    )
