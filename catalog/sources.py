"""Readers and writers: each query writes what it derives from the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import query, table
from catalog.boards import RUNS_SQL, runs
from timetab.functions.columns import Roles, decimal_comma as parse_comma
from timetab.operators.joins import null_safe_join
from timetab.operators.splits import split_by_dates
from timetab.plans.metrics import roc_auc
from timetab.session import fresh_path
from timetab.sources.bundles import cached, load_bundle, load_task, save_bundle
from timetab.sources.runs import flatten_reports, read_reports
from timetab.sources.tables import read_csv, read_tables


@query("""
    SELECT c_custkey, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal::FLOAT::DOUBLE END AS lenient,
           c_acctbal::FLOAT::DOUBLE AS strict, CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_mktsegment END AS segment
    FROM customer
""")
def decimal_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances written to CSV with a decimal comma, junk and NA tokens, and parsed again."""
    text = F.replace(F.format_string("%.2f", "c_acctbal"), F.lit("."), F.lit(","))
    raw = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", "#!").otherwise(text).alias("lenient"), text.alias("strict"),
        F.when(F.col("c_mktsegment") == "FURNITURE", "NA").otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    path = fresh_path(spark, "csv")
    raw.write.option("header", True).option("compression", "gzip").csv(path)
    back = read_csv(spark, path, "c_custkey bigint, lenient string, strict string, segment string")
    return back.select(
        "c_custkey", parse_comma("lenient").cast("double").alias("lenient"),
        parse_comma("strict", strict=True).cast("double").alias("strict"), "segment",
    )


@query("""
    SELECT o_orderkey AS key, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'late' ELSE o_custkey::VARCHAR END AS value,
           CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 12.5 ELSE o_custkey::DOUBLE END AS number FROM orders
""")
def csv_late_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV whose last row has a word and a fraction where all others have whole numbers, read without a schema."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    top = orders.agg(F.max("o_orderkey")).first()[0]
    late = F.col("o_orderkey") == top
    path = fresh_path(spark, "late")
    orders.select(
        F.col("o_orderkey").alias("key"), F.when(late, "late").otherwise(F.col("o_custkey").cast("string")).alias("value"),
        F.when(late, "12.5").otherwise(F.col("o_custkey").cast("string")).alias("number"),
    ).write.option("header", True).csv(path)
    return read_csv(spark, path).withColumn("key", F.col("key").cast("bigint"))


@query("""
    SELECT o_custkey AS customer, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, count(note) AS notes FROM (
        SELECT *, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS note FROM orders
    ) GROUP BY 1
""")
def union_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table written as two files with different integer widths and one extra column, read as a union."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    paths = [fresh_path(spark, "narrow"), fresh_path(spark, "wide")]
    partial = orders.where("o_orderstatus = 'P'")
    orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("int"), F.col("o_custkey").cast("int").alias("customer")).write.parquet(paths[0])
    partial.select("o_orderkey", F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("note")).write.parquet(paths[1])
    return read_tables(spark, paths).groupBy("customer").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.count("note").alias("notes")
    ).select(F.col("customer").cast("bigint").alias("customer"), "n", "keys", "notes")


@query("""
    SELECT o_orderkey AS row_id, o_totalprice::FLOAT::DOUBLE AS o_totalprice, o_custkey, epoch_us(o_orderdate) AS o_orderdate,
           (o_orderstatus = 'F')::INT::BIGINT AS y,
           CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'val'
                ELSE 'test' END AS part, 'orders' AS name, 'binclass' AS task_type, 'roc-auc' AS score
    FROM orders
""")
def bundle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders saved as a dataset bundle, one split and the task loaded again."""
    orders = table(spark, sf_dir, "orders").withColumn("shipped", (F.col("o_orderstatus") == "F").cast("int"))
    roles = Roles(num=["o_totalprice"], cat=["o_custkey"], meta=["o_orderdate"], target="shipped", task="binclass")
    bounds = [F.lit(d).cast("timestamp_ntz") for d in ("1999-01-01", "2000-01-01")]
    path = fresh_path(spark, "bundle")
    save_bundle(orders, roles, split_by_dates(orders, "o_orderkey", "o_orderdate", *bounds), path, "orders", row_id="o_orderkey")
    task = load_task(spark, path)
    return load_bundle(spark, path).withColumns({
        "o_totalprice": F.col("o_totalprice").cast("double"), "name": F.lit(task.name), "task_type": F.lit(task.task_type),
        "score": F.lit(task.score),
    })


@query(f"""
    WITH {RUNS_SQL}
    SELECT model, dataset, 'evaluation' AS kind, seed::BIGINT AS seed, ':data/' || dataset AS path, 0.0::DOUBLE AS train_score,
           0.0::DOUBLE AS time, round(score, 8) AS score
    FROM runs
""")
def reports_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run reports written as nested JSON in a folder per run and scanned by glob."""
    body = F.to_json(F.struct(
        F.struct(F.struct(F.concat(F.lit(":data/"), "dataset").alias("path")).alias("data"), F.col("seed")).alias("config"),
        F.struct(F.struct("score").alias("test")).alias("metrics"),
    ))
    path = fresh_path(spark, "reports")
    folders = runs(spark, sf_dir).select(
        body.alias("value"), "model", "dataset", F.lit("evaluation").alias("kind"), F.col("seed").alias("run")
    )
    folders.write.partitionBy("model", "dataset", "kind", "run").text(path)
    found = read_reports(spark, f"{path}/*/*/*/*/*.txt", r"model=([^/]+)/dataset=([^/]+)/kind=([^/]+)/run=(\d+)/")
    return found.select(
        "model", "dataset", "kind", F.col("seed").cast("bigint").alias("seed"), "path", "train_score", "time",
        F.round("score", 8).alias("score"),
    )


@query("SELECT l_suppkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_suppkey")
def cached_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result stored under the hash of its arguments; the second call reads it."""
    def build() -> DataFrame:
        return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("quantity"))

    arguments = {"query": "quantity per supplier", "data": sf_dir, "run": fresh_path(spark, "run")}
    cached(spark, arguments, build)
    return cached(spark, arguments, lambda: build().limit(0))


@query("""
    WITH q AS (
        SELECT lang, quality AS y, n_chars AS s, (n_chars > 900)::INT AS guess FROM labels JOIN documents USING (doc_id)
    ),
    ranked AS (SELECT lang, y, guess, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS r FROM q),
    sums AS (SELECT lang, count(*) AS n, avg((y = guess)::INT) AS a, sum(r) FILTER (WHERE y = 1) AS rs, count(*) FILTER (WHERE y = 1) AS p,
                    count(*) FILTER (WHERE y = 0) AS m FROM ranked GROUP BY lang)
    SELECT lang, round(a, 8) AS accuracy, round((rs - p * (p + 1) / 2.0) / (p * m::DOUBLE), 8) AS roc_auc, n AS support, 0.0::DOUBLE AS loss FROM sums
""")
def any_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification reports per language, written as nested JSON, flattened without a schema; a missing number is 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("guess", (F.col("n_chars") > 900).cast("int"))
    auc = roc_auc(rows, "quality", "n_chars", by=["lang"])
    shares = rows.groupBy("lang").agg(F.avg((F.col("quality") == F.col("guess")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    score = F.struct("accuracy", F.col("roc_auc").alias("roc-auc"), F.lit(None).cast("double").alias("loss"))
    report = F.struct("lang", F.struct(F.struct(score.alias("scores"), F.array("n").alias("support")).alias("test")).alias("metrics"))
    path = fresh_path(spark, "json")
    texts = null_safe_join(shares, auc, ["lang"]).select("lang", F.to_json(report, {"ignoreNullFields": "false"}).alias("value"))
    texts.withColumn("of", F.col("lang")).drop("lang").repartition("of").write.partitionBy("of").text(path)
    leaves = flatten_reports(spark, f"{path}/*/*.txt")
    wide = leaves.groupBy("file").agg(
        F.max(F.when(F.col("path") == "lang", F.col("value"))).alias("lang"),
        *[F.max(F.when(F.col("path") == p, F.col("number"))).alias(n) for n, p in (
            ("accuracy", "metrics.test.scores.accuracy"), ("roc_auc", "metrics.test.scores.roc-auc"), ("support", "metrics.test.support.0"),
            ("loss", "metrics.test.scores.loss"))],
    )
    return wide.select("lang", F.round("accuracy", 8).alias("accuracy"), F.round("roc_auc", 8).alias("roc_auc"), F.col("support").cast("bigint").alias("support"), "loss")
