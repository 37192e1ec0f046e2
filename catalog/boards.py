"""Ensembles and leaderboards over runs derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import query, table
from timetab.plans.leaderboard import (
    ensemble_mean, group_stats, pairwise_range, pairwise_test, rank_summary, score_matrix, score_table, tested_rank, tolerance_rank,
    uplift, uplift_summary,
)
from timetab.session import fresh_path
from timetab.sources.runs import load_predictions, save_predictions

YEARS = [str(y) for y in range(1994, 2004)]  # every ship year there is
REGRESSION = ["1996", "1997"]
MODELS = ["A-F", "A-O", "N-F", "N-O", "R-F", "R-O"]
BASELINE = "N-O"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up benchmark: model = return flag and status, dataset = ship year, seed = line number, score = mean discount."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_shipdate", "l_linenumber", "l_discount")
    year = F.year("l_shipdate").cast("string")
    mean = F.avg(F.col("l_discount") * 100)
    return lines.groupBy(
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("model"), year.alias("dataset"), F.col("l_linenumber").alias("seed")
    ).agg(mean.alias("raw")).select(
        "model", "dataset", "seed", F.when(F.col("dataset").isin(REGRESSION), -F.col("raw")).otherwise(F.col("raw")).alias("score")
    )


RUNS_SQL = f"""
    runs AS (
        SELECT model, dataset, seed, CASE WHEN dataset IN ('1996', '1997') THEN -raw ELSE raw END AS score FROM (
            SELECT l_returnflag || '-' || l_linestatus AS model, year(l_shipdate)::VARCHAR AS dataset, l_linenumber AS seed,
                   avg(l_discount * 100) AS raw
            FROM lineitem GROUP BY 1, 2, 3
        )
    ),
    stats AS (SELECT model, dataset, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS std FROM runs GROUP BY ALL)
"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = runs(spark, sf_dir)
    return group_stats(score_table(logged.unionByName(logged.where("seed = 1")), MODELS))


@query(f"WITH {RUNS_SQL} SELECT model, dataset, n, round(mean, 8) AS mean, round(std, 8) AS std FROM stats")
def board_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, mean and std per model and dataset, runs that were logged twice counted once."""
    return _stats(spark, sf_dir).select("model", "dataset", "n", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


@query(f"""
    WITH {RUNS_SQL}
    SELECT model, {", ".join(
        f"round({'-' if y in REGRESSION else ''}max(mean) FILTER (WHERE dataset = '{y}'), 8) AS y{y}_mean, "
        f"round(max(std) FILTER (WHERE dataset = '{y}'), 8) AS y{y}_std" for y in YEARS)}
    FROM stats GROUP BY model
""")
def board_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per model, mean and std per dataset, errors shown positive."""
    wide = score_matrix(runs(spark, sf_dir), YEARS, REGRESSION)
    return wide.select("model", *[F.round(f"{y}_{s}", 8).alias(f"y{y}_{s}") for y in YEARS for s in ("mean", "std")])


RANK_SQL = f"""
    {RUNS_SQL},
    ordered AS (
        SELECT dataset, model, mean, coalesce(std, 'inf'::DOUBLE) AS std,
               row_number() OVER (PARTITION BY dataset ORDER BY mean DESC, model) AS pos FROM stats
    ),
    walk AS (
        SELECT dataset, model, pos, 1 AS rank, mean AS lead_mean, std AS lead_std FROM ordered WHERE pos = 1
        UNION ALL
        SELECT o.dataset, o.model, o.pos, w.rank + (w.lead_mean - o.mean > w.lead_std)::INT,
               CASE WHEN w.lead_mean - o.mean > w.lead_std THEN o.mean ELSE w.lead_mean END,
               CASE WHEN w.lead_mean - o.mean > w.lead_std THEN o.std ELSE w.lead_std END
        FROM walk w JOIN ordered o ON o.dataset = w.dataset AND o.pos = w.pos + 1
    )
"""


@query(f"WITH RECURSIVE {RANK_SQL} SELECT dataset, model, rank::BIGINT AS rank FROM walk")
def board_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models within one std of the rank's leader share its rank."""
    return tolerance_rank(_stats(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""
    WITH RECURSIVE {RANK_SQL}
    SELECT model, round(avg(rank), 8) AS rank_mean, round(stddev_pop(rank), 8) AS rank_std, count(*) AS datasets FROM walk GROUP BY model
""")
def board_rank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population std of the rank over datasets."""
    out = rank_summary(tolerance_rank(_stats(spark, sf_dir)))
    return out.select("model", F.round("rank_mean", 8).alias("rank_mean"), F.round("rank_std", 8).alias("rank_std"), "datasets")


UPLIFT_SQL = f"""
    {RUNS_SQL},
    up AS (
        SELECT s.model, s.dataset, CASE WHEN s.dataset IN ('1996', '1997') THEN -1 ELSE 1 END * (s.mean - b.mean) / b.mean * 100 AS uplift
        FROM stats s JOIN stats b ON s.dataset = b.dataset AND b.model = '{BASELINE}'
    )
"""


def _uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uplift(_stats(spark, sf_dir), BASELINE, [y for y in YEARS if y not in REGRESSION])


@query(f"WITH {UPLIFT_SQL} SELECT model, dataset, round(uplift, 7) AS uplift FROM up")
def board_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent change over the baseline model."""
    return _uplift(spark, sf_dir).withColumn("uplift", F.round("uplift", 7))


@query(f"""
    WITH {UPLIFT_SQL}
    SELECT model, round(median(uplift), 7) AS median, round(min(uplift), 7) AS min, round(max(uplift), 7) AS max FROM up GROUP BY model
""")
def board_uplift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, smallest and largest uplift per model."""
    return uplift_summary(_uplift(spark, sf_dir)).select("model", *[F.round(c, 7).alias(c) for c in ("median", "min", "max")])


@query(f"""
    WITH {RUNS_SQL},
    pooled AS (SELECT dataset, count(*) AS groups, sum(n) - count(*) AS freedom, sum((n - 1) * coalesce(std, 0) ** 2) AS within FROM stats GROUP BY dataset)
    SELECT a.dataset, a.model AS model_a, b.model AS model_b, groups, freedom::BIGINT AS freedom,
           round(abs(a.mean - b.mean) / sqrt(within / freedom / 2 * (1.0 / a.n + 1.0 / b.n)), 6) AS q
    FROM stats a JOIN stats b ON a.dataset = b.dataset AND a.model <> b.model JOIN pooled p ON p.dataset = a.dataset
    WHERE freedom > 0 AND within > 0
""")
def board_pair_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studentised range of every pair of models per dataset."""
    return pairwise_range(_stats(spark, sf_dir)).select("dataset", "model_a", "model_b", "groups", "freedom", F.round("q", 6).alias("q"))


_TWO_SQL = """
    two AS (
        SELECT model, dataset, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS std FROM (
            SELECT l_linestatus AS model, year(l_shipdate)::VARCHAR AS dataset, l_linenumber % 2 AS seed, avg(l_discount * 100) AS score
            FROM lineitem GROUP BY ALL
        ) GROUP BY ALL
    ),
    pooled AS (SELECT dataset, sum((n - 1) * std ** 2) / 2 AS within FROM two GROUP BY dataset HAVING count(*) = 2 AND sum(n) = 4 AND sum((n - 1) * std ** 2) > 0),
    tested AS (
        SELECT a.dataset, a.model AS model_a, b.model AS model_b, abs(a.mean - b.mean) / sqrt(within / 2) AS q
        FROM two a JOIN two b ON a.dataset = b.dataset AND a.model <> b.model JOIN pooled p ON p.dataset = a.dataset
    ),
    valued AS (SELECT *, 1 - (q / sqrt(2)) / sqrt(q * q / 2 + 2) AS p_value FROM tested)
"""


def _two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models (line status) with two seeds each (odd and even line numbers): the range test is then a t-test with two
    degrees of freedom, which has a closed form."""
    lines = table(spark, sf_dir, "lineitem")
    scores = lines.groupBy(
        F.col("l_linestatus").alias("model"), F.year("l_shipdate").cast("string").alias("dataset"), (F.col("l_linenumber") % 2).alias("seed")
    ).agg(F.avg(F.col("l_discount") * 100).alias("score"))
    return group_stats(score_table(scores))


@query(f"WITH {_TWO_SQL} SELECT dataset, model_a, model_b, round(q, 6) AS q, round(p_value, 3) AS p_value FROM valued")
def board_pair_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The p-value of every pair."""
    return pairwise_test(_two_models(spark, sf_dir)).withColumns({"q": F.round("q", 6), "p_value": F.round("p_value", 3)})


@query(f"""
    WITH {_TWO_SQL}, best AS (SELECT dataset, model, row_number() OVER (PARTITION BY dataset ORDER BY mean DESC, model) AS place FROM two)
    SELECT dataset, model, (CASE WHEN place > 1 AND coalesce(p_value < 0.4, FALSE) THEN 2 ELSE 1 END)::BIGINT AS rank
    FROM best LEFT JOIN valued ON valued.dataset = best.dataset AND model_a = model
""".replace("SELECT dataset, model, (CASE", "SELECT best.dataset, model, (CASE"))
def board_tested_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks that rise where a model differs significantly from the rank's leader; the level is loose for so few seeds."""
    return tested_rank(_two_models(spark, sf_dir), alpha=0.4).select("dataset", "model", F.col("rank").cast("bigint").alias("rank"))


@query("""
    WITH preds AS (
        SELECT o_orderstatus AS model, o_orderkey AS row_id, s AS seed, o_totalprice * (100 + s) / 100 AS prediction,
               CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'test' END AS part
        FROM orders, range(11) r(s) WHERE NOT (o_orderstatus = 'P' AND s = 7)
    )
    SELECT model, part, row_id, (seed // 5)::BIGINT AS ensemble, round(avg(prediction), 4) AS prediction
    FROM preds GROUP BY ALL HAVING count(*) = 5
""")
def ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prediction of five seeds each; seeds 10 and a model with a missing seed give no ensemble. Stored and read back."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    part = F.when(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"), "train").otherwise("test")
    logged = orders.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(10)))).where(
        ~((F.col("o_orderstatus") == "P") & (F.col("seed") == 7))
    ).select(
        F.col("o_orderstatus").alias("model"), F.lit("orders").alias("dataset"), F.lit("default").alias("split"), "seed",
        part.alias("part"), F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") * (100 + F.col("seed")) / 100).alias("prediction"),
    )
    path = fresh_path(spark, "predictions")
    save_predictions(logged, path)
    stored = load_predictions(spark, path, dataset="orders")
    mean = ensemble_mean(stored, ["model", "dataset", "split", "part", "row_id"])
    return mean.select("model", "part", "row_id", F.col("ensemble").cast("bigint").alias("ensemble"), F.round("prediction", 4).alias("prediction"))
