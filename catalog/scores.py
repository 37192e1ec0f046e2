"""Regression, classification and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import query, table
from timetab.functions.probability import binary_label, class_label, sigmoid, softmax
from timetab.plans.metrics import (
    all_finite, binary_cross_entropy, classification_report, guarded_score, multiclass_cross_entropy, regression_metrics,
    roc_auc, signed_score,
)
from timetab.plans.models import evaluate


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    return lines.select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000.0 * (1.0 - F.col("l_discount"))).alias("prediction"),
        F.col("l_returnflag").alias("part"), F.col("l_linestatus").alias("status"),
    )


_PRICES_SQL = """
    p AS (SELECT l_extendedprice AS y, l_quantity * 2000.0 * (1.0 - l_discount) AS prediction, l_returnflag AS part,
                 l_linestatus AS status FROM lineitem),
    m AS (
        SELECT part, sqrt(avg(pow(y - prediction, 2))) AS rmse, avg(abs(y - prediction)) AS mae,
               1 - sum(pow(y - prediction, 2)) / (count(*) * var_pop(y)) AS r2
        FROM p GROUP BY part
    )
"""


@query(f"WITH {_PRICES_SQL} SELECT part, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 8) AS r2 FROM m")
def regression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE, MAE and R² of a price guess per return flag."""
    out = regression_metrics(_prices(spark, sf_dir), by=["part"])
    return out.select("part", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 8).alias("r2"))


@query(f"WITH {_PRICES_SQL} SELECT part, -round(rmse, 4) AS rmse, -round(mae, 4) AS mae, round(r2, 8) AS r2 FROM m")
def signed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every score turned so that higher is better."""
    out = regression_metrics(_prices(spark, sf_dir), by=["part"])
    digits = {"rmse": 4, "mae": 4, "r2": 8}
    return out.select("part", *[F.round(signed_score(m, m), d).alias(m) for m, d in digits.items()])


@query(f"""
    WITH {_PRICES_SQL}, bad AS (SELECT part, status, y, CASE WHEN part = 'R' AND y > 90000 THEN 'inf'::DOUBLE ELSE prediction END AS prediction FROM p)
    SELECT part, status, bool_and(isfinite(prediction)) AS valid,
           CASE WHEN bool_and(isfinite(prediction)) THEN -round(avg(abs(y - prediction)), 4) ELSE -999999.0 END AS score
    FROM bad GROUP BY part, status
""")
def valid_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that fall to a fixed low value where a prediction is not finite."""
    rows = _prices(spark, sf_dir).withColumn(
        "prediction", F.when((F.col("part") == "R") & (F.col("y") > 90000), F.lit(float("inf"))).otherwise(F.col("prediction"))
    )
    error = F.round(F.avg(F.abs(F.col("y") - F.col("prediction"))), 4)
    return rows.groupBy("part", "status").agg(
        all_finite("prediction").alias("valid"), guarded_score(signed_score("mae", error), "prediction").alias("score")
    )


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    joined = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return joined.withColumn("p", sigmoid((F.col("n_chars") - 900.0) / 400.0))


_QUALITY_SQL = """
    q AS (
        SELECT doc_id, lang, n_chars, quality, toxic, 1 / (1 + exp(-((n_chars - 900.0::DOUBLE) / 400.0::DOUBLE))) AS p
        FROM labels JOIN documents USING (doc_id)
    )
"""


def _report_sql(source: str) -> str:
    """``source`` is a table of (t, p) with true and predicted class."""
    return f"""
        classes AS (SELECT DISTINCT t AS cls FROM {source} UNION SELECT DISTINCT p FROM {source}),
        c AS (
            SELECT cls, count(*) FILTER (WHERE t = cls AND p = cls) AS hit, count(*) FILTER (WHERE t = cls) AS support,
                   count(*) FILTER (WHERE p = cls) AS guessed
            FROM classes, {source} GROUP BY cls
        ),
        r AS (
            SELECT cls, support, hit, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0 END AS precision,
                   CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM c
        ),
        f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r),
        rep AS (
            SELECT cls::VARCHAR AS "row", precision, recall, f1, support FROM f UNION ALL
            SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f UNION ALL
            SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM f UNION ALL
            SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM f
        )
        SELECT "row", round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, support::BIGINT AS support FROM rep
    """


def _rounded(report: DataFrame) -> DataFrame:
    return report.select("row", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {_QUALITY_SQL}, s AS (SELECT quality::BIGINT AS t, round_even(p, 0)::BIGINT AS p FROM q), {_report_sql('s')}")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification report of a length-based guess of document quality."""
    rows = _quality(spark, sf_dir).withColumn("label", binary_label("p"))
    return _rounded(classification_report(rows, "quality", "label"))


_LOGITS_SQL = """
    v AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    means AS (SELECT label AS c, i, avg(x) AS m FROM v GROUP BY ALL),
    gap AS (SELECT vec_id, label, c, sum(pow(x - m, 2)) AS d FROM v JOIN means USING (i) GROUP BY ALL),
    e AS (SELECT label, list(-d ORDER BY c) AS z FROM gap GROUP BY vec_id, label)
"""


@query("""
    WITH """ + _LOGITS_SQL + """,
         s AS (SELECT label::BIGINT AS t, (list_position(z, list_max(z)) - 1)::BIGINT AS p FROM e),
""" + _report_sql("s"))
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification report over ten classes, with the nearness to the mean vector of each class as logits."""
    return _rounded(classification_report(_logits(spark, sf_dir).withColumn("guess", class_label("probabilities")), "label", "guess"))


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten logits per vector: minus the squared distance to the mean vector of each label."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    means = v.groupBy(F.col("label").alias("c"), "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    gap = v.join(means, "i").groupBy("vec_id", "label", "c").agg(F.sum(F.pow(F.col("x").cast("double") - F.col("m"), 2)).alias("d"))
    rows = gap.groupBy("vec_id", "label").agg(F.array_sort(F.collect_list(F.struct("c", (-F.col("d")).alias("z")))).alias("a"))
    return rows.select("label", F.transform("a", lambda e: e["z"]).alias("z")).withColumn("probabilities", softmax("z"))


@query(f"""
    WITH {_LOGITS_SQL}
    SELECT round(avg(-(z[label + 1] - list_max(z) - ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))))), 8) AS cross_entropy FROM e
""")
def class_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy of those probabilities."""
    out = multiclass_cross_entropy(_logits(spark, sf_dir), "label", "probabilities")
    return out.select(F.round("cross_entropy", 8).alias("cross_entropy"))


@query(f"""
    WITH {_QUALITY_SQL}, c AS (SELECT *, least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS pc FROM q)
    SELECT lang, round(avg(CASE WHEN quality = 1 THEN -ln(pc) ELSE -ln(1 - pc) END), 7) AS cross_entropy FROM c GROUP BY lang
""")
def quality_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy of the quality guess per language."""
    out = binary_cross_entropy(_quality(spark, sf_dir), "quality", "p", by=["lang"])
    return out.select("lang", F.round("cross_entropy", 7).alias("cross_entropy"))


def _auc_sql(source: str, by: str) -> str:
    return f"""
        ranked AS (SELECT {by}, y, rank() OVER (PARTITION BY {by} ORDER BY s) + (count(*) OVER (PARTITION BY {by}, s) - 1) / 2.0 AS r FROM {source}),
        sums AS (SELECT {by}, sum(r) FILTER (WHERE y = 1) AS rs, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n
                 FROM ranked GROUP BY {by})
        SELECT {by}, CASE WHEN p > 0 AND n > 0 THEN round((rs - p * (p + 1) / 2.0) / (p * n::DOUBLE), 8) END AS roc_auc FROM sums
    """


@query(f"WITH {_QUALITY_SQL}, src AS (SELECT lang, quality AS y, n_chars AS s FROM q), {_auc_sql('src', 'lang')}")
def quality_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well document length ranks quality, per language."""
    out = roc_auc(_quality(spark, sf_dir), "quality", "n_chars", by=["lang"])
    return out.select("lang", F.round("roc_auc", 8).alias("roc_auc"))


@query(f"""
    WITH src AS (SELECT l_linestatus, (l_returnflag = 'R')::INT AS y, l_discount * 100 + l_tax AS s FROM lineitem), {_auc_sql('src', 'l_linestatus')}
""")
def returns_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well discount and tax rank returned lines; scores repeat a lot."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 100 + F.col("l_tax")).alias("score")
    )
    return roc_auc(rows, by=["l_linestatus"]).select("l_linestatus", F.round("roc_auc", 8).alias("roc_auc"))


_PARTS_SQL = """
    r AS (
        SELECT nullif(l_linenumber, 3) AS part, (l_returnflag = 'R')::BIGINT AS y,
               CASE WHEN l_linenumber = 5 AND l_quantity = 50 THEN 'nan'::DOUBLE ELSE l_discount * 10 END AS p,
               CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c, l_discount * 10 AS x, l_tax * 10 AS z
        FROM lineitem
    ),
    failed AS (SELECT part, NOT bool_and(isfinite(p)) AS bad FROM r GROUP BY part),
    ranked AS (SELECT part, y, rank() OVER (PARTITION BY part ORDER BY p) + (count(*) OVER (PARTITION BY part, p) - 1) / 2.0 AS k FROM r),
    auc AS (
        SELECT part, (sum(k) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
                     / (count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 0))::DOUBLE) AS v
        FROM ranked GROUP BY part
    ),
    many AS (
        SELECT part, avg((CASE WHEN a[1] >= a[2] AND a[1] >= a[3] THEN 0 WHEN a[2] >= a[3] THEN 1 ELSE 2 END = c)::INT) AS v
        FROM (SELECT part, c, [x, z, 1.5 - x - z] AS a FROM r) GROUP BY part
    )
"""


@query(f"""
    WITH {_PARTS_SQL}
    SELECT 'binclass' AS task, auc.part, CASE WHEN bad THEN -999999.0 ELSE round(v, 8) END AS score
    FROM auc JOIN failed ON auc.part IS NOT DISTINCT FROM failed.part
    UNION ALL SELECT 'regression', part, CASE WHEN NOT bool_and(isfinite(p)) THEN -999999.0 ELSE -round(avg(abs(y - p)), 8) END FROM r GROUP BY part
    UNION ALL SELECT 'multiclass', part, round(v, 8) FROM many
""")
def scores_of_all_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three tasks per part: rows without a part are one, and a prediction that is no number fails its part."""
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    part = F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("part")
    broken = (F.col("l_linenumber") == 5) & (F.col("l_quantity") == 50)
    x, z = F.col("l_discount").cast("double") * 10, F.col("l_tax").cast("double") * 10
    one = lines.select(part, (F.col("l_returnflag") == "R").cast("long").alias("y"), F.when(broken, F.lit(float("nan"))).otherwise(x).alias("prediction"))
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    many = lines.select(part, code.cast("long").alias("y"), F.array(x, z, 1.5 - x - z).alias("prediction"))
    found = [("binclass", one, "roc-auc"), ("regression", one, "mae"), ("multiclass", many, "accuracy")]
    out = [evaluate(rows, task, score).select(F.lit(task).alias("task"), "part", F.round("score", 8).alias("score")) for task, rows, score in found]
    return out[0].unionByName(out[1]).unionByName(out[2])
