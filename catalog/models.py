"""MLlib baselines on whole tables: with features so plain that each model has a closed form to be checked against, and as
``*_whole`` with all features and real sizes, which SQL cannot repeat."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import query, table
from catalog.encoders import EVENT_SHARES_SQL
from timetab.operators.encoding import encode_vocabulary, fit_vocabulary
from timetab.operators.scaling import assemble, fit_quantiles, mean_and_std, scale_quantile, scale_standard
from timetab.plans.boosting import fit_histogram
from timetab.plans.leaderboard import ensemble_mean
from timetab.plans.metrics import all_scores, regression_metrics
from timetab.plans.models import draw, evaluate, fit, importances, over_seeds, predict, search
from timetab.session import materialise

_PART = """CASE WHEN l_shipdate < TIMESTAMP_NTZ '1999-01-01' THEN 'train' WHEN l_shipdate < TIMESTAMP_NTZ '2000-01-01' THEN 'val' ELSE 'test' END"""
_LINES_SQL = """
    d AS (SELECT l_quantity AS x, (l_quantity > 25)::INT AS b, l_extendedprice / 1000 AS y,
                 CASE WHEN l_extendedprice > 70000 THEN 2 WHEN l_quantity > 25 THEN 1 ELSE 0 END AS c,
                 (CASE WHEN l_quantity > 25 THEN l_extendedprice > 20000 ELSE l_extendedprice > 80000 END)::INT AS t,
                 CASE WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN 'train' WHEN l_shipdate < TIMESTAMP '2000-01-01' THEN 'val' ELSE 'test' END AS part
          FROM lineitem),
    means AS (SELECT b, avg(y) AS p FROM d WHERE part = 'train' GROUP BY b)
"""
_GROUP_MEANS_SQL = f"WITH {_LINES_SQL} SELECT part, round(-sqrt(avg(pow(y - p, 2))), 4) AS score FROM d JOIN means USING (b) GROUP BY part"
#: One tree of depth one on a two-valued feature predicts the two group means, and further rounds have nothing left to learn.
_SPLIT = {"depth": 1}
_TREE = {"trees": 1, "bootstrap": False, **_SPLIT}


def _line_data(spark: SparkSession, sf_dir: str, features: list[str], y: str = "l_extendedprice / 1000") -> DataFrame:
    """Lines with their features as a vector. Stored, so that a row's number is its id in every use."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.monotonically_increasing_id().alias("row_id"), F.expr(_PART).alias("part"), F.col("l_quantity").cast("double").alias("x"),
        (F.col("l_quantity") > 25).cast("double").alias("b"), F.lit(1.0).alias("one"), F.expr(y).cast("double").alias("y"),
    )
    return materialise(assemble(lines, features).select("row_id", "part", "y", "features"), "lines")


def _scores(spark: SparkSession, sf_dir: str, model: str, params: dict, features: list[str]) -> DataFrame:
    data = _line_data(spark, sf_dir, features)
    out = evaluate(predict(fit(model, data, "regression", params), data, "regression"), "regression")
    return out.select("part", F.round("score", 4).alias("score"))


def _net_sql(reg: float, l1_share: float) -> str:
    """Coefficients of the elastic net on one feature: the shrunk slope on scaled feature and label, and its intercept."""
    return f"""
        SELECT sign(c) * greatest(abs(c) - {reg!r} * {l1_share!r} / sy, 0) / (v + {reg!r} * (1 - {l1_share!r}) / sy) * sy / sx AS w, mx, my
        FROM (SELECT covar_pop(y, x) / (stddev_samp(x) * stddev_samp(y)) AS c, var_pop(x) / var_samp(x) AS v, stddev_samp(x) AS sx,
                     stddev_samp(y) AS sy, avg(x) AS mx, avg(y) AS my FROM d WHERE part = 'train')
    """


@query("""
    WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y, CASE WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN 'train'
                      WHEN l_shipdate < TIMESTAMP '2000-01-01' THEN 'val' ELSE 'test' END AS part FROM lineitem),
         f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d WHERE part = 'train')
    SELECT part, round(-sqrt(avg(pow(y - a - b * x, 2))), 2) AS score FROM d, f GROUP BY part
""")
def linear_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of price on quantity, scored per part."""
    data = _line_data(spark, sf_dir, ["x"], "l_extendedprice")
    out = evaluate(predict(fit("linear", data, "regression", {}), data, "regression"), "regression")
    return out.select("part", F.round("score", 2).alias("score"))


@query(f"""
    WITH {_LINES_SQL}, f AS ({_net_sql(2.0, 0.5)})
    SELECT part, round(-sqrt(avg(pow(y - my - w * (x - mx), 2))), 4) AS score FROM d, f GROUP BY part
""")
def linear_elastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elastic net of price on quantity, signed RMSE per part."""
    return _scores(spark, sf_dir, "linear", {"reg": 2.0, "l1_share": 0.5, "max_iter": 200}, ["x"])


@query(_GROUP_MEANS_SQL)
def forest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of one tree with one split, signed RMSE per part."""
    return _scores(spark, sf_dir, "forest", _TREE, ["b"])


@query(_GROUP_MEANS_SQL)
def boosted_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees with one split each that are cut on validation, signed RMSE per part."""
    return _scores(spark, sf_dir, "boosted", {"rounds": 4, **_SPLIT}, ["b"])


@query("SELECT * FROM (VALUES ('large', 1.0::DOUBLE), ('one', 0.0::DOUBLE)) v(feature, importance)")
def boosted_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature importances of a boosted model, one of whose two features is constant."""
    model = fit("boosted", _line_data(spark, sf_dir, ["b", "one"]), "regression", {"rounds": 3, **_SPLIT})
    return importances(model, ["large", "one"])


_SPACE = {"reg": ["loguniform", 1e-2, 10.0], "l1_share": ["?uniform", 0.0, 0.0, 1.0], "max_iter": 200}
_TRIALS = 3


def _trials_sql() -> str:
    rng = random.Random(0)
    trials = []
    for i in range(_TRIALS):
        p = draw(_SPACE, rng)
        trials.append(f"""
            SELECT {i} AS trial, {p["reg"]!r}::DOUBLE AS reg, {float(p["l1_share"])!r}::DOUBLE AS l1_share,
                   round(-sqrt(avg(pow(y - my - w * (x - mx), 2))), 4) AS score FROM d, ({_net_sql(p["reg"], float(p["l1_share"]))}) WHERE part = 'val'
        """)
    return f"""
        WITH {_LINES_SQL}, t AS ({" UNION ALL ".join(trials)})
        SELECT trial, round(reg, 8) AS reg, round(l1_share, 8) AS l1_share, score, score = max(score) OVER () AS chosen FROM t
    """


@query(_trials_sql())
def tuned_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random search over the elastic net, one row per trial with its validation score."""
    best, trials = search("linear", _line_data(spark, sf_dir, ["x"]), "regression", _SPACE, trials=_TRIALS)
    rows = [(t["trial"], t["params"]["reg"], float(t["params"]["l1_share"]), t["score"], t["params"] == best) for t in trials]
    out = spark.createDataFrame(rows, "trial int, reg double, l1_share double, score double, chosen boolean")
    return out.withColumns({"reg": F.round("reg", 8), "l1_share": F.round("l1_share", 8), "score": F.round("score", 4)})


@query(f"""
    WITH {_LINES_SQL}, r AS (SELECT part, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse FROM d JOIN means USING (b) GROUP BY part)
    SELECT run, part, rmse FROM r, (SELECT unnest(['0', '1', '2', '3', '4', 'ensemble']) AS run)
""")
def seeds_and_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-split forest refitted over five seeds; RMSE of each seed and of their ensemble on every part."""
    data = _line_data(spark, sf_dir, ["b"])
    runs = materialise(over_seeds("forest", data, "regression", _TREE, range(5), "lines"), "runs")
    single = regression_metrics(runs, by=["seed", "part"]).select(F.col("seed").cast("string").alias("run"), "part", "rmse")
    mean = ensemble_mean(runs, ["model", "dataset", "split", "part", "row_id", "y"])
    both = regression_metrics(mean, by=["part"]).select(F.lit("ensemble").alias("run"), "part", "rmse")
    return single.unionByName(both).withColumn("rmse", F.round("rmse", 4))


@query(f"""
    WITH {EVENT_SHARES_SQL}, d AS (
        SELECT p AS x, user_id / 1000.0::DOUBLE AS y, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' WHEN ts < TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END AS part
        FROM share JOIN events USING (event_id)
    ), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d WHERE part = 'train')
    SELECT part, round(-sqrt(avg(pow(y - a - b * x, 2))), 5) AS score FROM d, f GROUP BY part
""")
def quantile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares on a quantile-scaled feature, signed RMSE per part."""
    ts = F.col("ts")
    part = F.when(ts < F.lit("2024-01-20").cast("timestamp_ntz"), "train").when(ts < F.lit("2024-01-25").cast("timestamp_ntz"), "val").otherwise("test")
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), part.alias("part"), "value", (F.col("user_id") / 1000.0).alias("y")
    )
    fitted = fit_quantiles(events.where("part = 'train'"), ["value"])
    data = assemble(scale_quantile(events, fitted, output="uniform"), ["value"])
    out = evaluate(predict(fit("linear", data, "regression", {}), data, "regression"), "regression")
    return out.select("part", F.round("score", 5).alias("score"))


NUMERIC = ["l_quantity", "l_discount", "l_tax", "month"]


def _numeric_lines(spark: SparkSession, sf_dir: str, y: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.monotonically_increasing_id().alias("row_id"), F.expr(_PART).alias("part"), "l_quantity", "l_discount", "l_tax",
        F.month("l_shipdate").cast("double").alias("month"), "l_returnflag", F.expr(y).cast("double").alias("y"),
    )


def _whole_data(spark: SparkSession, sf_dir: str, task: str = "regression") -> DataFrame:
    """Lines with scaled numbers and one-hot flags; the target is the price, or whether the line is dear."""
    lines = _numeric_lines(spark, sf_dir, "l_extendedprice / 1000" if task == "regression" else "l_extendedprice > 40000")
    train = lines.where("part = 'train'")
    codes = fit_vocabulary(train, ["l_returnflag"])
    scaled = scale_standard(encode_vocabulary(lines, codes), mean_and_std(train, NUMERIC))
    return materialise(assemble(scaled, NUMERIC, codes=codes.sizes).select("row_id", "part", "y", "features"), "lines")


def _whole_scores(spark: SparkSession, sf_dir: str, model: str, task: str, params: dict, score: str | None = None) -> DataFrame:
    data = _whole_data(spark, sf_dir, task)
    return evaluate(predict(fit(model, data, task, params), data, task), task, score)


@query()
def linear_elastic_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elastic-net logistic regression on all features, ROC-AUC per part."""
    return _whole_scores(spark, sf_dir, "linear", "binclass", {"reg": 0.01, "l1_share": 0.5}, "roc-auc")


@query()
def forest_price_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random forest on the price, signed RMSE per part."""
    return _whole_scores(spark, sf_dir, "forest", "regression", {"trees": 10, "depth": 5})


@query()
def boosted_price_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees that are cut on validation, signed RMSE per part."""
    return _whole_scores(spark, sf_dir, "boosted", "regression", {"rounds": 5, "depth": 4})


@query()
def boosted_importance_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importances of all features of a boosted model."""
    model = fit("boosted", _whole_data(spark, sf_dir), "regression", {"rounds": 3, "depth": 4})
    return importances(model, [*NUMERIC, "flag_0", "flag_1", "flag_2"])


@query()
def tuned_linear_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random search over the elastic net on all features, one row per trial with its validation score."""
    space = {"reg": ["loguniform", 1e-4, 1.0], "l1_share": ["?uniform", 0.0, 0.0, 1.0], "max_iter": 50}
    best, trials = search("linear", _whole_data(spark, sf_dir), "regression", space, trials=_TRIALS)
    rows = [(t["trial"], t["params"]["reg"], float(t["params"]["l1_share"]), t["score"], t["params"] == best) for t in trials]
    return spark.createDataFrame(rows, "trial int, reg double, l1_share double, score double, chosen boolean")


@query()
def seeds_and_ensemble_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest refitted over five seeds; RMSE of each seed and of their ensemble on every part."""
    data = _whole_data(spark, sf_dir)
    runs = materialise(over_seeds("forest", data, "regression", {"trees": 3, "depth": 4}, range(5), "lines"), "runs")
    single = regression_metrics(runs, by=["seed", "part"]).select(F.col("seed").cast("string").alias("run"), "part", "rmse")
    mean = ensemble_mean(runs, ["model", "dataset", "split", "part", "row_id", "y"])
    both = regression_metrics(mean, by=["part"]).select(F.lit("ensemble").alias("run"), "part", "rmse")
    return single.unionByName(both)


@query()
def quantile_linear_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear baseline on quantile-normalised features with noise, signed RMSE per part."""
    lines = materialise(_numeric_lines(spark, sf_dir, "l_extendedprice / 1000"), "lines")
    fitted = fit_quantiles(lines.where("part = 'train'"), NUMERIC, noise="fixed")
    data = materialise(assemble(scale_quantile(lines, fitted), NUMERIC).select("row_id", "part", "y", "features"), "scaled")
    return evaluate(predict(fit("linear", data, "regression", {"reg": 0.001}), data, "regression"), "regression")


def _tree_sql(classes: str, where: str) -> str:
    return f"p AS (SELECT b, {classes} FROM d WHERE {where} GROUP BY b)"


@query(f"""
    WITH {_LINES_SQL}, {_tree_sql("avg(t) AS p", "part = 'train'")},
    s AS (SELECT part, t AS y, p FROM d JOIN p USING (b)),
    auc AS (
        SELECT part, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
               / (count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 0))::DOUBLE) AS a
        FROM (SELECT part, y, rank() OVER (PARTITION BY part ORDER BY p) + (count(*) OVER (PARTITION BY part, p) - 1) / 2.0 AS r FROM s) GROUP BY part
    ),
    c AS (SELECT *, least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS q FROM s)
    SELECT part, round(avg((round_even(p, 0) = y)::INT), 6) AS accuracy, round(avg(CASE WHEN y = 1 THEN -ln(q) ELSE -ln(1 - q) END), 6) AS cross_entropy,
           round(any_value(a), 6) AS roc_auc
    FROM c JOIN auc USING (part) GROUP BY part
""")
def scores_two_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of a stored two-class prediction table: a one-split tree's share of dear lines."""
    data = _line_data(spark, sf_dir, ["b"], "IF(IF(l_quantity > 25, l_extendedprice > 20000, l_extendedprice > 80000), 1, 0)")
    stored = materialise(predict(fit("forest", data, "binclass", _TREE), data, "binclass"), "predictions")
    out = all_scores(stored, "binclass", ["part"])
    return out.select("part", F.round("accuracy", 6).alias("accuracy"), F.round("cross-entropy", 6).alias("cross_entropy"), F.round("roc-auc", 6).alias("roc_auc"))


@query(f"""
    WITH {_LINES_SQL}, {_tree_sql("[avg((c = 0)::INT), avg((c = 1)::INT), avg((c = 2)::INT)] AS p", "part = 'train'")},
    s AS (SELECT part, c, p, least(greatest(p[c + 1], 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS q, list_position(p, list_max(p)) - 1 AS guess FROM d JOIN p USING (b))
    SELECT part, round(avg((guess = c)::INT), 6) AS accuracy, round(avg(-ln(q)), 6) AS cross_entropy FROM s GROUP BY part
""")
def scores_three_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of a stored three-class prediction table."""
    data = _line_data(spark, sf_dir, ["b"], "CASE WHEN l_extendedprice > 70000 THEN 2 WHEN l_quantity > 25 THEN 1 ELSE 0 END")
    stored = materialise(predict(fit("forest", data, "multiclass", _TREE), data, "multiclass"), "predictions")
    out = all_scores(stored, "multiclass", ["part"])
    return out.select("part", F.round("accuracy", 6).alias("accuracy"), F.round("cross-entropy", 6).alias("cross_entropy"))


@query(f"""
    WITH {_LINES_SQL},
    sums AS (SELECT b, k, count(*) AS n, count(*) FILTER (WHERE c = k) AS own FROM d, range(3) r(k) WHERE part = 'train' GROUP BY b, k),
    leaf AS (SELECT b, k, (own - n / 3.0::DOUBLE) / (n * 2 / 9.0::DOUBLE + 1) AS m FROM sums),
    shares AS (SELECT b, k, exp(m) / sum(exp(m)) OVER (PARTITION BY b) AS p FROM leaf)
    SELECT part, round(avg(ln(p)), 8) AS score FROM d JOIN shares ON d.b = shares.b AND d.c = shares.k GROUP BY part
""")
def boosted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of boosting for three classes, a tree with one split each; signed cross-entropy per part."""
    data = _line_data(spark, sf_dir, ["b"], "CASE WHEN l_extendedprice > 70000 THEN 2 WHEN l_quantity > 25 THEN 1 ELSE 0 END")
    model = fit("histogram", data, "multiclass", {"rounds": 1, "depth": 1, "rate": 1.0, "l2": 1.0})
    return evaluate(predict(model, data, "multiclass"), "multiclass", "cross-entropy").select("part", F.round("score", 8).alias("score"))


@query()
def boosted_early_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees from histograms on all features, stopped where validation no longer gains; signed RMSE per part."""
    return _whole_scores(spark, sf_dir, "histogram", "regression", {"rounds": 100, "depth": 4, "rate": 0.5, "patience": 2})


@query()
def boosted_classes_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the three return flags, accuracy per part."""
    lines = _numeric_lines(spark, sf_dir, "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END")
    scaled = scale_standard(lines, mean_and_std(lines.where("part = 'train'"), NUMERIC))
    data = materialise(assemble(scaled, NUMERIC).select("row_id", "part", "y", "features"), "lines")
    model = fit("histogram", data, "multiclass", {"rounds": 100, "depth": 3, "rate": 0.5, "patience": 1, "bins": 32})
    return evaluate(predict(model, data, "multiclass"), "multiclass")


@query("""
    WITH d AS (SELECT (l_quantity > 25)::INT AS a, (l_discount > 0.05)::INT AS b, l_extendedprice / 1000 AS y FROM lineitem
               WHERE l_shipdate < TIMESTAMP '1999-01-01'),
    c AS (SELECT a, b, sum(m - y) AS g, count(*)::DOUBLE AS n FROM d, (SELECT avg(y) AS m FROM d) GROUP BY a, b),
    one AS (SELECT sum(pow(g, 2) / n) AS v FROM c),
    by_a AS (SELECT a, sum(g) AS g, sum(n) AS n FROM c GROUP BY a), by_b AS (SELECT b, sum(g) AS g, sum(n) AS n FROM c GROUP BY b),
    gains AS (SELECT (SELECT sum(pow(g, 2) / n) FROM by_a) AS ga, (SELECT sum(pow(g, 2) / n) FROM by_b) AS gb, v FROM one)
    SELECT 'large' AS feature, round(CASE WHEN ga >= gb THEN ga / v ELSE (v - gb) / v END, 8) AS importance FROM gains
    UNION ALL SELECT 'cheap', round(CASE WHEN ga >= gb THEN (v - ga) / v ELSE gb / v END, 8) FROM gains
""")
def gain_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature's share in the variance that a boosted tree of depth two explains."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.monotonically_increasing_id().alias("row_id"), F.expr(_PART).alias("part"), (F.col("l_quantity") > 25).cast("double").alias("a"),
        (F.col("l_discount") > 0.05).cast("double").alias("b"), (F.col("l_extendedprice") / 1000).cast("double").alias("y"),
    )
    data = materialise(assemble(lines, ["a", "b"]).select("row_id", "part", "y", "features"), "lines")
    model = fit_histogram(data.where("part = 'train'"), "regression", {"rounds": 1, "depth": 2, "rate": 1.0, "l2": 0.0})
    return importances(model, ["large", "cheap"]).withColumn("importance", F.round("importance", 8))
