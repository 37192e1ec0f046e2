"""Category codes and numeric scaling, fitted on the training part."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import query, table
from timetab.functions import probability as prob
from timetab.functions.columns import Roles
from timetab.operators.encoding import encode_frequent, encode_vocabulary, fit_frequent, fit_vocabulary, one_hot
from timetab.operators.scaling import (
    assemble as to_vector, fit_bins, fit_label, fit_quantiles, mean_and_std, piecewise_linear,
    scale_identity as to_finite, scale_quantile as to_quantile, scale_standard as to_standard,
)
from timetab.plans.dataset import build_dataset, cardinalities

TRAIN_END = "1999-01-01"


@query("""
    WITH d AS (SELECT doc_id, lang || '/' || source AS origin, CASE WHEN lang <> 'de' THEN lang END AS lang FROM documents),
         c AS (SELECT origin, count(*) AS n FROM d GROUP BY 1),
         f AS (SELECT origin, row_number() OVER (ORDER BY origin) - 1 AS code FROM c WHERE n >= 0.01 * (SELECT count(*) FROM d)),
         lc AS (SELECT lang, count(*) AS n FROM d WHERE lang IS NOT NULL GROUP BY 1),
         lf AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code FROM lc WHERE n >= 0.01 * (SELECT count(*) FROM d)),
         lk AS (SELECT (SELECT count(*) FROM lf) AS k, (SELECT count(*) > (SELECT count(*) FROM lf) FROM lc)::INT AS rare)
    SELECT doc_id, coalesce(f.code, (SELECT count(*) FROM f)) AS origin,
           CASE WHEN d.lang IS NULL THEN k + rare ELSE coalesce(lf.code, k) END AS lang
    FROM d LEFT JOIN f USING (origin) LEFT JOIN lf ON d.lang = lf.lang, lk
""")
def ordinal_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of document origins with rare ones merged; documents without a language get a code of their own."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("/", "lang", "source").alias("origin"), F.when(F.col("lang") != "de", F.col("lang")).alias("lang")
    )
    codes = fit_frequent(docs, ["origin", "lang"])
    return encode_frequent(docs, codes, missing="own")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    part = F.when(F.col("o_orderdate") < F.lit(TRAIN_END).cast("timestamp_ntz"), "train").otherwise("test")
    return orders.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority", "o_orderstatus",
        "o_totalprice", part.alias("part"),
    )


_ORDERS_SQL = f"""
    o AS (
        SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, o_orderstatus, o_totalprice,
               CASE WHEN o_orderdate < TIMESTAMP '{TRAIN_END}' THEN 'train' ELSE 'test' END AS part
        FROM orders
    ),
    mv AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS code FROM (SELECT DISTINCT month FROM o WHERE part = 'train')),
    pv AS (
        SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
        FROM (SELECT DISTINCT o_orderpriority FROM o WHERE part = 'train')
    )
"""


@query(f"""
    WITH {_ORDERS_SQL}
    SELECT o_orderkey, part, coalesce(mv.code, (SELECT max(code) + 1 FROM mv)) AS month,
           coalesce(pv.code, (SELECT max(code) + 1 FROM pv)) AS o_orderpriority
    FROM o LEFT JOIN mv USING (month) LEFT JOIN pv USING (o_orderpriority)
""")
def ordinal_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of order month and priority learned before 1999; months after that are unseen."""
    orders = _orders(spark, sf_dir).select("o_orderkey", "part", "month", "o_orderpriority")
    codes = fit_vocabulary(orders.where("part = 'train'"), ["month", "o_orderpriority"])
    return encode_vocabulary(orders, codes)


@query(f"""
    WITH {_ORDERS_SQL}
    SELECT 'month' AS "column", count(DISTINCT month) AS n FROM o WHERE part = 'train' UNION ALL
    SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM o WHERE part = 'train' UNION ALL
    SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM o WHERE part = 'train'
""")
def train_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct training values of each category and of the class label."""
    return cardinalities(_orders(spark, sf_dir), ["month", "o_orderpriority", "o_orderstatus"])


@query(f"""
    WITH {_ORDERS_SQL}
    SELECT o_orderkey, array_to_string(list_transform(range((SELECT count(*) FROM mv)), lambda i: (i = mv.code)::INT), '') AS hot
    FROM (SELECT o.*, coalesce(m.code, -1) AS code FROM o LEFT JOIN mv m USING (month)) mv
""")
def one_hot_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order month as zeros and a one; an unseen month is zeros only."""
    orders = _orders(spark, sf_dir).select("o_orderkey", "part", "month")
    codes = fit_vocabulary(orders.where("part = 'train'"), ["month"])
    hot = one_hot("month", codes.sizes["month"])
    text = F.array_join(F.transform(hot, lambda x: x.cast("int").cast("string")), "")
    return encode_vocabulary(orders, codes).select("o_orderkey", F.coalesce(text, F.lit("")).alias("hot"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("l_shipdate") < F.lit(TRAIN_END).cast("timestamp_ntz"), "train").otherwise("test")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", part.alias("part")
    )


_SCALED = ("l_quantity", "l_extendedprice", "l_tax")


@query(f"""
    WITH s AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALED)} FROM lineitem
               WHERE l_shipdate < TIMESTAMP '{TRAIN_END}')
    SELECT l_orderkey, l_linenumber, {", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _SCALED)}, 0.0::DOUBLE AS constant
    FROM lineitem, s
""")
def scale_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line columns scaled by mean and std of the lines shipped before 1999; a constant column becomes 0."""
    lines = _lines(spark, sf_dir).withColumn("constant", F.lit(7.0))
    fitted = mean_and_std(lines.where("part = 'train'"), [*_SCALED, "constant"])
    out = to_standard(lines, fitted)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in (*_SCALED, "constant")])


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 1.7976931348623157e308 ELSE 1.0 / l_tax END AS per_tax,
           CASE WHEN l_discount = 0 THEN 0.0 ELSE l_discount END AS no_nan, CASE WHEN l_quantity > 25 THEN 0.0 ELSE l_quantity END AS no_null
    FROM lineitem
""")
def scale_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns left as they are but for infinities, NaN and null, which are put into them here on purpose."""
    lines = _lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), F.col("l_tax"))).alias("per_tax"),
        F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("no_nan"),
        F.when(F.col("l_quantity") <= 25, F.col("l_quantity")).alias("no_null"),
    )
    return to_finite(lines, ["per_tax", "no_nan", "no_null"])


@query(f"""
    WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderdate < TIMESTAMP '{TRAIN_END}')
    SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS y, round(o_totalprice, 2) AS back FROM orders, s
""")
def label_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values on the scale of the training label, and the way back."""
    orders = _orders(spark, sf_dir)
    scale = fit_label(orders.where("part = 'train'"), "o_totalprice")
    scaled = orders.withColumn("z", scale.apply("o_totalprice"))
    return scaled.select("o_orderkey", F.round("z", 6).alias("y"), F.round(scale.invert("z"), 2).alias("back"))


def _poly_sql(r: str, coefficients: list[float]) -> str:
    out = repr(coefficients[-1]) + "::DOUBLE"
    for a in reversed(coefficients[:-1]):
        out = f"({out} * {r} + {a!r}::DOUBLE)"
    return out


def _normal_sql(p: str) -> str:
    """The inverse normal distribution as SQL text."""
    def ratio(r, top, bottom):
        return f"({_poly_sql(r, top)} / {_poly_sql(r, bottom)})"

    q, tail = f"({p} - 0.5::DOUBLE)", f"sqrt(-ln(least({p}, 1.0::DOUBLE - {p})))"
    outer = (
        f"CASE WHEN {tail} <= 5 THEN {ratio(f'({tail} - 1.6::DOUBLE)', prob.NEAR_TOP, prob.NEAR_BOTTOM)} "
        f"ELSE {ratio(f'({tail} - 5.0::DOUBLE)', prob.FAR_TOP, prob.FAR_BOTTOM)} END"
    )
    centre = f"{q} * {ratio(f'(0.180625::DOUBLE - {q} * {q})', prob.CENTRE_TOP, prob.CENTRE_BOTTOM)}"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {centre} ELSE sign({q}) * {outer} END"


def _shares_sql(train: str) -> str:
    """``train`` selects (event_id, v); the table ``share`` has the place p of every event's value in its quantile grid."""
    return f"""
        fit AS ({train}), size AS (SELECT greatest(least(count(*) // 30, 1000), 10) AS m, count(*) AS n FROM fit),
        sorted AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS p FROM fit),
        grid AS (
            SELECT j, lo.v + (hi.v - lo.v) * ((j * (n - 1)) % (m - 1))::DOUBLE / (m - 1) AS q
            FROM size, range(1000) r(j), sorted lo, sorted hi
            WHERE j < m AND lo.p = (j * (n - 1)) // (m - 1) AND hi.p = least(n - 1, (j * (n - 1)) // (m - 1) + 1)
        ),
        up AS (SELECT q, max(j) AS j FROM grid GROUP BY q), down AS (SELECT q, min(j) AS j FROM grid GROUP BY q),
        near AS (
            SELECT e.event_id, e.value, u.j AS uj, u.q AS uq, d.j AS dj, d.q AS dq, m,
                   (SELECT min(q) FROM grid) AS lo, (SELECT max(q) FROM grid) AS hi
            FROM events e ASOF LEFT JOIN up u ON e.value >= u.q ASOF LEFT JOIN down d ON e.value <= d.q, size
        ),
        share AS (
            SELECT event_id, CASE WHEN value - 1e-7 < lo THEN 0 WHEN value + 1e-7 > hi THEN 1 ELSE 0.5 * (
                CASE WHEN n.uj = m - 1 THEN 1 ELSE (n.uj + (value - uq) / (g.q - uq)) / (m - 1) END +
                CASE WHEN n.dj = 0 THEN 0 ELSE (n.dj - (dq - value) / (dq - h.q)) / (m - 1) END
            ) END AS p
            FROM near n LEFT JOIN grid g ON g.j = n.uj + 1 LEFT JOIN grid h ON h.j = n.dj - 1
        )
    """


def _quantile_sql(train: str) -> str:
    """``train`` selects (event_id, v); the result maps value of every event to the normal scale."""
    return f"""
        WITH {_shares_sql(train)}, clipped AS (SELECT event_id, greatest(least(p, 1 - 1e-7), 1e-7)::DOUBLE AS p FROM share)
        SELECT event_id, round({_normal_sql("p")}, 6) AS value FROM clipped
    """


_EVENT_TRAIN_END = "2024-01-20"
EVENT_SHARES_SQL = _shares_sql(f"SELECT event_id, value AS v FROM events WHERE ts < TIMESTAMP '{_EVENT_TRAIN_END}'")


def _event_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return events, events.where(F.col("ts") < F.lit(_EVENT_TRAIN_END).cast("timestamp_ntz"))


@query(_quantile_sql(f"SELECT event_id, value AS v FROM events WHERE ts < TIMESTAMP '{_EVENT_TRAIN_END}'"))
def scale_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values on the normal scale of the training quantiles."""
    events, train = _event_values(spark, sf_dir)
    return to_quantile(events, fit_quantiles(train, ["value"])).select("event_id", F.round("value", 6).alias("value"))


def _unit_sql(i: int) -> str:
    return f"((('0x' || substr(md5('0/value/{i}|' || event_id), 1, 15))::BIGINT::DOUBLE + 0.5) / 1152921504606846976.0::DOUBLE)"


@query(_quantile_sql(f"""
    SELECT event_id, value + 1e-5 * (sqrt(-2.0 * ln({_unit_sql(0)})) * cos(2.0 * pi() * {_unit_sql(1)})) AS v
    FROM events WHERE ts < TIMESTAMP '{_EVENT_TRAIN_END}'
"""))
def scale_quantile_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with small seeded noise on the training values."""
    events, train = _event_values(spark, sf_dir)
    fitted = fit_quantiles(train, ["value"], noise="fixed", row_id="event_id")
    return to_quantile(events, fitted).select("event_id", F.round("value", 6).alias("value"))


@query(_quantile_sql(f"""
    SELECT event_id, value + (SELECT 1e-3::DOUBLE / greatest(stddev_pop(value), 1e-3) FROM events WHERE ts < TIMESTAMP '{_EVENT_TRAIN_END}')
           * (sqrt(-2.0 * ln({_unit_sql(0)})) * cos(2.0 * pi() * {_unit_sql(1)})) AS v
    FROM events WHERE ts < TIMESTAMP '{_EVENT_TRAIN_END}'
"""))
def scale_quantile_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older rule: noise that shrinks with the spread of the column."""
    events, train = _event_values(spark, sf_dir)
    fitted = fit_quantiles(train, ["value"], noise="relative", row_id="event_id")
    return to_quantile(events, fitted).select("event_id", F.round("value", 6).alias("value"))


_BINS = 8


@query(f"""
    WITH g AS (SELECT quantile_cont(p_retailprice, {[i / _BINS for i in range(_BINS + 1)]}) AS e FROM part WHERE p_size <= 25)
    SELECT p_partkey, {", ".join(
        f"round(" + ("least(1.0, " if i < _BINS - 1 else "(") + ("greatest(0.0, " if i > 0 else "(")
        + f"(p_retailprice - e[{i + 1}]) / (e[{i + 2}] - e[{i + 1}]))), 6) AS bin_{i}" for i in range(_BINS))}
    FROM part, g
""")
def piecewise_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part price in eight quantile bins learned from the small parts, as how far it has passed through each."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    edges = fit_bins(part.where("p_size <= 25"), ["p_retailprice"], _BINS)["p_retailprice"]
    passed = part.withColumn("bins", piecewise_linear("p_retailprice", edges))
    return passed.select("p_partkey", *[F.round(F.get("bins", F.lit(i)), 6).alias(f"bin_{i}") for i in range(_BINS)])


@query(f"""
    WITH {_ORDERS_SQL}, k AS (SELECT count(*) AS k FROM pv)
    SELECT o_orderkey, k + 1 AS width, round(o_totalprice + coalesce(pv.code + 1, 0) * 1000000.0, 2) AS weighted
    FROM o LEFT JOIN pv USING (o_orderpriority), k
""")
def assembled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and one-hot priority as one vector; shown by its width and a weighted sum that tells every entry apart."""
    orders = _orders(spark, sf_dir).select("o_orderkey", "part", "o_totalprice", "o_orderpriority")
    codes = fit_vocabulary(orders.where("part = 'train'"), ["o_orderpriority"])
    vectors = to_vector(encode_vocabulary(orders, codes), ["o_totalprice"], codes=codes.sizes)
    entries = vectors.select("o_orderkey", vector_to_array("features").alias("a"))
    weights = F.transform("a", lambda x, i: x * F.when(i == 0, 1.0).otherwise(i * 1000000.0))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return entries.select("o_orderkey", F.size("a").cast("bigint").alias("width"), F.round(total, 2).alias("weighted"))


@query(f"""
    WITH {_ORDERS_SQL}, s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM o WHERE part = 'train')
    SELECT o_orderkey AS row_id, part, round((o_totalprice - m) / s, 6) AS price, coalesce(mv.code, (SELECT max(code) + 1 FROM mv)) AS month,
           round((o_totalprice - m) / s, 6) AS y
    FROM o LEFT JOIN mv USING (month), s
""")
def built_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies put together: standard scaling, ordinal codes, standardised label, all fitted on train."""
    orders = _orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("row_id"), "part", F.col("o_totalprice").alias("price"), "month", F.col("o_totalprice").alias("y")
    )
    built = build_dataset(
        orders, Roles(num=["price"], cat=["month"], target="y"), num_policy="standard", cat_policy="ordinal", scale_label=True
    )
    return built.data.select("row_id", "part", F.round("price", 6).alias("price"), "month", F.round("y", 6).alias("y"))


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day; values of sign-ups are missing."""
    part = F.when(F.col("ts") < F.lit(_EVENT_TRAIN_END).cast("timestamp_ntz"), "train").otherwise("test")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), part.alias("part"), "value", "event_type")


_NOISY_TRAIN_SQL = f"""
    SELECT event_id, value + 1e-5 * (sqrt(-2.0 * ln({_unit_sql(0)})) * cos(2.0 * pi() * {_unit_sql(1)})) AS v
    FROM events WHERE ts < TIMESTAMP '{_EVENT_TRAIN_END}'
"""


@query(f"""
    WITH {_shares_sql(_NOISY_TRAIN_SQL)}, clipped AS (SELECT event_id, greatest(least(p, 1 - 1e-7), 1e-7)::DOUBLE AS p FROM share),
    kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code
              FROM (SELECT DISTINCT event_type FROM events WHERE ts < TIMESTAMP '{_EVENT_TRAIN_END}'))
    SELECT event_id AS row_id, CASE WHEN ts < TIMESTAMP '{_EVENT_TRAIN_END}' THEN 'train' ELSE 'test' END AS part, round({_normal_sql("p")}, 6) AS value,
           array_to_string(list_transform(range((SELECT count(*) FROM kinds)), lambda i: CASE WHEN i = kinds.code THEN '1' ELSE '0' END), '') AS kind
    FROM clipped JOIN events USING (event_id) LEFT JOIN kinds USING (event_type)
""")
def built_noisy_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of noisy training values and one-hot kinds."""
    built = build_dataset(_event_rows(spark, sf_dir), Roles(num=["value"], cat=["event_type"]), num_policy="noisy-quantile", cat_policy="one-hot")
    hot = F.array_join(F.transform("event_type", lambda x: x.cast("int").cast("string")), "")
    return built.data.select("row_id", "part", F.round("value", 6).alias("value"), hot.alias("kind"))


@query(f"""
    WITH kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code
                   FROM (SELECT DISTINCT event_type FROM events WHERE ts < TIMESTAMP '{_EVENT_TRAIN_END}'))
    SELECT event_id AS row_id, CASE WHEN ts < TIMESTAMP '{_EVENT_TRAIN_END}' THEN 'train' ELSE 'test' END AS part,
           CASE WHEN event_type = 'signup' THEN 0 ELSE round(value, 6) END AS value,
           coalesce(CASE WHEN ts < TIMESTAMP '{_EVENT_TRAIN_END}' OR event_type <> 'error' THEN kinds.code END, (SELECT count(*) FROM kinds)) AS kind
    FROM events LEFT JOIN kinds USING (event_type)
""")
def built_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values left as they are but for missing ones, and ordinal kinds; one kind is missing outside training."""
    rows = _event_rows(spark, sf_dir).withColumns({
        "value": F.when(F.col("event_type") != "signup", F.col("value")),
        "kind": F.when((F.col("part") == "train") | (F.col("event_type") != "error"), F.col("event_type")),
    })
    built = build_dataset(rows, Roles(num=["value"], cat=["kind"]), num_policy="identity", cat_policy="ordinal")
    return built.data.select("row_id", "part", F.round("value", 6).alias("value"), "kind")
