"""History, entity and calendar features, column profile, drift statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import query, table
from timetab.functions.calendar import add_calendar, from_epoch_seconds
from timetab.functions.columns import pick
from timetab.operators.aggregates import any_of_group, entity_features, histogram, list_mean
from timetab.operators.drift import covariance, covariance_gap, time_domains
from timetab.operators.joins import lookup_join
from timetab.operators.ordering import newest_share, nth_smallest, preview, time_folds
from timetab.operators.profiling import narrowed_types, profile, two_valued_columns, uninformative
from timetab.plans.entity import entity_table
from timetab.plans.history import HORIZONS, history_features as build_history, purchase_flags
from timetab.session import materialise

MATCHES = {
    "bought_brand": ("p_brand", "anchor_brand"),
    "bought_type": ("p_type", "anchor_type"),
    "bought_supplier": ("l_suppkey", "anchor_supplier"),
}
COMBINATIONS = [
    ("bought_brand", "bought_type", "bought_supplier"), ("bought_brand", "bought_type"), ("bought_brand", "bought_supplier"),
]


def history_sql(*more: str) -> str:
    """The features of every customer's history; ``more`` aggregates can use the anchor's columns."""
    flags = {"bought_brand": "same_brand", "bought_type": "same_type", "bought_supplier": "same_supplier"}
    out = [
        "id", "strftime(any_value(anchor_date), '%Y-%m-%d') AS anchor_date",
        "any_value(isodow(anchor_date))::BIGINT AS day_of_week", "any_value(day(anchor_date))::BIGINT AS day_of_month",
        "any_value(dayofyear(anchor_date))::BIGINT AS day_of_year", "round(sum(l_extendedprice), 2) AS total_spend",
    ]
    for n, f in flags.items():
        for tail, cond in [("", f)] + [(f"_{d}", f"{f} AND days < {d}") for d in HORIZONS]:
            out += [
                f"count(*) FILTER (WHERE {cond}) AS has_{n}{tail}",
                f"coalesce(sum(l_quantity) FILTER (WHERE {cond}), 0.0) AS has_{n}_q{tail}",
                f"round(coalesce(sum(l_extendedprice) FILTER (WHERE {cond}), 0.0), 2) AS has_{n}_a{tail}",
            ]
        out.append(f"(count(*) FILTER (WHERE {f}) = 0)::INT::DOUBLE AS never_{n}")
    for names in COMBINATIONS:
        every = " AND ".join(f"count(*) FILTER (WHERE {flags[n]}) > 0" for n in names)
        out.append(f"({every})::INT::DOUBLE AS has_{'_and_'.join(names)}")
    out += more
    return f"""
        WITH tx AS (
            SELECT o_totalprice > 250000 AS large, o_custkey AS id, o_orderdate::DATE AS d, p_brand, p_type, l_suppkey, l_quantity, l_extendedprice,
                   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC,
                                      l_linenumber, l_partkey, l_suppkey) AS rn
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        ), j AS (
            SELECT tx.*, a.d AS anchor_date, date_diff('day', tx.d, a.d) AS days, tx.p_brand = a.p_brand AS same_brand,
                   tx.p_type = a.p_type AS same_type, tx.l_suppkey = a.l_suppkey AS same_supplier, a.large::INT::BIGINT AS anchor_large
            FROM tx JOIN (SELECT * FROM tx WHERE rn = 1) a ON tx.id = a.id
        )
        SELECT {", ".join(out)} FROM j WHERE days >= 0 GROUP BY id
    """


@query(history_sql())
def history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of each customer up to the day of the last order, matched with the first line of that order."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    bought = materialise(lookup_join(
        lines.withColumnRenamed("l_partkey", "p_partkey"),
        table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), ["p_partkey"],
    ).select(
        F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"), "o_orderkey", "l_linenumber",
        "p_partkey", "p_brand", "p_type", "l_suppkey", "l_quantity", "l_extendedprice",
    ), "bought")
    last = F.struct("d", "o_orderkey", -F.col("l_linenumber"), -F.col("p_partkey"), -F.col("l_suppkey"))
    anchors = bought.groupBy("id").agg(
        F.max_by(F.struct("d", "p_brand", "p_type", "l_suppkey"), last).alias("a")
    ).select(
        "id", F.col("a.d").alias("anchor_date"), F.col("a.p_brand").alias("anchor_brand"),
        F.col("a.p_type").alias("anchor_type"), F.col("a.l_suppkey").alias("anchor_supplier"),
    )
    features = build_history(
        bought.select("id", "d", "p_brand", "p_type", "l_suppkey", "l_quantity", "l_extendedprice"),
        materialise(anchors, "anchors"), id_="id", date="d", anchor_date="anchor_date", matches=MATCHES,
        quantity="l_quantity", amount="l_extendedprice",
    )
    return rounded_history(purchase_flags(
        add_calendar(features, "anchor_date", ["day_of_week", "day_of_month", "day_of_year"]), list(MATCHES), COMBINATIONS
    ))


def rounded_history(flagged: DataFrame) -> DataFrame:
    """Money in cents, whole numbers and flags in the types of the SQL twin."""
    combined = ["has_" + "_and_".join(c) for c in COMBINATIONS]
    money = {c: F.round(c, 2) for c in pick(flagged, prefix=tuple(f"has_{n}_a" for n in MATCHES), also=["total_spend"], exclude=combined)}
    whole = {c: F.col(c).cast("bigint") for c in ("day_of_week", "day_of_month", "day_of_year")}
    single = {c: F.col(c).cast("double") for c in pick(flagged, prefix="never_", also=combined)}
    return flagged.withColumns(money | whole | single | {"anchor_date": F.col("anchor_date").cast("string")})


def _line_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("num_group1"),
        F.col("l_partkey").alias("num_group2"), F.col("l_suppkey").alias("num_group3"),
        F.col("l_quantity").alias("quantity_P"), F.col("l_extendedprice").alias("price_A"),
        F.col("l_tax").alias("tax_T"), F.col("l_linestatus").alias("status_L"),
        F.col("l_returnflag").alias("returned_M"), F.col("l_shipdate").cast("date").alias("shipped_D"),
    )
    base = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").cast("date").alias("date_decision")
    )
    return base, lines


_NUMERIC = ("quantity_P", "price_A", "tax_T")
_LINE_SQL = """
    l AS (
        SELECT l_orderkey AS case_id, l_linenumber, l_partkey, l_suppkey, l_quantity AS quantity_P, l_extendedprice AS price_A,
               l_tax AS tax_T, l_linestatus AS status_L, l_returnflag AS returned_M, l_shipdate::DATE AS shipped_D,
               (l_shipdate::DATE - DATE '1970-01-01')::DOUBLE AS ship_days
        FROM lineitem
    ), firsts AS (
        SELECT case_id, returned_M,
               row_number() OVER (PARTITION BY case_id ORDER BY l_linenumber, l_partkey, l_suppkey) AS up,
               row_number() OVER (PARTITION BY case_id ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS down
        FROM l
    ), agg AS (
        SELECT case_id, {numeric}, max(status_L) AS max_status_L, min(status_L) AS min_status_L,
               count(DISTINCT returned_M) AS n_unique_returned_M, max(shipped_D) AS max_shipped_D, min(shipped_D) AS min_shipped_D,
               avg(ship_days) AS mean_shipped_D, stddev_samp(ship_days) AS std_shipped_D, max(l_linenumber) AS max_num_group1
        FROM l GROUP BY case_id
    ), ends AS (
        SELECT case_id, max(returned_M) FILTER (WHERE up = 1) AS first_returned_M,
               max(returned_M) FILTER (WHERE down = 1) AS last_returned_M
        FROM firsts GROUP BY case_id
    )
""".replace("{numeric}", ", ".join(
    f"max({c}) AS max_{c}, min({c}) AS min_{c}, round(avg({c}), 6) AS mean_{c}, round(stddev_samp({c}), 4) AS std_{c}"
    for c in _NUMERIC
))


@query(f"""
    WITH {_LINE_SQL}
    SELECT o_orderkey AS case_id, strftime(o_orderdate, '%Y-%m-%d') AS date_decision,
           agg.* EXCLUDE (case_id, max_shipped_D, min_shipped_D, mean_shipped_D, std_shipped_D, max_num_group1),
           first_returned_M, last_returned_M, max_num_group1::BIGINT AS max_num_group1,
           date_diff('day', o_orderdate::DATE, max_shipped_D)::DOUBLE AS max_shipped_D,
           date_diff('day', o_orderdate::DATE, min_shipped_D)::DOUBLE AS min_shipped_D,
           trunc(mean_shipped_D - (o_orderdate::DATE - DATE '1970-01-01')) AS mean_shipped_D,
           round(std_shipped_D, 4) AS std_shipped_D
    FROM orders LEFT JOIN agg ON o_orderkey = agg.case_id LEFT JOIN ends ON o_orderkey = ends.case_id
""")
def order_line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order, the aggregates of its lines by column suffix, joined to the order; dates as days from the order date."""
    base, lines = _line_tables(spark, sf_dir)
    wide = entity_table(
        base, [], [(lines, ["num_group1", "num_group2", "num_group3"])], "case_id", "date_decision", drop_dead=False
    )
    rounded = {f"mean_{c}": F.round(f"mean_{c}", 6) for c in _NUMERIC} | {f"std_{c}": F.round(f"std_{c}", 4) for c in _NUMERIC}
    days = {c: F.col(c).cast("double") for c in ("max_shipped_D", "min_shipped_D", "mean_shipped_D")}
    text = {"date_decision": F.col("date_decision").cast("string"), "std_shipped_D": F.round("std_shipped_D", 4)}
    text["max_num_group1"] = F.col("max_num_group1").cast("bigint")
    return wide.withColumns(rounded | days | text).drop("mean_status_L", "std_status_L")


@query(f"""
    WITH {_LINE_SQL}
    SELECT agg.* EXCLUDE (max_shipped_D, min_shipped_D, mean_shipped_D, std_shipped_D, max_num_group1),
           max_num_group1::BIGINT AS max_num_group1, strftime(max_shipped_D, '%Y-%m-%d') AS max_shipped_D,
           strftime(min_shipped_D, '%Y-%m-%d') AS min_shipped_D, round(mean_shipped_D, 6) AS mean_shipped_D,
           round(std_shipped_D, 4) AS std_shipped_D, first_returned_M, last_returned_M
    FROM agg JOIN ends USING (case_id)
""")
def entity_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suffix-driven aggregates alone, one row per order with lines."""
    _, lines = _line_tables(spark, sf_dir)
    out = entity_features(lines, "case_id", ["num_group1", "num_group2", "num_group3"], group_index="num_group1")
    rounded = {f"mean_{c}": F.round(f"mean_{c}", 6) for c in (*_NUMERIC, "shipped_D")}
    rounded |= {f"std_{c}": F.round(f"std_{c}", 4) for c in (*_NUMERIC, "shipped_D")}
    text = {c: F.col(c).cast("string") for c in ("max_shipped_D", "min_shipped_D")}
    return out.withColumns(rounded | text | {"max_num_group1": F.col("max_num_group1").cast("bigint")}).drop(
        "mean_status_L", "std_status_L"
    )


@query("""
    WITH l AS (
        SELECT l_partkey AS part, l_orderkey, l_linenumber, l_suppkey, l_returnflag AS a_M, nullif(l_linestatus, 'O') AS b_M, l_quantity::INT::VARCHAR AS c_M FROM lineitem
    ), o AS (
        SELECT *, row_number() OVER (PARTITION BY part ORDER BY l_orderkey, l_linenumber, l_suppkey, a_M, c_M) AS up,
               row_number() OVER (PARTITION BY part ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, a_M DESC, c_M DESC) AS down FROM l
    )
    SELECT part, count(DISTINCT a_M) AS n_unique_a_M, count(DISTINCT b_M) + max((b_M IS NULL)::INT) AS n_unique_b_M, count(DISTINCT c_M) AS n_unique_c_M,
           max(a_M) FILTER (WHERE up = 1) AS first_a_M, max(c_M) FILTER (WHERE up = 1) AS first_c_M, max(a_M) FILTER (WHERE down = 1) AS last_a_M,
           max(c_M) FILTER (WHERE down = 1) AS last_c_M FROM o GROUP BY part
""")
def entity_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three category columns per part: distinct values, null counted as one, and the first and last."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part"), "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_returnflag").alias("a_M"),
        F.nullif(F.col("l_linestatus"), F.lit("O")).alias("b_M"), F.col("l_quantity").cast("int").cast("string").alias("c_M"),
    )
    out = entity_features(lines, "part", ["l_orderkey", "l_linenumber", "l_suppkey", "a_M", "c_M"])
    return out.select("part", *[f"n_unique_{c}_M" for c in "abc"], *[f"{e}_{c}_M" for e in ("first", "last") for c in "ac"])


@query("""
    SELECT event_id, isodow(ts)::BIGINT AS day_of_week, day(ts)::BIGINT AS day_of_month, dayofyear(ts)::BIGINT AS day_of_year,
           month(ts)::BIGINT AS month, year(ts)::BIGINT AS year, (hour(ts) * 60 + minute(ts))::BIGINT AS minute_of_day,
           hour(ts)::BIGINT AS hour_of_day, (epoch_us(ts) // 1000000)::BIGINT AS epoch_seconds
    FROM events
""")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar parts of every event time, after a way through epoch seconds."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    epoch = events.withColumn("epoch_seconds", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint"))
    out = add_calendar(epoch.withColumn("ts", from_epoch_seconds("epoch_seconds")), "ts").drop("ts")
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in out.columns])


PROFILED = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ],
}
_TEXT = ("c_name", "c_mktsegment", "o_orderstatus", "o_orderpriority", "l_returnflag", "l_linestatus")


def _profile_sql() -> str:
    parts = [
        f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null,
            count(DISTINCT {c}) AS n_distinct, {str(c in _TEXT).lower()} AS is_text FROM {t}"""
        for t, columns in PROFILED.items() for c in columns
    ]
    return f"""
        SELECT table_name, column_name, n_rows, n_null, n_distinct, n_null / n_rows AS null_share,
               n_distinct + (n_null > 0)::INT AS n_distinct_with_null,
               ((n_null / n_rows > 0.95) OR n_distinct = 1 OR (is_text AND n_distinct > 50))::INT AS dropped
        FROM ({" UNION ALL ".join(parts)})
    """


@query(_profile_sql())
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null share, distinct counts and the drop verdict of every column of three tables."""
    out = None
    for name, columns in PROFILED.items():
        stats = uninformative(profile(table(spark, sf_dir, name), columns), _TEXT)
        rows = stats.select(
            F.lit(name).alias("table_name"), F.col("column").alias("column_name"), "n_rows", "n_null", "n_distinct",
            "null_share", "n_distinct_with_null", F.col("drop").cast("int").alias("dropped"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name FROM lineitem HAVING count(DISTINCT {c}) + max(({c} IS NULL)::INT) = 2"
    for c in PROFILED["lineitem"]
))
def two_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the lines with exactly two values, null counting as one."""
    names = two_valued_columns(profile(table(spark, sf_dir, "lineitem")))
    return spark.createDataFrame([(n,) for n in names], "column_name string")


def _narrow_sql() -> str:
    whole, real = PROFILED["lineitem"][:4], PROFILED["lineitem"][4:8]
    parts = [
        f"""SELECT '{c}' AS column_name, CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint'
            WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint'
            WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE 'bigint' END AS kind,
            min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM lineitem"""
        for c in whole
    ] + [f"SELECT '{c}', 'float', min({c}::FLOAT)::DOUBLE, max({c}::FLOAT)::DOUBLE FROM lineitem" for c in real]
    return " UNION ALL ".join(parts)


@query(_narrow_sql())
def narrow_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest type that holds each numeric column of the lines, and the range after the cast."""
    lines = table(spark, sf_dir, "lineitem").select(*PROFILED["lineitem"][:8])
    kinds = narrowed_types(lines)
    cast = lines.agg(*[f(F.col(c).cast(k)).cast("double").alias(f"{n}_{c}") for c, k in kinds.items()
                       for n, f in (("low", F.min), ("high", F.max))])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind"), F.col(f"low_{c}").alias("low"),
                     F.col(f"high_{c}").alias("high")) for c, k in kinds.items()]
    return cast.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


@query("""
    WITH p AS (SELECT o_totalprice AS v FROM orders WHERE o_totalprice < 300000),
         r AS (SELECT min(v) AS lo, max(v) AS hi FROM p)
    SELECT least(floor((v - lo) / (hi - lo) * 100), 99)::BIGINT AS bin, count(*) AS n FROM p, r GROUP BY 1
""")
def price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values below 300,000 in 100 equal steps."""
    orders = table(spark, sf_dir, "orders").select("o_totalprice")
    return histogram(orders, "o_totalprice", 100, lambda c: c < 300000).withColumn("bin", F.col("bin").cast("bigint"))


@query("""
    SELECT l_suppkey, l_extendedprice AS fifth_price, l_orderkey FROM (
        SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey) AS rn FROM lineitem
    ) WHERE rn = 5
""")
def fifth_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifth-lowest line price of every supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_orderkey")
    return nth_smallest(lines, ["l_suppkey"], "l_extendedprice", 5, ["l_orderkey"]).withColumnRenamed(
        "l_extendedprice", "fifth_price"
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preview: the 20 oldest orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return preview(orders, ["o_orderdate", "o_orderkey"], 20).drop("o_orderdate")


_DRIFT = {"quantity": "l_quantity / 50", "price": "l_extendedprice / 100000", "discount": "l_discount", "tax": "l_tax"}


def _drift_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_shipdate", *[F.expr(e).alias(n) for n, e in _DRIFT.items()])


def _pairs() -> list[tuple[str, str]]:
    names = list(_DRIFT)
    return [(a, b) for i, a in enumerate(names) for b in names[i:]]


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS i, '{b}' AS j, round(covar_samp({_DRIFT[a]}, {_DRIFT[b]}), 8) AS cov FROM lineitem" for a, b in _pairs()
))
def feature_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance of four line columns."""
    return covariance(_drift_table(spark, sf_dir), list(_DRIFT)).withColumn("cov", F.round("cov", 8))


_GAPS = {f"c{i}": f"nullif({c}, {v})" for i, (c, v) in enumerate(
    [(c, v) for v in range(1, 13) for c in ("l_quantity", "l_linenumber", "l_suppkey % 13")])}


def _gaps_sql(columns: list[str]) -> str:
    cells = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return f"""
        WITH x AS (SELECT {", ".join(f"({_GAPS[c]})::DOUBLE AS {c}" for c in columns)} FROM lineitem), m AS (SELECT {", ".join(
            f"round(covar_samp({a}, {b}), 7) AS {a}_{b}" for a, b in cells)} FROM x)
        SELECT split_part(k, '_', 1) AS i, split_part(k, '_', 2) AS j, cov FROM (UNPIVOT m ON COLUMNS(*) INTO NAME k VALUE cov)
    """


def _gaps(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*[F.expr(_GAPS[c]).cast("double").alias(c) for c in columns])
    return covariance(rows, columns).withColumn("cov", F.round("cov", 7))


@query(_gaps_sql(list(_GAPS)[:4]))
def feature_covariance_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance of four columns with nulls: each pair counts the rows where both are present."""
    return _gaps(spark, sf_dir, list(_GAPS)[:4])


@query(_gaps_sql(list(_GAPS)))
def feature_covariance_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of 36 columns."""
    return _gaps(spark, sf_dir, list(_GAPS))


_FOLDS_SQL = """
    s AS (SELECT {time} AS t, row_number() OVER (ORDER BY {time}) - 1 AS pos, count(*) OVER () AS n FROM {table}),
    cut AS (
        SELECT i, max(t) AS high FROM range(9) r(i), s WHERE pos = least(n - 1, ((n + 8) // 9) * (i + 1)) GROUP BY i
    )
"""


def _gap_sql() -> str:
    folds = _FOLDS_SQL.format(time="l_shipdate", table="lineitem")
    cols = ", ".join(f"{e} AS {n}" for n, e in _DRIFT.items())
    cov = ", ".join(f"covar_samp({a}, {b}) AS {a}_{b}" for a, b in _pairs())
    square = " + ".join(f"{1 if a == b else 2} * pow(a.{a}_{b} - d.{a}_{b}, 2)" for a, b in _pairs())
    return f"""
        WITH {folds}, f AS (
            SELECT {cols}, (SELECT min(i) FROM cut WHERE l_shipdate <= high) AS fold FROM lineitem
        ), dom AS (
            SELECT dom.d, count(*) AS n, {cov} FROM f JOIN range(5) dom(d) ON fold >= dom.d AND fold < dom.d + 5 GROUP BY dom.d
        ), al AS (SELECT {cov} FROM f)
        SELECT count(*) AS domains, round(sum({square}) / (4.0 * 16) / count(*), 12) AS gap FROM dom d, al a WHERE d.n > 1
    """


@query(_gap_sql())
def covariance_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the covariance inside overlapping ship-date spans is from the overall one."""
    return covariance_gap(_drift_table(spark, sf_dir), "l_shipdate", list(_DRIFT)).withColumn("gap", F.round("gap", 12))


@query(f"""
    WITH {_FOLDS_SQL.format(time="o_orderdate", table="orders")}
    SELECT o_orderkey, (SELECT min(i) FROM cut WHERE o_orderdate <= high)::BIGINT AS fold FROM orders
""")
def order_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine time folds of the orders; many orders share a date."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return time_folds(orders, "o_orderdate").select("o_orderkey", F.col("fold").cast("bigint").alias("fold"))


@query(f"""
    WITH {_FOLDS_SQL.format(time="ts", table="events")}, f AS (
        SELECT event_id, (SELECT min(i) FROM cut WHERE ts <= high) AS fold FROM events
    )
    SELECT d::BIGINT AS domain, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event
    FROM f JOIN range(5) dom(d) ON fold >= d AND fold < d + 5 GROUP BY d
""")
def event_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and reach of the five overlapping time domains of the events."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return time_domains(events, "ts").groupBy(F.col("domain").cast("bigint").alias("domain")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")
    )


@query("""
    WITH s AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate) - 1 AS pos, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM s WHERE pos = n // 5 * 4)
""")
def recent_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifth of the orders, ties at the border kept."""
    return newest_share(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").select("o_orderkey")


@query("""
    SELECT p_brand, count(*) AS n, round(avg(v), 6) AS mean_price, any_value(brand_again) AS brand_again FROM (
        SELECT p_brand, p_brand AS brand_again, p_type, avg(p_retailprice) AS v FROM part GROUP BY p_brand, p_type
    ) GROUP BY p_brand
""")
def list_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the per-type mean prices of a brand, gathered as a list; a brand has one value per type."""
    per_type = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("v"))
    lists = per_type.withColumn("brand_again", F.col("p_brand")).groupBy("p_brand").agg(
        F.collect_list("v").alias("vs"), *any_of_group(["brand_again"])
    )
    return lists.select("p_brand", F.size("vs").cast("bigint").alias("n"), F.round(list_mean("vs"), 6).alias("mean_price"), "brand_again")
