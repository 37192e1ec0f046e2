from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from timetab.functions.calendar import add_calendar, days_from, mean_days_from
from timetab.functions.columns import (
    Roles, cast_by_name, decimal_comma, finite, mapped, pick, presence, sentinel_to_null,
)
from timetab.operators.aggregates import entity_features, histogram, list_mean
from timetab.operators.drift import block_sums, centred_sums, covariance, covariance_gap
from timetab.operators.profiling import (
    drop_uninformative, narrowed_types, profile, profile_of_few, two_valued_columns, value_counts,
)
from timetab.plans.entity import dates_to_days, entity_table, sex_flag
from timetab.plans.history import HORIZONS, history_features, purchase_flags


def day(text):
    return date.fromisoformat(text)


@pytest.fixture(scope="module")
def purchases(spark):
    anchors = spark.createDataFrame(
        [(1, day("2013-04-01"), "A", "x"), (2, day("2013-04-01"), "B", "y"), (3, day("2013-04-01"), "A", "x")],
        "id long, offerdate date, brand_right string, company_right string",
    )
    events = spark.createDataFrame(
        [
            (1, day("2013-04-01"), "A", "x", 1.0, 10.0),  # on the day
            (1, day("2013-03-02"), "A", "z", 2.0, -4.0),  # exactly 30 days before, a return
            (1, day("2013-03-04"), "C", "x", 4.0, None),  # exactly 28 days before, no amount
            (1, day("2013-04-05"), "A", "x", 8.0, 100.0),  # after the anchor
            (2, day("2012-01-01"), "C", "z", 16.0, 7.0),  # no match, long ago
        ],
        "id long, date date, brand string, company string, q double, a double",
    )
    return events, anchors


def build(purchases, **kw):
    events, anchors = purchases
    return history_features(
        events, anchors, id_="id", date="date", anchor_date="offerdate", quantity="q", amount="a",
        matches={"bought_company": ("company", "company_right"), "bought_brand": ("brand", "brand_right")}, **kw
    )


def test_history_windows(purchases):
    rows = {r["id"]: r for r in build(purchases).collect()}
    assert set(rows) == {1, 2}  # an entity without events drops out
    one = rows[1]
    assert (one["total_spend"], one["has_bought_brand"], one["has_bought_brand_q"], one["has_bought_brand_a"]) == (6.0, 2, 3.0, 6.0)
    assert (one["has_bought_brand_28"], one["has_bought_brand_60"]) == (1, 2)
    assert (one["has_bought_company_28"], one["has_bought_company_q_60"], one["has_bought_company_a_60"]) == (1, 5.0, 10.0)
    two = rows[2]
    assert (two["has_bought_brand"], two["has_bought_brand_q_180"], two["has_bought_brand_a"], two["total_spend"]) == (0, 0.0, 0.0, 7.0)


def test_history_after_the_anchor_counts_only_on_request(purchases):
    row = build(purchases, min_days=None).where("id = 1").first()
    assert (row["total_spend"], row["has_bought_brand_q_1"]) == (106.0, 9.0)


def test_history_does_not_leak(spark, purchases):
    """Changing events after the anchor changes no feature."""
    events, anchors = purchases
    late = spark.createDataFrame([(2, day("2014-01-01"), "B", "y", 5.0, 5.0)], events.schema)
    more = build((events.unionByName(late), anchors))
    assert build(purchases).exceptAll(more).count() == 0


def test_history_column_count(purchases):
    """Two flags: 3 totals each and 3 per horizon, besides id, anchor date and total spend; three flags make 109."""
    assert len(build(purchases).columns) == 3 + 2 * 3 * (1 + len(HORIZONS))
    flagged = purchase_flags(build(purchases), ["bought_company", "bought_brand"], [("bought_company", "bought_brand")])
    rows = {r["id"]: r for r in flagged.collect()}
    assert (rows[1]["never_bought_brand"], rows[1]["has_bought_company_and_bought_brand"]) == (0.0, 1.0)
    assert (rows[2]["never_bought_brand"], rows[2]["has_bought_company_and_bought_brand"]) == (1.0, 0.0)


def test_history_through_the_salted_join(purchases, monkeypatch):
    import timetab.plans.history as module
    from timetab.operators.joins import salted_join

    want = build(purchases)
    monkeypatch.setattr(module, "lookup_join", lambda big, small, on: salted_join(big, small, on))
    assert build(purchases).exceptAll(want).count() == 0


ENTITY = "case_id int, num_group1 int, num_group2 int, amount_A double, word_L string, kind_M string, seen_D date"


@pytest.fixture(scope="module")
def grouped(spark):
    return spark.createDataFrame([
        (1, 0, 1, 1.0, "b", None, day("2020-01-01")),
        (1, 0, 0, 3.0, "a", "x", day("2020-01-04")),
        (1, 1, 0, None, "c", None, None),
        (2, 0, 0, 5.0, None, "y", day("2019-01-01")),
        (3, 0, 0, None, None, None, None),
    ], ENTITY)


def test_entity_features(grouped):
    rows = {r["case_id"]: r for r in entity_features(grouped, "case_id", ["num_group1", "num_group2"], "num_group1").collect()}
    one = rows[1]
    assert (one["max_amount_A"], one["min_amount_A"], one["mean_amount_A"]) == (3.0, 1.0, 2.0)
    assert one["std_amount_A"] == pytest.approx(np.sqrt(2))
    assert (one["max_word_L"], one["mean_word_L"]) == ("c", None)
    assert (one["first_kind_M"], one["last_kind_M"], one["n_unique_kind_M"]) == ("x", None, 2)  # null is kept and counted
    assert (one["max_seen_D"], one["mean_seen_D"]) == (day("2020-01-04"), 18263.5)
    assert one["max_num_group1"] == 1
    assert rows[2]["std_amount_A"] is None  # one row
    assert (rows[3]["max_amount_A"], rows[3]["n_unique_kind_M"]) == (None, 1)


def test_entity_table(spark, grouped):
    base = spark.createDataFrame([(1, day("2020-01-05")), (4, day("2020-01-05"))], "case_id int, date_decision date")
    static = spark.createDataFrame([(1, 7.0)], "case_id int, amount_A double")
    out = entity_table(base, [static], [(grouped, ["num_group1", "num_group2"])], "case_id", "date_decision", drop_dead=False)
    rows = {r["case_id"]: r for r in out.collect()}
    assert (rows[1]["amount_A"], rows[1]["max_seen_D"], rows[1]["min_seen_D"], rows[1]["mean_seen_D"]) == (7.0, -1.0, -4.0, -2.0)
    assert rows[4]["max_seen_D"] is None
    assert "std_seen_D" in out.columns


def test_days_and_flags(spark):
    df = spark.createDataFrame([(day("2020-01-10"), day("2020-01-08"), 18271.5, "F")], "anchor date, x_D date, mean_x_D double, sex string")
    row = dates_to_days(df, "anchor").first()
    assert (row["x_D"], row["mean_x_D"]) == (-2.0, 0.0)
    assert df.select(days_from("anchor", "x_D")).first()[0] == -2.0
    assert df.select(mean_days_from("anchor", "mean_x_D")).first()[0] == 0.0
    assert sex_flag(df, "sex", "F").first()["sex"] == 1.0


def test_calendar(spark):
    times = ["2024-02-29 00:00:00", "2023-12-31 23:59:59", "2024-01-01 12:30:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    rows = [tuple(r)[1:] for r in add_calendar(df, "t").collect()]
    assert rows == [(4, 29, 60, 2, 2024, 0, 0), (7, 31, 365, 12, 2023, 1439, 23), (1, 1, 1, 1, 2024, 750, 12)]


def test_profile_and_drops(spark):
    rows = [(i, None, 1, None if i else "v", f"s{i}", ["N", "Y"][i % 2], None if i % 2 else 3.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, empty string, one int, rare string, text string, yn string, flag double")
    stats = {r["column"]: r for r in profile(df).collect()}
    assert (stats["empty"]["n_null"], stats["empty"]["n_distinct"], stats["one"]["n_distinct"]) == (60, 0, 1)
    assert (stats["flag"]["n_distinct"], stats["flag"]["n_distinct_with_null"]) == (1, 2)
    assert sorted(two_valued_columns(profile(df))) == ["flag", "rare", "yn"]
    assert drop_uninformative(df).columns == ["id", "yn"]
    approx = {r["column"]: r["n_distinct"] for r in profile(df, ["id", "yn"], exact=False).collect()}
    assert approx["yn"] == 2 and 55 <= approx["id"] <= 65
    assert {r["value"]: r["n"] for r in value_counts(df, ["yn"]).collect()} == {"N": 30, "Y": 30}


def test_narrowed_types(spark):
    df = spark.createDataFrame([(126, 127, -128, 70000, 2**40, 1.5, 1e300, None), (0, 0, 0, 0, 0, 0.0, 0.0, None)],
                               "a long, b long, c long, d long, e long, f double, g double, h long")
    assert narrowed_types(df) == {"a": "tinyint", "b": "smallint", "c": "smallint", "d": "int", "e": "bigint", "f": "float"}


def test_small_expressions(spark):
    df = spark.createDataFrame(
        [(-1, "Y", "12,5", float("inf"), None), (2, "N", "1,2,3", float("nan"), "x"), (None, "?", "junk", None, "")],
        "a int, yn string, comma string, x double, s string",
    )
    out = [tuple(r) for r in df.select(
        sentinel_to_null("a"), mapped("yn", {"N": 0, "Y": 1}), decimal_comma("comma"), finite("x"), presence("s")
    ).collect()]
    assert out == [(None, 1, 12.5, 1.7976931348623157e308, 0.0), (2, 0, None, 0.0, 1.0), (None, None, None, 0.0, 1.0)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(decimal_comma("comma", strict=True)).collect()


def test_roles_and_casts(spark):
    df = spark.createDataFrame([(1, "2020-01-02", "junk", 2.5, 3)], "case_id long, a_D string, b_D string, num_0 double, y int")
    typed = cast_by_name(df, ["case_id"], lambda c: c.endswith("D"))
    assert [f.dataType.simpleString() for f in typed.schema.fields][:3] == ["bigint", "date", "date"]
    assert typed.first()["b_D"] is None
    keys = spark.createDataFrame([("3000000000",), ("x",)], "case_id string")
    assert [r[0] for r in cast_by_name(keys, ["case_id"], lambda c: False).collect()] == [3_000_000_000, None]
    assert pick(df, prefix="num", suffix="D", exclude=["b_D"]) == ["a_D", "num_0"]
    roles = Roles(num=["num_0"], meta=["a_D"], target="y", task="binclass")
    row = roles.select(typed, "case_id").first()
    assert tuple(row) == (1, 2.5, 18263, 3) and roles.features == ["num_0"]


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 5, 9, 10, 99]], "v double")
    got = {r["bin"]: r["n"] for r in histogram(df, "v", 10, lambda c: c <= 10).collect()}
    assert got == {0: 1, 1: 1, 5: 1, 9: 2}
    assert histogram(df.limit(0), "v").count() == 0
    assert histogram(df.where("v = 5"), "v").collect()[0]["n"] == 1


def test_list_mean(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(list_mean("v")).collect()] == [1.5, None]


def test_covariance_with_gaps(spark):
    """Each pair of columns counts the rows where both values are present, as many columns there are."""
    rng = np.random.default_rng(5)
    for d in (3, 35):
        x = rng.normal(size=(60, d)) + 10
        x[rng.random(size=x.shape) < 0.2] = np.nan
        rows = [tuple(None if np.isnan(v) and j % 2 else float(v) for j, v in enumerate(r)) for r in x]
        names = [f"x{i}" for i in range(d)]
        df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
        got = {(r["i"], r["j"]): r["cov"] for r in covariance(df, names).collect()}
        assert len(got) == d * (d + 1) // 2
        for i in range(d):
            for j in range(i, d):
                both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
                assert got[names[i], names[j]] == pytest.approx(np.cov(x[both, i], x[both, j])[0, 1])
    empty = covariance(spark.createDataFrame([(None, 1.0)], "a double, b double"), ["a", "b"])
    assert {r["cov"] for r in empty.collect()} == {None}


def test_covariance_of_many_columns(spark):
    """500 columns travel as a few blocks of sums per task, not as a row per pair."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 500))
    x[rng.random(x.shape) < 0.05] = np.nan
    names = [f"c{i}" for i in range(500)]
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{c} double" for c in names)).repartition(3)
    blocks, width = block_sums(df, names)
    assert blocks.count() == -(-500 // width) <= 4
    got = np.zeros((500, 500))
    for r in centred_sums(df, names).selectExpr("i", "j", "(sum_ij - sum_i * sum_j / n) / (n - 1) AS cov").toArrow().to_pylist():
        got[r["i"], r["j"]] = r["cov"]
    want = np.array(pd.DataFrame(x).cov())
    assert np.allclose(np.triu(got), np.triu(want))


def test_covariance(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 1000
    names = [f"x{i}" for i in range(4)]
    df = spark.createDataFrame([(i // 3, *map(float, r)) for i, r in enumerate(x)], "t int, " + ", ".join(f"{n} double" for n in names))
    want = np.cov(x.T)
    got = {(r["i"], r["j"]): r["cov"] for r in covariance(df, names).collect()}
    assert all(got[names[i], names[j]] == pytest.approx(want[i, j]) for i in range(4) for j in range(i, 4))
    assert centred_sums(df, names).groupBy("i", "j").agg(F.sum("n").alias("n")).select("n").distinct().collect() == [(200,)]
    t = np.array([i // 3 for i in range(200)])
    highs = [sorted(t)[min(199, 23 * (i + 1))] for i in range(9)]
    fold = np.array([min(f for f in range(9) if v <= highs[f]) for v in t])
    gaps = []
    for d in range(5):
        inside = x[(fold >= d) & (fold < d + 5)]
        gaps.append(((want - np.cov(inside.T)) ** 2).sum() / 4 / 16)
    row = covariance_gap(df, "t", names).first()
    assert row["domains"] == 5 and row["gap"] == pytest.approx(np.mean(gaps))


def test_profile_of_few(spark):
    """Few values are counted exactly, many are estimated, and nulls count as before."""
    df = spark.range(5000).select(
        F.col("id"), (F.col("id") % 51).cast("string").alias("text"), F.when(F.col("id") % 2 == 0, 1.5).alias("half"),
        F.lit(None).cast("int").alias("none"), (F.col("id") % 50).cast("double").alias("fifty"),
    )
    got = {r["column"]: r for r in profile_of_few(df).collect()}
    want = {r["column"]: r for r in profile(df).collect()}
    assert {c: (r["n_rows"], r["n_null"]) for c, r in got.items()} == {c: (r["n_rows"], r["n_null"]) for c, r in want.items()}
    for c in ("text", "half", "none", "fifty"):
        assert got[c] == want[c]
    assert abs(got["id"]["n_distinct"] - 5000) < 500
    assert drop_uninformative(df).columns == ["id", "fifty"]
