from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timetab.operators.splits import overlaps
from timetab.plans import jobs
from timetab.plans.jobs import Timeline, split_view
from timetab.operators.profiling import all_null_columns, profile


def counts(build):
    return {k: len(getattr(build.roles, k)) for k in ("num", "bin", "cat")}


def test_offers_has_113_numbers_and_6_flags(spark):
    """Three flags, eleven horizons, one carried value: 113 numeric and 6 binary features."""
    day = date(2013, 3, 1)
    anchors = spark.createDataFrame(
        [(i, day + timedelta(days=i % 60), "c", "k", "b", 1.5, i % 2) for i in range(120)],
        "id long, offerdate date, company_right string, category_right string, brand_right string, offervalue double, repeater int",
    )
    events = spark.createDataFrame(
        [(i, day - timedelta(days=i % 40), "cx"[i % 2], "k", "b", 1.0, 2.0) for i in range(118)],
        "id long, date date, company string, category string, brand string, q double, a double",
    )
    names = ("company", "category", "brand")
    built = jobs.offers(
        events, anchors, "id", "repeater", Timeline("offerdate", "2013-04-10", "2013-04-20"), date="date", quantity="q", amount="a",
        matches={f"bought_{n}": (n, f"{n}_right") for n in names}, carry=["offervalue"],
        combinations=[("bought_brand", "bought_category", "bought_company"), ("bought_brand", "bought_category"), ("bought_brand", "bought_company")],
    )
    assert counts(built) == {"num": 113, "bin": 6, "cat": 0}
    assert overlaps(built.splits).count() == 0
    view = split_view(built, "sliding-window-1")
    assert view.count() == 118 - 2 * 11 and dict(view.dtypes)["y"] == "bigint"


def test_event_log(spark):
    start = datetime(2023, 11, 1)
    rows = [(i, start + timedelta(hours=i), 0.5 if i == 7 else 1.0 + i, float(i), "abc"[i % 3], "skip", i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, minutes double, num_0 double, cat_1 string, cat_0 string, bin_0 int")
    built = jobs.event_log(df, "id", "minutes", Timeline("timestamp", "2023-11-10", "2023-11-14"), fraction=0.5, skip=["cat_0"])
    assert built.rows.count() == 199  # half of the 399 rows with a minute or more
    assert counts(built) == {"num": 4, "bin": 1, "cat": 1}
    parts = {r["part"]: r for r in split_view(built).groupBy("part").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).collect()}
    assert parts["train"]["hi"] < parts["val"]["lo"] and parts["val"]["hi"] < parts["test"]["lo"]


def test_quotes(spark):
    rows = [
        (i, date(2015, 1 + i % 5, 1 + i % 28), i % 2, [-1, 3, 4][i % 3], -1, "NY"[i % 2], [7, None][i % 2], ["x", "y", "z"][i % 3], float(i), "text")
        for i in range(100)
    ]
    df = spark.createDataFrame(rows, "quote long, day date, won int, rank_A int, gone_B int, yes string, once_B int, kind string, v double, note_A string")
    t = F.col("day")
    part = F.when(F.month(t).isin(3, 4), "val").when(F.month(t) == 5, "test").when(t < date(2015, 3, 1), "train")
    built = jobs.quotes(df, "quote", "won", Timeline("day", part=part))
    assert list(built.roles.bin) == ["yes", "once_B"] and list(built.roles.cat) == ["kind", "note_A"]
    assert "gone_B" not in built.roles.features and "rank_A" in built.roles.num
    row = {r["quote"]: r for r in built.rows.collect()}
    assert (row[0]["yes"], row[1]["yes"], row[0]["once_B"], row[1]["once_B"], row[0]["rank_A"], row[1]["rank_A"]) == (0.0, 1.0, 1.0, 0.0, None, 3)
    assert {r["part"] for r in split_view(built).collect()} == {"train", "val", "test"}


def test_sensor_log(spark):
    rows = [(i, 1_700_000_000 + i * 3600, float(i), i % 2, float(i), i) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, fact_time long, temp double, gfs_available int, wind double, station long")
    built = jobs.sensor_log(df, "id", "fact_time", "temp", Timeline("when", "2023-11-18", "2023-11-20"), meta=["station"], fraction=0.5)
    assert counts(built) == {"num": 6, "bin": 1, "cat": 0} and list(built.roles.meta) == ["when", "station"]
    assert built.rows.count() == 100 and "fact_time" not in built.roles.features


def test_property_sales(spark):
    rows = [(i, date(2014, 1, 1) + timedelta(days=2 * i), 10.0 + i, 2e6 + i, 0.5 if i % 10 == 0 else 1.0 + i, [None, "a", "b"][i % 3], ["p", "q"][i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, timestamp date, full_sq double, price double, km double, ecology string, deal string")
    macro = spark.createDataFrame([(date(2014, 1, 1) + timedelta(days=2 * i), float(i)) for i in range(55)], "timestamp date, gdp double")
    fixes = spark.createDataFrame([(10, 99.0, None), (500, 1.0, "b")], "id long, km double, ecology string")
    built = jobs.property_sales(
        df, macro, fixes, "id", Timeline("timestamp", "2014-03-20", "2014-04-05"), price="price", area="full_sq", distance="km",
        keep=F.col("full_sq") > 11, cat=["ecology"], fit_on="all",
    )
    got = {r["id"]: r for r in built.rows.collect()}
    assert 0 not in got and 20 not in got and 1 not in got and 55 not in got and got[10]["km"] == 99.0
    assert list(built.roles.bin) == ["deal"] and (got[2]["deal"], got[3]["deal"]) == (0.0, 1.0)
    assert (got[3]["ecology"], got[4]["ecology"], got[2]["ecology"]) == (2, 0, 1)


def test_credit(spark):
    base = spark.createDataFrame([(i, date(2019, 1, 1) + timedelta(days=i), i % 2) for i in range(200)], "case_id int, date_decision date, target int")
    static = spark.createDataFrame([(i, float(i), 1) for i in range(200)], "case_id int, income_A double, same_L int")
    person = spark.createDataFrame(
        [(i, g, "FM"[i % 2], "uv"[(i + g) % 2], date(2018, 1, 1)) for i in range(200) for g in range(2)],
        "case_id int, num_group1 int, sex_L string, home_M string, birth_D date",
    )
    built = jobs.credit(
        base, [static], [(person, ["num_group1"])], "case_id", "target", Timeline("date_decision", "2019-05-01", "2019-06-01"),
        bin_flags={"max_sex_L": F.col("max_sex_L") == "F"}, drop=["min_sex_L"], fraction=0.5,
    )
    assert built.rows.count() == 100 and list(built.roles.bin) == ["max_sex_L"]
    assert "same_L" not in built.roles.features and {"last_home_M", "first_home_M"} <= set(built.roles.cat)
    assert {"income_A", "max_birth_D", "day_of_week"} <= set(built.roles.num)


def test_all_null_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, 3)], "a int, b string, c int")
    assert all_null_columns(profile(df)) == ["b"]


def test_timeline_without_enough_rows(spark):
    df = spark.createDataFrame([(i, date(2020, 1, 1)) for i in range(8)], "id long, t date")
    with pytest.raises(ValueError):
        Timeline("t", "2020-01-01", "2020-01-02", window=2).splits(df, "id")
