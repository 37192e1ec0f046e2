from pyspark.sql import functions as F

from timetab.operators import joins
from timetab.operators.cleaning import drop_at_minimum
from timetab.session import broadcast_if_small, measured_bytes


def test_salted_join_with_a_hot_key(spark):
    """A third of the rows share a key; the small side is over the limit, so the join is salted."""
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = {r["k"]: r["_salts"] for r in joins.hot_values(big, "k", 100).collect()}
    assert hot == {1: -(-big.where("k = 1").count() // 100)}
    plain = big.join(small, "k").select("k", "id", "v")
    for how in ("inner", "left"):
        salted = joins.lookup_join(big, small, ["k"], how, limit=0, task_rows=100)
        assert "_salt" in salted._jdf.queryExecution().toString()
        got = salted.select("k", "id", "v")
        assert got.exceptAll(plain).count() == 0 and got.count() == 3000


def test_membership_with_a_hot_key(spark):
    big = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1), (None, 2), (3, 3)], "k int, id int")
    ids = spark.createDataFrame([(1,), (1,), (3,), (None,)], "k int")
    for limit in (0, 1 << 20):
        inside = joins.in_table(big, ids, "k", limit, task_rows=10)
        assert inside.count() == 51 and inside.columns == ["k", "id"]
        assert sorted(r["id"] for r in joins.not_in_table(big, ids, "k", limit, task_rows=10).collect()) == [1, 2]


def test_left_join_keeps_unmatched(spark):
    big = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, x string")
    small = spark.createDataFrame([(1, 10)], "k int, v int")
    for limit in (0, 1 << 20):
        rows = {r["x"]: r["v"] for r in joins.lookup_join(big, small, ["k"], "left", limit=limit).collect()}
        assert rows == {"a": 10, "b": None, "c": None}


def test_size_check(spark):
    df = spark.createDataFrame([("x" * 1000, 1), (None, 2)], "s string, n long")
    assert 1000 <= measured_bytes(df) <= 1100
    assert broadcast_if_small(df, 2000)[1] and not broadcast_if_small(df, 500)[1]


def test_chain_suffixes(spark):
    base = spark.createDataFrame([(1,), (2,)], "id int")
    a = spark.createDataFrame([(1, 5)], "id int, v int")
    b = spark.createDataFrame([(2, 6)], "id int, v int")
    out = joins.chain_left_joins(base, [a, b], "id")
    assert out.columns == ["id", "v", "v_1"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, 5, None), (2, None, 6)]


def test_update_join(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0)], "id int, s string, x double")
    fixes = spark.createDataFrame([(2, None, 9.0, 1), (3, "c", None, 1), (3, "d", None, 2), (9, "z", 1.0, 1)], "id int, s string, x double, o int")
    rows = sorted(tuple(r) for r in joins.update_join(base, fixes, "id", ["o"]).collect())
    assert rows == [(1, "a", 1.0), (2, "b", 9.0), (3, "d", 3.0)]


def test_semi_and_anti(spark):
    df, ids = spark.range(5).withColumnRenamed("id", "k"), spark.createDataFrame([(1,), (1,), (9,)], "k long")
    assert [r["k"] for r in joins.in_table(df, ids, "k").collect()] == [1]
    assert sorted(r["k"] for r in joins.not_in_table(df, ids, "k").collect()) == [0, 2, 3, 4]


def test_drop_at_minimum(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 1.0), (4, None)], "id int, km double")
    fixes = spark.createDataFrame([(2,), (7,)], "id int")
    assert sorted(r["id"] for r in drop_at_minimum(df, "km", fixes, "id").collect()) == [2, 3]


def test_gather_and_suffix(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, v string")
    split = spark.createDataFrame([(1, "x", "train"), (2, "x", "val")], "row_id long, split string, part string")
    assert [tuple(r) for r in joins.gather(df, split, "val").collect()] == [(2, "b", "val")]
    assert joins.with_suffix(df, ["row_id"]).columns == ["row_id", "v_right"]
