import random
from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timetab.operators.ordering import (
    global_position, hash_order, newest_share, nth_smallest, order_cutoffs, prefix_totals, time_folds,
)
from timetab.operators.sampling import exact_sample


def hot_rows(n=3000, seed=1):
    """A third of the rows share one time."""
    rng = random.Random(seed)
    return [(i, 500 if rng.random() < 0.34 else rng.randrange(1000)) for i in rng.sample(range(n * 10), n)]


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_global_position_is_the_sorted_place(spark, parts):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id long, t long").repartition(parts)
    got = {r["id"]: r["position"] for r in global_position(df, ["t", "id"]).collect()}
    assert got == {id_: i for i, (t, id_) in enumerate(sorted((t, id_) for id_, t in rows))}


def test_global_position_of_nothing(spark):
    df = spark.createDataFrame([], "id long, t long")
    assert global_position(df, ["t", "id"]).collect() == []


@pytest.mark.parametrize("leaf_rows, steps", [(10, 4), (50, 64), (10_000, 4)])
def test_cutoffs_with_a_hot_value(spark, leaf_rows, steps):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id long, t long")
    want = sorted((t, id_) for id_, t in rows)
    at = [0, 1, 700, 1200, 1500, 2998, 2999, 3000, 5000]
    cuts = order_cutoffs(df, ["t", "id"], at, leaf_rows=leaf_rows, steps=steps)
    assert [c.values for c in cuts] == [want[p] if p < len(want) else None for p in at]
    assert df.where(cuts[3].reached()).count() == 1800
    assert df.where(cuts[-1].reached()).count() == 0


def test_cutoffs_of_one_repeated_key(spark):
    df = spark.range(1000).select(F.lit(7).alias("t"))
    assert [c.values for c in order_cutoffs(df, ["t"], [0, 999], leaf_rows=10)] == [(7,), (7,)]


@pytest.mark.parametrize("kind, make", [
    ("date", lambda i: date(2020, 1, 1) + timedelta(days=i % 90)),
    ("timestamp_ntz", lambda i: datetime(2020, 1, 1) + timedelta(microseconds=i * 7919 % 1000)),
    ("double", lambda i: (i * 0.37) % 11.0 - 5.5),
    ("int", lambda i: i % 13 - 6),
])
def test_cutoffs_of_every_type(spark, kind, make):
    rows = [(i, make(i)) for i in range(500)]
    df = spark.createDataFrame(rows, f"id long, t {kind}")
    want = sorted((t, i) for i, t in rows)
    cuts = order_cutoffs(df, ["t", "id"], [0, 123, 499], leaf_rows=5, steps=8)
    assert [c.values for c in cuts] == [want[p] for p in (0, 123, 499)]
    assert df.where(cuts[1].reached()).count() == 377


def test_cutoffs_reject_nulls(spark):
    with pytest.raises(ValueError, match="null"):
        order_cutoffs(spark.createDataFrame([(1,), (None,)], "t int"), ["t"], [0])


def test_prefix_totals(spark):
    rows = [(i % 3, i, i * i % 17) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, k int, w long").repartition(16)
    running, want = 0, {}
    for g, k, w in sorted(rows):
        want[(g, k)] = running
        running += w
    got = {(r["g"], r["k"]): r["before"] for r in prefix_totals(df, ["g", "k"], {"before": "w"}).collect()}
    assert got == want


def test_prefix_totals_within_groups(spark):
    rows = [(i % 3, i, i * i % 17) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, k int, w long").repartition(16)
    want, sums = {}, {}
    for g, k, w in sorted(rows):
        want[(g, k)] = sums.get(g, 0)
        sums[g] = sums.get(g, 0) + w
    out = prefix_totals(df, ["g", "k"], {"before": "w"}, within=["g"]).collect()
    assert {(r["g"], r["k"]): r["before"] for r in out} == want
    assert all(r["before_total"] == sums[r["g"]] for r in out)
    with pytest.raises(ValueError):
        prefix_totals(df, ["g", "k"], {"before": "w"}, within=["k"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(times=st.lists(st.integers(0, 6), min_size=1, max_size=40))
def test_folds_by_definition(spark, times):
    df = spark.createDataFrame(list(enumerate(times)), "id long, t int")
    got = {r["id"]: r["fold"] for r in time_folds(df, "t").collect()}
    order, n = sorted(times), len(times)
    step = -(-n // 9)
    highs = [order[min(n - 1, step * (i + 1))] for i in range(9)]
    assert got == {i: min(f for f in range(9) if t <= highs[f]) for i, t in enumerate(times)}


def test_newest_share_keeps_ties(spark):
    df = spark.createDataFrame([(t,) for t in [1, 2, 3, 4, 5, 5, 5, 8, 9, 9]], "t int")
    assert sorted(r["t"] for r in newest_share(df, "t").collect()) == [9, 9]
    df = spark.createDataFrame([(t,) for t in [1, 2, 3, 4, 5, 5, 5, 9, 9, 9]], "t int")
    assert newest_share(df, "t").count() == 3


def test_exact_sample(spark):
    for n in (1, 39, 1000):
        df = spark.range(n)
        picked = {r["id"] for r in exact_sample(df, 0.25, "id").collect()}
        again = {r["id"] for r in exact_sample(df.repartition(7), 0.25, "id").collect()}
        assert len(picked) == n // 4 and picked == again
    assert picked != {r["id"] for r in exact_sample(spark.range(1000), 0.25, "id", seed=1).collect()}


def test_hash_order_matches_md5(spark):
    import hashlib

    got = spark.createDataFrame([(42,)], "id long").select(hash_order(0, "id")).first()[0]
    assert got == int(hashlib.md5(b"0|42").hexdigest()[:15], 16)


def test_nth_smallest(spark):
    df = spark.createDataFrame([("a", i, i) for i in (5, 3, 9, 1)] + [("b", 2, 0)], "g string, v int, id int")
    assert [tuple(r) for r in nth_smallest(df, ["g"], "v", 3, ["id"]).collect()] == [("a", 5, 5)]
