import numpy as np
import pytest
from pyspark.sql import functions as F

from timetab.operators import neighbours as nb


def brute(queries, candidates, k, causal=False, exclude_self=False):
    out = {}
    for qid, qt, q in queries:
        rows = []
        for cid, ct, c in candidates:
            if (exclude_self and cid == qid) or (causal and ct > qt):
                continue
            rows.append((float(((np.array(q) - np.array(c)) ** 2).sum()), ct if causal else 0, cid))
        out[qid] = [(cid, d) for d, _, cid in sorted(rows)[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, t long, embedding array<double>")


def result(pairs):
    got = {}
    for r in sorted(pairs.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["candidate_id"], r["distance"]))
    return got


def same(got, want):
    assert set(got) == {q for q, rows in want.items() if rows}
    for q, rows in want.items():
        assert [c for c, _ in got.get(q, [])] == [c for c, _ in rows]
        assert np.allclose([d for _, d in got.get(q, [])], [d for _, d in rows])


@pytest.fixture(scope="module")
def crowded():
    """A third of the vectors are the same one, and some are near copies of it; times repeat."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(200):
        v = np.ones(4) if i % 3 == 0 else rng.normal(size=4) + (i % 5)
        if i % 15 == 1:
            v = np.ones(4) + rng.normal(size=4) * 1e-6
        rows.append((i, int(rng.integers(0, 40)), [float(x) for x in v]))
    return rows


@pytest.mark.parametrize("causal, exclude_self", [(False, False), (False, True), (True, True), (True, False)])
def test_brute_force(spark, crowded, monkeypatch, causal, exclude_self):
    """Small cells and packs, so that pruning, packing and merging all happen."""
    for name, value in (("PACK_CANDIDATES", 8), ("PACK_QUERIES", 8)):
        monkeypatch.setattr(nb, name, value)
    df = frame(spark, crowded)
    pairs = nb.nearest(df, df, 7, time="t" if causal else None, exclude_self=exclude_self, cell_rows=16, lane_packs=4)
    same(result(pairs), brute(crowded, crowded, 7, causal, exclude_self))


@pytest.mark.parametrize("causal", [False, True])
def test_widening_rounds(spark, crowded, monkeypatch, causal):
    """Few pivots and small rounds: the bound comes from shares of the candidates."""
    for name, value in (("PACK_CANDIDATES", 16), ("PACK_QUERIES", 32)):
        monkeypatch.setattr(nb, name, value)
    df = frame(spark, crowded)
    pairs = nb.nearest(df, df, 5, time="t" if causal else None, exclude_self=True, cell_rows=32, pivots=12, widen=4)
    same(result(pairs), brute(crowded, crowded, 5, causal, True))


def clusters(n, seed):
    """Well parted groups of vectors, so that most packs have no business with each other."""
    rng = np.random.default_rng(seed)
    return [(i, 0, [float(x) for x in rng.normal(size=3) * 0.05 + 10 * (i % 12)]) for i in range(n)]


def test_packs_are_copied_on_demand(spark, monkeypatch):
    """A pack goes to the lanes that ask for it, and what each side asks for is there."""
    for name, value in (("PACK_CANDIDATES", 8), ("PACK_QUERIES", 8)):
        monkeypatch.setattr(nb, name, value)
    calls, routed = [], nb._routed
    monkeypatch.setattr(nb, "_routed", lambda *a: calls.append(routed(*a)) or calls[-1])
    rows = clusters(400, 1)
    df = frame(spark, rows)
    pairs = nb.nearest(df, df, 3, cell_rows=16, lane_packs=2)
    same(result(pairs), brute(rows, rows, 3))
    asked, held = (x.collect() for x in calls[-1])
    lanes = len({r["lane"] for r in asked})
    packs = {(r["cell"], r["slice"], r["salt"]) for r in held}
    assert lanes >= 10 and len(held) < 0.5 * len(packs) * lanes
    there = {(r["for_lane"], r["in_lane"], r["cell"], r["slice"], r["salt"]) for r in held}
    wanted = {(r["lane"], r["target_lane"], *t) for r in asked for t in r["wanted"]}
    assert there <= wanted and len(there) == len(held) and {w[2:] for w in wanted} >= packs


def test_small_packs_do_not_multiply_lanes(spark, monkeypatch):
    """Vectors without clusters in many small cells: each pack is copied once per lane of many rows, not once per few packs."""
    calls, routed = [], nb._routed
    monkeypatch.setattr(nb, "_routed", lambda *a: calls.append(routed(*a)) or calls[-1])
    rng = np.random.default_rng(3)
    rows = [(i, 0, [float(x) for x in rng.normal(size=16)]) for i in range(600)]
    df = frame(spark, rows)
    same(result(nb.nearest(df, df, 3, cell_rows=4, lane_packs=2)), brute(rows, rows, 3))
    asked, held = (x.collect() for x in calls[-1])
    packs = {(r["cell"], r["slice"], r["salt"]) for r in held}
    assert len(packs) > 50 and len(held) == len(packs)
    # Further lanes are made of more rows, as long as these fit.
    assert nb._lanes_of(10**6, 8192, 64) == nb.LANES and nb._lanes_of(10**8, 8192, 64) * nb.LANE_BYTES >= 10**8 * 64 * 8


def test_cell_tree(monkeypatch):
    """Rows meet the leads and the centres of one lead only, in matrices of bounded size."""
    from timetab.operators import cells

    rng = np.random.default_rng(2)
    centres = np.unique(rng.normal(size=(3000, 5)), axis=0)
    tree = cells.CellTree.of(centres)
    assert sorted(map(tuple, tree.centres)) == sorted(map(tuple, centres)) and len(tree.leads) <= 60
    x = rng.normal(size=(500, 5))
    lead, cell = tree.locate(x)
    d = ((x[:, None] - tree.leads) ** 2).sum(2)
    assert (d.argmin(1) == lead).all()
    for row, g, c in zip(x, lead, cell):
        own = tree.centres[tree.starts[g] : tree.starts[g + 1]]
        assert tree.starts[g] + ((row - own) ** 2).sum(1).argmin() == c
    monkeypatch.setattr(cells, "MATRIX_CELLS", 1000)
    assert (cells.nearest_of(x, tree.leads) == lead).all()
    # The border bound is one: no member of a lead is nearer to a row than it says.
    bound = cells.border_bounds(cells.distances(x[:50], tree.leads), tree.leads)
    for i in range(50):
        for j in range(500):
            assert bound[i, lead[j]] <= np.sqrt(((x[i] - x[j]) ** 2).sum()) + 1e-9


def test_fewer_candidates_than_wanted(spark, crowded):
    df, few = frame(spark, crowded[:20]), crowded[20:23]
    pairs = nb.nearest(df, frame(spark, few), 5)
    same(result(pairs), brute(crowded[:20], few, 5))
    misses = nb.context_misses(df, pairs, 5)
    assert {r["misses"] for r in misses.collect()} == {2}


def test_causal_is_never_newer_and_counts_misses(spark, crowded):
    df = frame(spark, crowded)
    pairs = nb.nearest(df, df, 10, time="t", exclude_self=True)
    times = {i: t for i, t, _ in crowded}
    assert all(times[r["candidate_id"]] <= times[r["query_id"]] for r in pairs.collect())
    want = {q: 10 - len(v) for q, v in brute(crowded, crowded, 10, True, True).items()}
    assert {r["query_id"]: r["misses"] for r in nb.context_misses(df, pairs, 10).collect()} == want


def test_empty_sides(spark, crowded):
    df, none = frame(spark, crowded[:5]), frame(spark, [])
    assert nb.nearest(df, none, 3).count() == 0
    assert nb.nearest(none, df, 3).count() == 0
    assert nb.context_misses(df, nb.nearest(df, none, 3), 3).agg({"misses": "sum"}).first()[0] == 15


def test_neighbour_mean(spark):
    df = spark.createDataFrame([(1, [0.0], 1.0), (2, [1.0], 3.0), (3, [2.0], 5.0)], "vec_id long, embedding array<double>, y double")
    pairs = nb.nearest(df, df, 2, exclude_self=True)
    got = {r["query_id"]: r["y_mean"] for r in nb.neighbour_mean(pairs, df, "y").collect()}
    w = np.exp(-3.0)
    assert got == pytest.approx({1: (3 + 5 * w) / (1 + w), 2: 3.0, 3: (3 + 1 * w) / (1 + w)})


def test_candidate_steps_cover_a_permutation(spark):
    df = spark.range(100).withColumnRenamed("id", "vec_id")
    steps = [[(r["pass"], r["vec_id"]) for r in nb.candidate_step(df, "vec_id", 30, s).collect()] for s in range(4)]
    assert [len(s) for s in steps] == [30] * 4
    first = [v for s in steps for p, v in s if p == 0]
    assert sorted(first) == list(range(100))
    with pytest.raises(ValueError):
        nb.candidate_step(df, "vec_id", 100, 0)


@pytest.mark.parametrize("n", [2, 3, 7, 100, 101, 1000])
def test_keyed_permutation(spark, n):
    df = spark.range(n).withColumnRenamed("id", "place")
    turns = [[r[0] for r in df.orderBy("place").select(nb.permuted_place(F.col("place"), n, "s", t)).collect()] for t in range(3)]
    assert all(sorted(t) == list(range(n)) for t in turns)
    if n >= 100:
        # Different keys give different orders, and neighbours are parted.
        assert len({tuple(t) for t in turns}) == 3
        assert all(abs(np.corrcoef(t, range(n))[0, 1]) < 0.4 for t in turns)


def test_permuted_steps_cover_all_rows(spark):
    df = spark.range(100).select(F.col("id").alias("place"), (F.col("id") * 3).alias("vec_id"))
    steps = [[(r["pass"], r["vec_id"]) for r in nb.permuted_step(df, 100, 30, s).collect()] for s in range(4)]
    assert [len(s) for s in steps] == [30] * 4
    assert sorted(v for s in steps for p, v in s if p == 0) == list(range(0, 300, 3))
    plan = nb.permuted_step(df, 100, 30, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    with pytest.raises(ValueError):
        nb.permuted_step(df, 100, 100, 0)
