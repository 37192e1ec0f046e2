"""Code compression and exact top-k search against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timetab.llm import max_score as M
from timetab.llm.code_compression import compress, digest, nearest
from timetab.llm.max_score import top_k

SCHEMA = "vec_id long, embedding array<double>, label int, row_key string, block string, dims string, code string, rank string"


def frame(spark, rows, slices=4):
    """rows: (vec_id, vector, label); the other columns are named like the operators' own."""
    extra = [(i, v, y, "x", "y", "z", "c", "r") for i, v, y in rows]
    return spark.createDataFrame(spark.sparkContext.parallelize(extra, slices), SCHEMA) if extra else spark.createDataFrame([], SCHEMA)


def vectors(seed, n, dims=16, spread=0.1):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(dims)] for _ in range(4)]
    return [[c + r.gauss(0, spread) for c in r.choice(centres)] for _ in range(n)]


def odd_vectors():
    rows = [(i, v, i % 3 if i % 5 else None) for i, v in enumerate(vectors(1, 90))]
    dims = 16
    rows += [
        (90, None, 1), (91, [], 1), (92, [None] + [0.1] * (dims - 1), 1), (93, [float("nan")] * dims, 1), (94, [float("inf")] + [0.0] * (dims - 1), 1),
        (7, vectors(2, 1)[0], 2), (7, vectors(3, 1)[0], None), (95, [0.0] * dims, 2), (96, [-0.0] * dims, 2), (97, [1e-9] * dims, 2),
    ]
    return rows + [(100 + i, rows[3][1], 0) for i in range(40)]  # one vector that stands in many rows


def sound(v, length=None):
    return v and all(x is not None and math.isfinite(x) for x in v) and (length is None or len(v) == length)


def brute_top(rows, k, every=20):
    held = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if i is not None and sound(v)]
    out = []
    for a, (q, x) in enumerate(held):
        if q % every == 0:
            found = sorted((-sum(s * t for s, t in zip(x, y)), c) for b, (c, y) in enumerate(held) if a != b and len(y) == len(x))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(found[:k])]
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"shard_cells": 16 * 10, "pack_cells": 16 * 3, "shards_per_group": 2}, {"shard_cells": 1, "pack_cells": 1}])
def test_top_k(spark, options):
    rows = odd_vectors() + [(None, vectors(4, 1)[0], 1), (200, [0.5, 0.5], 1), (201, [0.25, -0.5], 1)]
    got = top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, k=6, **options)
    assert Counter(map(tuple, got.collect())) == brute_top(rows, 6)


def test_top_k_odd_tables(spark):
    asks = F.col("vec_id") % 20 == 0
    assert top_k(frame(spark, []), asks).collect() == []
    assert top_k(frame(spark, [(0, [1.0], 1)]), asks).collect() == []
    assert top_k(frame(spark, [(1, [1.0], 1), (2, [2.0], 1)]), asks).collect() == []
    few = [(0, [1.0, 0.0], 1), (1, [1.0, 2.0], 1), (2, [-1.0, 0.0], 1)]
    assert Counter(map(tuple, top_k(frame(spark, few), asks).collect())) == brute_top(few, 20)


def test_top_k_large_numbers(spark):
    r = random.Random(5)
    for scale in (1e3, 1e6, 1e12):
        rows = [(i, [r.gauss(0, scale) for _ in range(4)], 0) for i in range(60)]
        got = Counter(map(tuple, top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, k=5).collect()))
        want = brute_top(rows, 5)
        assert got == Counter({(q, n, c, max(-(2**63), min(2**63 - 1, s))): m for (q, n, c, s), m in want.items()})


def test_few_rows_are_probed():
    """Non-essential terms are read for competitive rows only, and each bound holds."""
    rows = np.floor(64 * np.array(vectors(6, 4000, 64, 0.03))).astype(np.float32)
    queries, ids = rows[:50], np.arange(4000)
    best = M.Best(50, 10, np.float32)
    postings = np.ascontiguousarray(rows.T)
    M.search_shard(best, queries, ids[:50], ids[:3000], ids[:3000], postings[:, :3000], 0.5)
    probed = M.search_shard(best, queries, ids[:50], ids[3000:], ids[3000:], postings[:, 3000:], 0.5)
    assert 0 < probed < 0.5 * 50 * 1000
    essential, order, rest, first = M.split_terms(queries, postings.min(axis=1), postings.max(axis=1), best.threshold, 0.5)
    for q in range(50):
        others = ~essential[q]
        assert others.sum() == 64 - first[q] and set(order[q, first[q] :]) == set(np.flatnonzero(others))
        assert (queries[q][others] @ postings[others]).max() <= rest[q, first[q]] <= 0.5 * best.threshold[q]


def brute_codes(rows, parts, entries, rounds):
    held = sorted(((i is None, i or 0, [math.floor(4096 * x) for x in v]), i, y) for i, v, y in rows if sound(v) and len(v) == 16)
    held = [(i, k[2], y) for k, i, y in held]
    w = 16 // parts
    book = [[v[p * w : p * w + w] for _, v, _ in held[:entries]] for p in range(parts)]

    def near(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(v[p * w : p * w + w], e)) for e in book[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in held:
                own.setdefault(near(v, p)[0], []).append(v[p * w : p * w + w])
            for e, members in own.items():
                book[p][e] = [sum(c) // len(members) for c in zip(*members)]
    out = [(i, y, [near(v, p) for p in range(parts)]) for i, v, y in held]
    totals = Counter()
    for _, y, found in out:
        totals[y] += sum(d for _, d in found)
    return Counter((i, "".join(f"{e:02x}" for e, _ in f), sum(d for _, d in f), totals[y]) for i, y, f in out), book


@pytest.mark.parametrize("cells", [1 << 20, 16 * 7])
def test_codes(spark, cells):
    rows = [r for r in odd_vectors() if r[0] is not None] + [(201, [0.25, -0.5], 1)]
    rows = [(i, v, y if y is None else y % 3) for i, v, y in rows] + [(None, vectors(8, 1)[0], None)]
    keyed = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    got, book = compress(frame(spark, rows), parts=4, entries=5, rounds=4, cells=cells)
    want, want_book = brute_codes([(i, v, -1 if y is None else y) for i, v, y in keyed], 4, 5, 4)
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got.collect()) == want
    assert book == want_book and len(digest(book)) == 64


def test_codes_odd_tables(spark):
    got, book = compress(frame(spark, []))
    assert got.collect() == [] and book == []
    got, book = compress(frame(spark, [(3, [0.5] * 16, None), (5, [0.25] * 16, 1)]))
    assert [(r["vec_id"], r["code"], r["error"]) for r in got.orderBy("vec_id").collect()] == [(3, "00" * 8, 0), (5, "01" * 8, 0)]
    with pytest.raises(ValueError):
        compress(frame(spark, [(3, [0.5] * 5, None)]))


def test_codes_large_numbers(spark):
    rows = [(i, [x * 1e11 for x in v], 0) for i, v in enumerate(vectors(9, 40))]
    got, book = compress(frame(spark, rows), parts=4, entries=5, rounds=3)
    want, want_book = brute_codes(rows, 4, 5, 3)
    errors = {(i, c): e if e < 2**63 else None for i, c, e, _ in want}
    assert book == want_book
    assert {(r["vec_id"], r["code"]): r["error"] for r in got.collect()} == errors


def test_nearest_takes_the_first_of_equals():
    words, codes = [np.array([0, 2, 4])], [np.array([0, 1, 2])]
    chosen, distance = nearest(words, codes, np.array([[4], [0], [4], [0]]))
    assert chosen.tolist() == [1, 0, 0] and distance.tolist() == [0, 4, 0]
