"""Exact top-k search by inner product: MaxScore over sharded postings.

A component's place is a term, its integer the term's weight. A shard holds one posting list per term. For each query the terms
are put in order by the most they can add in the shard; those whose bounds together stay under a share of the query's threshold are
non-essential. The postings of the others are traversed in full, and only documents that can still reach the threshold are probed in
the rest, one term at a time, as long as they stay competitive. Shards are merged by query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timetab.llm.vectors import block_rows, exact_integers, narrowed, usable, whole
from timetab.session import materialise

SHARD_CELLS = 1 << 20  # components in a shard
PACK_CELLS = 1 << 20  # components of the queries that meet a group of shards at once
SHARDS_PER_GROUP = 16
QUERY_CHUNK, ROW_CHUNK = 256, 4096
NON_ESSENTIAL_SHARE = 0.25  # of the threshold
BLOCK = "block long, dims int, n int, kind string, ids binary, keys binary, body binary"
FOUND = "query_key long, query_id long, vec_id long, score long, high long, low long"


def _blocks(rows: DataFrame, factor: int, cells: int) -> DataFrame:
    def make(table, components):
        kept = narrowed(whole(components, factor))
        keys = table["row_key"].to_numpy()
        return {
            "block": int(keys[0]), "dims": components.shape[1], "n": len(components), "kind": kept.dtype.str,
            "ids": table["vec_id"].to_numpy().tobytes(), "keys": keys.tobytes(), "body": kept.tobytes(),
        }

    return block_rows(rows, "vector", cells, make, BLOCK)


def _read(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, keys = np.frombuffer(row.ids, dtype=np.int64), np.frombuffer(row.keys, dtype=np.int64)
    values = np.frombuffer(row.body, dtype=np.dtype(row.kind)).reshape(row.n, row.dims)
    return ids, keys, values


def _arithmetic(queries: np.ndarray, rows: list[np.ndarray]) -> type:
    """The fastest type in which every partial sum of a score is exact."""
    most = float(np.abs(queries.astype(np.float64)).max(initial=0)) * max((float(np.abs(r.astype(np.float64)).max(initial=0)) for r in rows), default=0)
    bound = most * queries.shape[1]
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object


class Best:
    """The k best rows so far of each of some queries: score, then the smaller id."""

    def __init__(self, n: int, k: int, kind: type):
        self.k = k
        self.query, self.score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=kind)
        self.ids, self.keys = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.threshold = np.full(n, -math.inf, dtype=object if kind is object else np.float64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        if not len(query):
            return
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        ids, keys = np.concatenate([self.ids, ids]), np.concatenate([self.keys, keys])
        order = np.lexsort((ids, -score, query)) if score.dtype != object else np.array(
            sorted(range(len(query)), key=lambda i: (query[i], -score[i], ids[i])), dtype=np.int64)
        query = query[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        order = order[place < self.k]
        full = query[place == self.k - 1]
        self.query, self.score, self.ids, self.keys = query[place < self.k], score[order], ids[order], keys[order]
        self.threshold[full] = score[order][np.flatnonzero(place[place < self.k] == self.k - 1)]


def first_of_equal(ids: np.ndarray, keys: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows of a shard that can be among the k best: of equal vectors only the k + 1 with the least ids (a query
    leaves out one row, its own)."""
    wide = np.ascontiguousarray(values).view(np.dtype((np.void, values.dtype.itemsize * values.shape[1]))).ravel()
    _, own = np.unique(wide, return_inverse=True)
    order = np.lexsort((keys, ids, own))
    sorted_own = own[order]
    starts = np.flatnonzero(np.r_[True, sorted_own[1:] != sorted_own[:-1]])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place <= k]


def split_terms(queries: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: np.ndarray, share: float):
    """``(essential mask, order, rest, first)`` of each query's terms, ordered from the most to the least that a term can add in the shard.

    ``rest[q, j]`` bounds what the terms from place j of the order on add together. Non-essential are the terms from place ``first`` on,
    whose bounds sum to at most ``share`` of the threshold; without a threshold above 0 there are none.
    """
    bounds = np.maximum(queries * low, queries * high)
    order = np.argsort(-bounds, axis=1, kind="stable")
    ordered = np.take_along_axis(bounds, order, axis=1)
    zero = np.zeros((len(queries), 1), dtype=bounds.dtype)
    rest = np.concatenate([np.cumsum(ordered[:, ::-1], axis=1)[:, ::-1], zero], axis=1)
    allowed = np.where(threshold > 0, threshold, 0) * share
    fits = (rest[:, :-1] <= allowed[:, None]) & (threshold > 0)[:, None]
    first = np.where(fits.any(axis=1), fits.argmax(axis=1), queries.shape[1])
    essential = np.zeros(queries.shape, dtype=bool)
    np.put_along_axis(essential, order, np.arange(queries.shape[1])[None, :] < first[:, None], axis=1)
    return essential, order, rest, first


def search_shard(best: Best, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, keys: np.ndarray, postings: np.ndarray, share: float) -> int:
    """Add a shard's rows to ``best``; returns the number of documents probed. ``postings`` has one row per term."""
    probed = 0
    exact = postings.dtype == object
    low, high = postings.min(axis=1), postings.max(axis=1)
    for a in range(0, len(ids), ROW_CHUNK):
        part = postings[:, a : a + ROW_CHUNK]
        essential, order, rest, first = split_terms(queries, low, high, best.threshold, share)
        score = (queries * essential) @ part
        spare = np.take_along_axis(rest, first[:, None], axis=1)[:, 0]
        unknown = np.array([t == -math.inf for t in best.threshold]) if exact else np.isneginf(best.threshold)
        # Without a threshold all terms are essential, the scores exact, and the (k + 1)-th of this chunk is a first threshold.
        need = best.threshold - spare
        if unknown.any() and part.shape[1] > best.k + 1:
            rows = np.flatnonzero(unknown)
            kth = np.sort(score[rows], axis=1)[:, -best.k - 1] if exact else np.partition(score[rows], -best.k - 1, axis=1)[:, -best.k - 1]
            need[rows] = kth
        q, d = np.nonzero(score >= need[:, None])
        mine = own[q] != keys[a + d]
        q, d = q[mine], d[mine]
        s, place = score[q, d], first[q]
        probed += int((place < queries.shape[1]).sum())
        done_q, done_d, done_s = [], [], []
        while len(q):
            over = place >= queries.shape[1]
            done_q.append(q[over]), done_d.append(d[over]), done_s.append(s[over])
            q, d, s, place = q[~over], d[~over], s[~over], place[~over]
            term = order[q, place]
            s = s + queries[q, term] * part[term, d]
            place = place + 1
            competitive = s + rest[q, place] >= best.threshold[q]
            q, d, s, place = q[competitive], d[competitive], s[competitive], place[competitive]
        if done_q:
            q, d = np.concatenate(done_q), np.concatenate(done_d)
            best.add(q, np.concatenate(done_s), ids[a + d], keys[a + d])
    return probed


def search_group(packs: list, shards: list, k: int, share: float = NON_ESSENTIAL_SHARE) -> pd.DataFrame:
    """The k best rows of some shards for each query of some packs."""
    out = []
    held = []
    for shard in shards:
        ids, keys, values = _read(shard)
        held.append((ids, keys, values))
    for pack in packs:
        query_ids, query_keys, wanted = _read(pack)
        kind = _arithmetic(wanted, [values for _, _, values in held])
        cast = exact_integers if kind is object else (lambda x, kind=kind: x.astype(kind))
        wanted = cast(wanted)
        bests = [(a, Best(len(wanted[a : a + QUERY_CHUNK]), k, kind)) for a in range(0, len(wanted), QUERY_CHUNK)]
        for ids, keys, values in held:
            use = first_of_equal(ids, keys, values, k)
            postings = np.ascontiguousarray(cast(values[use]).T)
            for a, best in bests:
                span = slice(a, a + QUERY_CHUNK)
                search_shard(best, wanted[span], query_keys[span], ids[use], keys[use], postings, share)
        for a, best in bests:
            scores = [int(s) for s in best.score.tolist()]
            out.append(pd.DataFrame({
                "query_key": query_keys[a + best.query], "query_id": query_ids[a + best.query], "vec_id": best.ids,
                "score": np.array([max(-(2**63), min(2**63 - 1, s)) for s in scores], dtype=np.int64),
                "high": np.array([s >> 62 for s in scores], dtype=np.int64), "low": np.array([s & (2**62 - 1) for s in scores], dtype=np.int64),
            }))
    return pd.concat(out) if out else pd.DataFrame({f.split()[0]: np.zeros(0, dtype=np.int64) for f in FOUND.split(", ")})


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, factor: int = 64, vec_id: str = "vec_id", vector: str = "embedding",
    shard_cells: int = SHARD_CELLS, pack_cells: int = PACK_CELLS, shards_per_group: int = SHARDS_PER_GROUP,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: per query row the ``k`` rows with the highest inner products of floor(factor * x).

    Queries are the rows for which ``is_query`` holds, candidates all rows but the query's own; ties go to the smaller vec_id. The result is
    exact. Vectors that are null, empty or hold a null or non-finite component (or one whose integer is beyond 2**53), and rows
    without a vec_id, take no part. Vectors of different lengths are never compared. Rows that repeat a vec_id are rows of their own: each is a query, and a candidate of the others.
    Scores beyond the range of a long are ranked exactly and given as its ends. Other columns are not read; an empty table gives no rows.

    Rows are packed into shards and queries into packs where they lie. Each pack meets each group of shards once, as a group of bounded size,
    and sends its k best rows of the group to the merge. Equal vectors, however many, cost a shard k + 1 rows. The work is queries times rows, as an
    exact search of unclustered vectors is.
    """
    spark = vectors.sparkSession
    cleaned = vectors.select(
        F.monotonically_increasing_id().alias("row_key"), F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where(F.col("vec_id").isNotNull() & usable(F.col("vector"), factor))
    shards = materialise(_blocks(cleaned.drop("asks"), factor, shard_cells), "shards")
    packs = materialise(_blocks(cleaned.where("asks").drop("asks"), factor, pack_cells), "packs")
    # Two whole numbers of each length of vector reach the driver.
    sizes = shards.groupBy("dims").agg(F.sum("n").alias("n")).collect()
    wide = {r["dims"]: max(1, math.ceil(r["n"] * r["dims"] / (shard_cells * shards_per_group))) for r in sizes}
    if not wide:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups = F.create_map(*[F.lit(x) for pair in wide.items() for x in pair])
    groups = F.coalesce(F.get(F.map_values(F.map_filter(groups, lambda d, _: d == F.col("dims"))), 0), F.lit(1))
    asked = packs.withColumn("bunch", F.explode(F.sequence(F.lit(0), groups - 1))).withColumn("pack", F.col("block"))
    # One small row per pack; Spark checks its size before it broadcasts the stored table.
    names = materialise(packs.select("dims", F.col("block").alias("pack")), "names")
    held = shards.withColumn("bunch", F.pmod(F.xxhash64("block"), groups).cast("int")).join(names, "dims")
    meet = ["dims", "pack", "bunch"]

    def search(pack_rows: pd.DataFrame, shard_rows: pd.DataFrame) -> pd.DataFrame:
        return search_group(list(pack_rows.itertuples()), list(shard_rows.itertuples()), k)

    found = asked.groupBy(*meet).cogroup(held.groupBy(*meet)).applyInPandas(search, FOUND)
    # High and low part of a score: the whole of it may be too long for a long.
    place = F.row_number().over(Window.partitionBy("query_key").orderBy(F.col("high").desc(), F.col("low").desc(), "vec_id"))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
