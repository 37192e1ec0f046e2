"""Exact nearest neighbours under squared Euclidean distance, optionally only among rows that are not newer.

Candidates are split into the cells of a two-level tree of pivot vectors. The distances from a query to pivots bound its k-th
neighbour distance, and the triangle inequality rules out leads and cells that cannot hold a nearer one. Cells and groups of
queries are cut into packs of bounded size, so a crowded region is spread over many tasks. Packs of both sides are dealt to
lanes of many rows, so small packs do not multiply the copies; pairs of packs are first made as ids, and a pack is copied only
to the lanes that a pair asks for.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timetab.operators.cells import CellTree, border_bounds, distances
from timetab.operators.ordering import hash_order, order_cutoffs
from timetab.session import materialise

MAX_PIVOTS = 1024
CELL_ROWS = 512
CELLS_PER_ROOT = 4
MAX_CELLS = 1 << 16
PACK_CANDIDATES = 2048
PACK_QUERIES = 1024
LANE_PACKS = 16
LANES = 16  # of either side, as long as a lane's vectors fit LANE_BYTES
LANE_BYTES = 64 << 20
BLOCK_QUERIES, BLOCK_CANDIDATES = 512, 2048
MANY_HITS = 8  # times k per query of a block; beyond, the border is tightened first
WIDEN = 64
TIME_SLICES = 16
FEISTEL_ROUNDS, FEISTEL_WALK, FEISTEL_PRIME = 6, 64, (1 << 61) - 1


def _sides(df: DataFrame, tag: str, id_: str, vector: str, time: str | None) -> DataFrame:
    if time is None:
        when = F.lit(0).cast("bigint")
    elif isinstance(df.schema[time].dataType, (T.TimestampType, T.TimestampNTZType)):
        when = F.unix_micros(F.col(time).cast("timestamp"))
    elif isinstance(df.schema[time].dataType, T.DateType):
        when = F.unix_date(time).cast("bigint")
    else:
        when = F.col(time).cast("bigint")
    return df.select(F.col(id_).cast("bigint").alias(f"{tag}_id"), when.alias(f"{tag}_t"), F.col(vector).alias(f"{tag}_v"))


def _pivots(candidates: DataFrame, n: int, most: int, cell_rows: int):
    """Candidates picked by hash: at most ``most`` pivots as (ids, times, vectors), and the tree of cells.

    The pivots bound the neighbour distances. Cells get ``cell_rows`` rows or more, so small tables have few of them, and
    their number grows with the root of the table: ``CELLS_PER_ROOT`` times it, up to ``MAX_CELLS``, which is what the
    driver holds.
    """
    import math

    import numpy as np

    cells = max(1, min(n // cell_rows, int(CELLS_PER_ROOT * math.sqrt(n)), MAX_CELLS))
    rows = candidates.orderBy(F.xxhash64("c_id"), "c_id").limit(max(most, cells)).toArrow()
    vectors = rows["c_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(rows.num_rows, -1)
    ids, times = (rows[c].to_numpy()[:most] for c in ("c_id", "c_t"))
    return ids, times, vectors[:most], CellTree.of(np.unique(vectors[:cells], axis=0))


def _to_cells(tree: CellTree):
    """Arrow batches of candidates, each with its cell, the distance to the cell's centre and to the cell's lead."""

    def run(batches):
        import numpy as np

        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["c_v"].to_numpy()).astype("float64")
                lead, cell = tree.locate(x)
                gap = np.sqrt(((x - tree.centres[cell]) ** 2).sum(1))
                lead_gap = np.sqrt(((x - tree.leads[lead]) ** 2).sum(1))
                yield pdf.assign(cell=cell.astype("int32"), gap=gap, lead_gap=lead_gap)

    return run


def _query_bounds(tree: CellTree, pivots, k: int, causal: bool, exclude_self: bool):
    """Arrow batches of queries with their home cell and an upper bound of their k-th squared distance."""
    ids, times, vectors, _ = pivots

    def run(batches):
        import numpy as np

        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["q_v"].to_numpy()).astype("float64")
            square = (x**2).sum(1)[:, None]
            home = tree.locate(x)[1]
            d2 = square + (vectors**2).sum(1)[None, :] - 2.0 * x @ vectors.T
            if causal:
                d2[times[None, :] > pdf["q_t"].to_numpy()[:, None]] = np.inf
            if exclude_self:
                d2[ids[None, :] == pdf["q_id"].to_numpy()[:, None]] = np.inf
            bound = np.full(len(x), np.inf)
            if len(ids) >= k:
                bound = np.partition(d2, k - 1, axis=1)[:, k - 1]
            slack = 1e-9 * (square[:, 0] + (vectors**2).sum(1).max())
            yield pdf.assign(home=home.astype("int32"), bound=np.maximum(bound, 0.0) + slack)

    return run


def _targets(tree: CellTree, cells, lanes: int, causal: bool):
    """Per pack of queries and lane of candidate packs, the packs there that can hold a neighbour of any of the queries, as ids only.

    A member c of the cell around centre p is no nearer than |q,p| - radius, nor than the border plane between p and the centre of
    the same lead that is nearest to q. The same holds for the leads, which are ruled out first with all their cells.
    """
    index, slices, radius, lead_radius, oldest, packs = cells

    def run(batches):
        import numpy as np
        import pandas as pd

        first = np.searchsorted(index, tree.starts)  # the slices are in order of their cell
        before = np.cumsum(packs) - packs  # packs are dealt to the lanes in their order
        held = [g for g in range(len(tree.leads)) if first[g] < first[g + 1]]
        reach_of = np.array([lead_radius[first[g] : first[g + 1]].max() for g in held])
        since = np.array([oldest[first[g] : first[g + 1]].min() for g in held])

        def near(low, reach, d):
            return low <= reach[:, None] * (1.0 + 1e-9) + 1e-9 * (1.0 + d)

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                times = np.asarray(row.q_ts)
                x = np.asarray(row.q_flat, dtype="float64").reshape(len(times), -1)
                reach = np.sqrt(np.asarray(row.bounds, dtype="float64"))
                d = distances(x, tree.leads)
                low = np.maximum(d[:, held] - reach_of[None, :], border_bounds(d, tree.leads)[:, held])
                open_ = near(low, reach, d[:, held])
                if causal:
                    open_ &= since[None, :] <= times[:, None]
                hits = []
                for j in np.flatnonzero(open_.any(0)):
                    g, own = held[j], np.flatnonzero(open_[:, j])
                    centres, span = tree.centres[tree.starts[g] : tree.starts[g + 1]], slice(first[g], first[g + 1])
                    inside = distances(x[own], centres)
                    at = index[span] - tree.starts[g]
                    low_cell = np.maximum(inside[:, at] - radius[span][None, :], border_bounds(inside, centres)[:, at])
                    found = near(low_cell, reach[own], inside[:, at])
                    if causal:
                        found &= oldest[span][None, :] <= times[own][:, None]
                    hits.append(first[g] + np.flatnonzero(found.any(0)))
                hit = np.concatenate([np.empty(0, dtype=np.int64), *hits])
                salt = np.arange(packs[hit].sum()) - np.repeat(np.cumsum(packs[hit]) - packs[hit], packs[hit])
                hit = np.repeat(hit, packs[hit])
                lane = (before[hit] + salt) % lanes
                at = [np.flatnonzero(lane == i) for i in np.unique(lane)]
                yield pd.DataFrame({
                    "pack_id": row.pack_id, "target_lane": np.unique(lane).astype("int32"), "cell": [index[hit[i]] for i in at],
                    "slice": [slices[hit[i]] for i in at], "salt": [salt[i].astype("int32") for i in at],
                })

    return run


def _top(found: list, k: int) -> tuple:
    """Of hits as (place of the query, id, time, distance), the k nearest of each query by (distance, time, id)."""
    import numpy as np

    a, ids, when, exact = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, when, exact, a))
    a = a[order]
    kept = np.arange(len(a)) - np.searchsorted(a, a, side="left") < k
    top = order[kept]
    return a[kept], ids[top], when[top], exact[top]


def _nearest_in_block(queries, candidates, k: int, causal: bool, exclude_self: bool) -> tuple:
    """The k nearest candidates of each query of a block. Both come as (ids, times, vectors), queries with their bounds besides.

    One float64 matrix product screens a chunk of candidates; those near the border are measured again by plain differences, so
    exact copies have distance 0 and ties are broken by id. The border of a query falls with what was found.
    """
    import numpy as np

    qi, qt, q, limit = queries
    ci, ct, c = candidates
    qq, cc, limit = (q**2).sum(1), (c**2).sum(1), limit.copy()
    wide = np.concatenate([q, np.ones((len(q), 1))], axis=1)  # times (c, -cc/2): the squared distance is qq - 2 * product
    kinds = [np.empty(0, kind) for kind in ("int64", "int64", "int64", "float64")]
    best, fresh, waiting = tuple(kinds), [], 0

    def settled() -> tuple:
        top = _top([best, *fresh], k) if fresh else best
        a, _, _, exact = top
        full = np.flatnonzero(np.bincount(a, minlength=len(q)) == k)
        limit[full] = np.minimum(limit[full], exact[np.searchsorted(a, full, side="right") - 1])
        return top

    for start in range(0, len(c), BLOCK_CANDIDATES):
        ids, when, x = (v[start : start + BLOCK_CANDIDATES] for v in (ci, ct, c))
        half = cc[start : start + BLOCK_CANDIDATES]
        slack = 1e-9 * (qq + half.max())
        product = wide @ np.concatenate([x, -0.5 * half[:, None]], axis=1).T
        near = product >= (0.5 * (qq - limit - slack))[:, None]
        if len(x) > k and np.count_nonzero(near) > MANY_HITS * k * len(q):
            if causal:
                product[when[None, :] > qt[:, None]] = -np.inf
            if exclude_self:
                product[ids[None, :] == qi[:, None]] = -np.inf
            border = np.partition(product, len(x) - k, axis=1)[:, len(x) - k]
            np.minimum(limit, qq - 2.0 * border + slack, out=limit, where=np.isfinite(border))
            near = product >= (0.5 * (qq - limit - slack))[:, None]
        place = np.flatnonzero(near)
        a, b = np.divmod(place, len(x))
        sound = np.isfinite(product.ravel()[place])
        if causal:
            sound &= when[b] <= qt[a]
        if exclude_self:
            sound &= ids[b] != qi[a]
        a, b = a[sound], b[sound]
        if not len(a):
            continue
        exact = np.empty(len(a))
        for s in range(0, len(a), 65536):
            exact[s : s + 65536] = ((q[a[s : s + 65536]] - x[b[s : s + 65536]]) ** 2).sum(1)
        fresh.append((a, ids[b], when[b], exact))
        waiting += len(a)
        if waiting > len(q):
            best, fresh, waiting = settled(), [], 0
    a, ids, when, exact = settled()
    return qi[a], ids, when, exact


def _nearest_in_lanes(k: int, causal: bool, exclude_self: bool):
    """One lane of query packs against one lane of candidate packs: the k nearest of the packs that each query pack asked for, by
    (distance, time, id).

    Query packs that ask for the same candidate packs are searched together. With time both sides are in order of it, and a block of
    queries meets only the candidates that are not newer than its last one.
    """

    def run(asked, held):
        import numpy as np
        import pandas as pd

        parts = [[np.empty(0, kind)] for kind in ("int64", "int64", "int64", "float64")]
        names = ("query_id", "candidate_id", "candidate_t", "distance")
        if len(asked) and len(held):
            places = {key: i for i, key in enumerate(zip(held["cell"], held["slice"], held["salt"]))}
            ci, ct = (np.concatenate(held[c].to_numpy()) for c in ("c_ids", "c_ts"))
            c = np.concatenate(held["c_flat"].to_numpy()).astype("float64").reshape(len(ci), -1)
            pack = np.repeat(np.arange(len(held)), [len(ids) for ids in held["c_ids"]])
            if causal:
                order = np.argsort(ct, kind="stable")
                ci, ct, c, pack = ci[order], ct[order], c[order], pack[order]
            together: dict[bytes, list[int]] = {}
            for i, wanted in enumerate(asked["wanted"]):
                found = (places.get((w["cell"], w["slice"], w["salt"])) for w in wanted)
                # No row of a slice may have fallen to a salt.
                at = np.zeros(len(held), dtype=bool)
                at[[p for p in found if p is not None]] = True
                together.setdefault(at.tobytes(), []).append(i)
            for wanted, packs in together.items():
                own = asked.iloc[packs]
                rows = np.flatnonzero(np.frombuffer(wanted, dtype=bool)[pack])
                qi, qt, bound = (np.concatenate(own[f].to_numpy()) for f in ("q_ids", "q_ts", "bounds"))
                q = np.concatenate(own["q_flat"].to_numpy()).astype("float64").reshape(len(qi), -1)
                whole = len(rows) == len(ci)
                vi, vt, v = (ci, ct, c) if whole else (ci[rows], ct[rows], c[rows])
                if causal:
                    order = np.argsort(qt, kind="stable")
                    qi, qt, q, bound = qi[order], qt[order], q[order], bound[order]
                for s in range(0, len(qi), BLOCK_QUERIES):
                    block = tuple(x[s : s + BLOCK_QUERIES] for x in (qi, qt, q, bound))
                    upto = np.searchsorted(vt, block[1][-1], side="right") if causal else len(vi)
                    for list_, values in zip(parts, _nearest_in_block(block, (vi[:upto], vt[:upto], v[:upto]), k, causal, exclude_self)):
                        list_.append(values)
        return pd.DataFrame({n: np.concatenate(v) for n, v in zip(names, parts)})

    return run


def _pack_count(n: Column, size: int) -> Column:
    return F.ceil(n / F.lit(size)).cast("int")


_RESULT = "query_id bigint, candidate_id bigint, distance double, rank int"


def _lanes_of(rows: int, least: int, width: int) -> int:
    """Lanes of a side: at least ``least`` rows to each, and more rather than further lanes, since the other side is copied to each."""
    return max(1, -(-rows // max(least, min(-(-rows // LANES), LANE_BYTES // (8 * width)))))


def _routed(
    queries: DataFrame, cells: DataFrame, tree: CellTree, n: int, causal: bool, lane_packs: int
) -> tuple[DataFrame, DataFrame]:
    """``(query packs, candidate packs)``, each copied to the pairs of lanes in which one asks for the other.

    Query packs carry the list ``wanted`` of candidate packs that they ask for there. Which packs meet is worked out on ids.
    """
    import numpy as np

    part = F.lit(0)
    slices = max(1, min(TIME_SLICES, n // (len(tree.centres) * PACK_CANDIDATES)))
    if causal and slices > 1:
        marks = cells.agg(F.percentile_approx("c_t", [i / slices for i in range(1, slices)], 1000)).first()[0]
        for m in marks or []:
            part = part + (F.col("c_t") > m).cast("int")
    sliced = cells.withColumn("slice", part)
    stats = materialise(sliced.groupBy("cell", "slice").agg(
        F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"), F.max("lead_gap").alias("lead_radius"), F.min("c_t").alias("oldest")
    ).withColumn("packs", _pack_count(F.col("n"), PACK_CANDIDATES)), "slices")
    known = stats.orderBy("cell", "slice").toArrow()  # at most MAX_CELLS * TIME_SLICES rows of six numbers
    table = tuple(
        known[f].to_numpy().astype(t) for f, t in
        (("cell", "int32"), ("slice", "int32"), ("radius", "float64"), ("lead_radius", "float64"), ("oldest", "int64"), ("packs", "int32"))
    )
    rows, width = int(np.sum(known["n"].to_numpy())), tree.centres.shape[1]
    target_lanes = _lanes_of(rows, lane_packs * PACK_CANDIDATES, width)
    packed = (
        sliced.join(F.broadcast(stats.select("cell", "slice", "packs")), ["cell", "slice"])
        .withColumn("salt", F.pmod(F.xxhash64("c_id"), F.col("packs")).cast("int"))
        .groupBy("cell", "slice", "salt")
        .agg(F.collect_list(F.struct("c_id", "c_t", "c_v")).alias("g"))
        .select(
            "cell", "slice", "salt", F.col("g.c_id").alias("c_ids"), F.col("g.c_t").alias("c_ts"),
            F.flatten("g.c_v").alias("c_flat"),
        )
    )

    homes = queries.groupBy("home").agg(F.count(F.lit(1)).alias("n")).withColumn("q_packs", _pack_count(F.col("n"), PACK_QUERIES))
    query_packs = materialise(
        queries.join(F.broadcast(homes.select("home", "q_packs")), "home")
        .withColumn("q_salt", F.pmod(F.xxhash64("q_id"), F.col("q_packs")).cast("int"))
        .groupBy("home", "q_salt")
        .agg(F.collect_list(F.struct("q_id", "q_t", "q_v", "bound")).alias("g"))
        .select(
            F.concat_ws("/", "home", "q_salt").alias("pack_id"), F.col("g.q_id").alias("q_ids"),
            F.col("g.q_t").alias("q_ts"), F.flatten("g.q_v").alias("q_flat"), F.col("g.bound").alias("bounds"),
        ),
        "query-packs",
    )
    lanes = _lanes_of(homes.agg(F.sum("n")).first()[0] or 0, lane_packs * PACK_QUERIES, width)
    target = ["cell", "slice", "salt"]
    wanted = materialise(
        query_packs.mapInPandas(
            _targets(tree, table, target_lanes, causal), "pack_id string, target_lane int, cell array<int>, slice array<int>, salt array<int>"
        ).select("pack_id", F.pmod(F.xxhash64("pack_id"), F.lit(lanes)).cast("int").alias("lane"), "target_lane", F.arrays_zip(*target).alias("wanted")),
        "routes",
    )
    routes = wanted.select(F.col("lane").alias("for_lane"), F.col("target_lane").alias("in_lane"), F.explode("wanted").alias("w"))
    copies = routes.select(*[f"w.{t}" for t in target], "for_lane", "in_lane").distinct()
    return wanted.join(query_packs, "pack_id"), packed.join(copies, target)


def _search(
    queries: DataFrame, cells: DataFrame, tree: CellTree, n: int, k: int, causal: bool, exclude_self: bool, lane_packs: int
) -> DataFrame:
    """Top k per query among the rows of ``cells``, given queries with home cell and distance bound."""
    asked, held = _routed(queries, cells, tree, n, causal, lane_packs)
    partial = asked.groupBy("lane", "target_lane").cogroup(held.groupBy("for_lane", "in_lane")).applyInPandas(
        _nearest_in_lanes(k, causal, exclude_self),
        "query_id bigint, candidate_id bigint, candidate_t bigint, distance double",
    )
    # Each task keeps k rows per query before the shuffle.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "candidate_t", "candidate_id"))
    best = partial.withColumn("rank", place).where(F.col("rank") <= k)
    return materialise(best.select("query_id", "candidate_id", "distance", "rank"), "neighbours")


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    *,
    id_: str = "vec_id",
    vector: str = "embedding",
    time: str | None = None,
    exclude_self: bool = False,
    pivots: int = MAX_PIVOTS,
    cell_rows: int = CELL_ROWS,
    widen: int = WIDEN,
    lane_packs: int = LANE_PACKS,
) -> DataFrame:
    """(query_id, candidate_id, distance, rank) of the k nearest candidates per query, as a stored table.

    With ``time`` only candidates that are not newer than the query take part, tested before the top k is taken.
    Ties in distance go to the older candidate, then to the smaller id. ``distance`` is squared. A query with fewer than
    k valid candidates has fewer rows.

    Large tables are searched in widening rounds: the k-th distance within a hashed share of the candidates bounds the
    next round, so that no round hands on more than about ``widen`` * k rows per query. The last round sees all rows.
    ``lane_packs`` is the number of full packs that a task holds of either side at least; on larger tables it holds a
    ``LANES``-th of either side, up to ``LANE_BYTES`` of vectors.
    """
    causal = time is not None
    cand, qry = _sides(candidates, "c", id_, vector, time), _sides(queries, "q", id_, vector, time)
    n = candidates.count()
    if n == 0:
        return queries.sparkSession.createDataFrame([], _RESULT)
    found_pivots = _pivots(cand, n, pivots, cell_rows)
    tree = found_pivots[3]

    # Of equal vectors, no query can need more than the k (and itself) that come first by time and id.
    keep = k + int(exclude_self)
    copies = Window.partitionBy(F.xxhash64("c_v"), "c_v").orderBy("c_t", "c_id")
    useful = cand.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= keep).drop("copy")
    kind = cand.schema["c_v"].dataType.simpleString()
    cells = materialise(
        useful.mapInPandas(_to_cells(tree), f"c_id bigint, c_t bigint, c_v {kind}, cell int, gap double, lead_gap double"), "cells"
    )
    bounded = materialise(
        qry.mapInPandas(
            _query_bounds(tree, found_pivots, k, causal, exclude_self), f"q_id bigint, q_t bigint, q_v {kind}, home int, bound double"
        ),
        "queries",
    )
    size = pivots
    while size * widen < n:
        size *= widen
        share = cells.where(F.pmod(F.xxhash64("c_id"), F.lit(-(-n // size))) == 0)
        found = _search(bounded, share, tree, size, k, causal, exclude_self, lane_packs)
        tighter = found.where(F.col("rank") == k).select(F.col("query_id").alias("q_id"), (F.col("distance") * (1.0 + 1e-9)).alias("kth"))
        bounded = materialise(
            bounded.join(tighter, "q_id", "left").withColumn("bound", F.least("bound", "kth")).drop("kth"), "queries"
        )
    return _search(bounded, cells, tree, n, k, causal, exclude_self, lane_packs)


def context_misses(queries: DataFrame, neighbours: DataFrame, k: int, id_: str = "vec_id") -> DataFrame:
    """How many of the k wanted neighbours each query lacks; queries without any are kept."""
    found = neighbours.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    return queries.select(F.col(id_).cast("bigint").alias("query_id")).join(found, "query_id", "left").select(
        "query_id", F.greatest(F.lit(0).cast("bigint"), F.lit(k) - F.coalesce("found", F.lit(0))).alias("misses")
    )


def with_candidates(neighbours: DataFrame, candidates: DataFrame, columns: Sequence[str], id_: str = "vec_id") -> DataFrame:
    """Neighbour pairs with columns of the candidate row."""
    rows = candidates.select(F.col(id_).cast("bigint").alias("candidate_id"), *columns)
    return neighbours.join(rows, "candidate_id")


def neighbour_mean(neighbours: DataFrame, candidates: DataFrame, y: str, id_: str = "vec_id") -> DataFrame:
    """Label mean over each query's neighbours, weighted by the softmax of the negative squared distance."""
    rows = with_candidates(neighbours, candidates, [F.col(y).cast("double").alias("_y")], id_)
    nearest_ = Window.partitionBy("query_id")
    weight = F.exp(-(F.col("distance") - F.min("distance").over(nearest_)))
    return rows.withColumn("_w", weight).groupBy("query_id").agg(
        (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("y_mean"), F.max(F.col("_w")).alias("top_weight")
    )


def candidate_step(df: DataFrame, id_: str, size: int | float, step: int, seed: Any = 0) -> DataFrame:
    """The candidates of one training step: the next ``size`` rows of a seeded permutation, then of the next one.

    A step that reaches past the end of a permutation goes on in the following one, so a row can be drawn twice; the
    column ``pass`` tells the permutations apart. ``size`` below 1 is a share of all rows.
    """
    n = df.count()
    size = int(size * n) if isinstance(size, float) else size
    if not 0 < size < n:
        raise ValueError(f"a step needs between 1 and {n - 1} candidates")
    start, out = step * size, None
    while size > 0:
        turn, at = divmod(start, n)
        take = min(size, n - at)
        hashed = df.withColumn("_h", hash_order(f"{seed}/{turn}", id_))
        low, high = order_cutoffs(hashed.select("_h", id_), ["_h", id_], [at, at + take])
        rows = hashed.where(low.reached() & ~high.reached()).drop("_h").withColumn("pass", F.lit(turn))
        out = rows if out is None else out.unionByName(rows)
        start, size = start + take, size - take
    return out


def _rounds(n: int, keys: Sequence[tuple[int, int]], x: Column) -> Column:
    """Rounds of a Feistel network over the two digits of a place below ``a * b``, b being the second digit's base: each adds a keyed
    function of one digit to the other, so that the whole is a permutation."""
    a, b = _digits(n)
    high, low = F.floor(x / F.lit(b)).cast("long"), F.pmod(x, F.lit(b))
    for i, (p, q) in enumerate(keys):
        moved, still, base = (high, low, a) if i % 2 == 0 else (low, high, b)
        moved = F.pmod(moved + F.pmod((still + p) * (still + q), F.lit(FEISTEL_PRIME)), F.lit(base))
        high, low = (moved, still) if i % 2 == 0 else (still, moved)
    return high * b + low


def _digits(n: int) -> tuple[int, int]:
    import math

    a = math.isqrt(n - 1) + 1
    return a, -(-n // a)


def feistel_keys(seed: Any, turn: int) -> list[tuple[int, int]]:
    """Two numbers below 2**30 per round."""
    import hashlib

    def number(i: int, side: int) -> int:
        return int(hashlib.md5(f"{seed}/{turn}/{i}/{side}".encode()).hexdigest()[:15], 16) % (1 << 30)

    return [(number(i, 0), number(i, 1)) for i in range(FEISTEL_ROUNDS)]


def permuted_place(place: Column, n: int, seed: Any, turn: int) -> Column:
    """The place of a row in a keyed permutation of ``n`` rows (below 2**60), from its own place alone.

    The network permutes a few more places than there are; a row that lands past the end walks on until it is inside.
    """
    a, b = _digits(n)
    keys = feistel_keys(seed, turn)
    first = _rounds(n, keys, place.cast("long"))
    if a * b == n:
        return first
    # No walk is longer than the places past the end; that one is longer than FEISTEL_WALK has a chance below 2**-384.
    steps = F.sequence(F.lit(1), F.lit(min(a * b - n, FEISTEL_WALK)))
    return F.aggregate(steps, first, lambda y, _: F.when(y < n, y).otherwise(_rounds(n, keys, y)))


def permuted_step(placed: DataFrame, n: int, size: int, step: int, seed: Any = 0, place: str = "place") -> DataFrame:
    """As ``candidate_step``, of rows whose dense ``place`` (0 to ``n`` - 1) is stored: one narrow scan, and each row knows by
    arithmetic whether it takes part. Places are made once for all steps (``global_position``)."""
    if not 0 < size < n:
        raise ValueError(f"a step needs between 1 and {n - 1} candidates")
    start, out = step * size, None
    while size > 0:
        turn, at = divmod(start, n)
        take = min(size, n - at)
        drawn = permuted_place(F.col(place), n, seed, turn)
        rows = placed.where((drawn >= at) & (drawn < at + take)).withColumn("pass", F.lit(turn))
        out = rows if out is None else out.unionByName(rows)
        start, size = start + take, size - take
    return out


def distinct_neighbours(neighbours: DataFrame) -> DataFrame:
    """Each candidate that is a neighbour of any query, with how many queries use it."""
    return neighbours.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_queries"))
