"""Exact, linearly interpolated quantiles of many columns at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timetab.operators.ordering import prefix_totals

STEPS = 16_384
MOST_STEPS = 1 << 20
LEAF_ROWS = 100_000
MERGE_TASKS = 16


def quantile_grid(
    df: DataFrame, columns: Sequence[str], points: int, exact: bool = True, leaf_rows: int = LEAF_ROWS
) -> dict[str, list[float]]:
    """``points`` evenly spaced quantiles (0 to 1) per column, nulls and NaN left out.

    Exact: each task counts all columns in equal steps, as one matrix; only the values of steps that hold a grid point are ranked, each
    step for itself. Columns with a crowded step (more than ``leaf_rows`` rows and values of its own) are ranked by prefix
    sums over all their values instead. No column is ever gathered in one task; the driver receives columns x points numbers. ``exact=False`` uses ``percentile_approx``.
    """
    if not exact:
        shares = [i / (points - 1) for i in range(points)]
        row = df.agg(*[
            F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), shares, 10 * points).alias(c)
            for c in columns
        ]).first()
        return {c: [float(v) for v in row[c] or []] for c in columns}

    known = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    first = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(known.values()) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    bounds = {c: (first[f"n{i}"], first[f"lo{i}"], first[f"hi{i}"]) for i, c in enumerate(columns)}
    even = [c for c, (n, lo, hi) in bounds.items() if n and lo < hi and math.isfinite(hi - lo)]
    out: dict[str, list[float]] = {c: [] if not n else [lo] * points for c, (n, lo, hi) in bounds.items() if not n or lo == hi}
    found = _by_steps(df.select(*[known[c].alias(c) for c in even]), even, bounds, points, leaf_rows) if even else {}
    rest = [c for c in columns if c not in out and c not in found]
    return {**out, **found, **(_by_prefix_sums(df, rest, points) if rest else {})}


def _step_of(x, bounds: tuple, steps: int):
    """The equal step between the bounds that each value lies in."""
    import numpy as np

    _, lo, hi = bounds
    return np.minimum(np.floor((x - lo) / (hi - lo) * steps), steps - 1).astype(np.int64)


def _merged(pdf):
    """Counts, least and largest values of a column's steps, added up."""
    import numpy as np
    import pandas as pd

    cells = np.stack([np.frombuffer(s).reshape(3, -1) for s in pdf["cells"]])
    total = np.stack([cells[:, 0].sum(axis=0), cells[:, 1].min(axis=0), cells[:, 2].max(axis=0)])
    return pd.DataFrame({"c": pdf["c"].iloc[:1], "bunch": pdf["bunch"].iloc[:1], "cells": [total.tobytes()]})


def _by_steps(df: DataFrame, columns: list[str], bounds: dict[str, tuple], points: int, leaf_rows: int) -> dict[str, list[float]]:
    """Grids of the columns without a crowded step."""
    steps = max(1, min(STEPS, MOST_STEPS // len(columns)))
    ends = [bounds[c] for c in columns]
    rows = df.select(*[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])

    def values_of(batch):
        import numpy as np

        for i, column in enumerate(batch.columns):
            x = column.to_numpy(zero_copy_only=False)
            yield i, x[~np.isnan(x)]

    def count(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        n, lo, hi = np.zeros((len(ends), steps)), np.full((len(ends), steps), np.inf), np.full((len(ends), steps), -np.inf)
        for batch in batches:
            for i, x in values_of(batch):
                at = _step_of(x, ends[i], steps)
                n[i] += np.bincount(at, minlength=steps)
                np.minimum.at(lo[i], at, x)
                np.maximum.at(hi[i], at, x)
        bunch = TaskContext.get().partitionId() // MERGE_TASKS
        cells = [np.stack([n[i], lo[i], hi[i]]).tobytes() for i in range(len(ends))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(ends)), pa.int32()), pa.array([bunch] * len(ends), pa.int32()), pa.array(cells, pa.binary())], names=["c", "bunch", "cells"])

    def choose(key, pdf):
        """Where each wanted place of the column lies: its value, or its step and its place in there."""
        import numpy as np
        import pandas as pd

        n, lo, hi = np.frombuffer(_merged(pdf)["cells"].iloc[0]).reshape(3, -1)
        upto = np.cumsum(n.astype(np.int64))
        places = np.array(sorted({p for j in range(points) for p in _ends(j, ends[key[0]][0], points)}))
        step = np.searchsorted(upto, places, side="right")
        single = lo[step] == hi[step]
        return pd.DataFrame({
            "c": key[0], "place": places, "step": step, "inside": places - np.append(0, upto)[step], "v": np.where(single, lo[step], np.nan),
            "known": single, "crowded": ~single & (n[step] > leaf_rows),
        })

    cells = "c int, bunch int, cells binary"
    # One row per task and column, merged in two steps; a row per wanted place reaches the driver.
    counted = rows.mapInArrow(count, cells).groupBy("c", "bunch").applyInPandas(_merged, cells)
    placed = counted.groupBy("c").applyInPandas(
        choose, "c int, place long, step int, inside long, v double, known boolean, crowded boolean").toPandas()
    crowded = set(placed["c"][placed["crowded"]].tolist())
    placed = placed[~placed["c"].isin(crowded)]
    values = {(c, p): v for c, p, v in placed[placed["known"]][["c", "place", "v"]].itertuples(index=False)}
    asked = placed[~placed["known"]][["c", "step", "place", "inside"]]
    if len(asked):
        open_steps = {c: sorted(set(own["step"])) for c, own in asked.groupby("c")}

        def inside(batches):
            import numpy as np
            import pyarrow as pa

            wanted = {c: np.isin(np.arange(steps), at) for c, at in open_steps.items()}
            for batch in batches:
                for i, x in values_of(batch):
                    if i in wanted:
                        at = _step_of(x, ends[i], steps)
                        v, n = np.unique(x[wanted[i][at]], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(v), i, dtype=np.int32)), pa.array(_step_of(v, ends[i], steps).astype(np.int32)), pa.array(v), pa.array(n)],
                            names=["c", "step", "v", "n"])

        ask = df.sparkSession.createDataFrame(list(map(tuple, asked.to_numpy().tolist())), "c int, step int, place long, inside long")
        found = rows.mapInArrow(inside, "c int, step int, v double, n long").groupBy("c", "step", "v").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("c", "step").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        ranked = found.withColumn("upto", upto).join(ask, ["c", "step"]).where("inside < upto AND inside >= upto - n")
        values |= {(r["c"], r["place"]): r["v"] for r in ranked.select("c", "place", "v").collect()}
    out = {}
    for i, c in enumerate(columns):
        if i in crowded:
            continue
        span, grid = bounds[c][0] - 1, points - 1
        out[c] = []
        for j in range(points):
            low, high = (values[i, p] for p in _ends(j, span + 1, points))
            out[c].append(low + (high - low) * ((j * span) % grid / grid))
    return out


def _ends(j: int, rows: int, points: int) -> tuple[int, int]:
    """The places of the two values that grid point j lies between."""
    low, rest = divmod(j * (rows - 1), points - 1)
    return low, low + (rest > 0)


def _by_prefix_sums(df: DataFrame, columns: Sequence[str], points: int) -> dict[str, list[float]]:
    """Rows are counted per (column, value), given their place by range-partitioned prefix sums, and each value works out by
    whole-number arithmetic which grid points it serves."""
    pairs = [F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]
    long = df.select(F.explode(F.array(*pairs)).alias("e")).select("e.c", "e.v")
    counts = long.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    local = prefix_totals(counts, ["c", "v"], {"b": "n"}, within=["c"]).withColumnRenamed("b_total", "total")

    # Grid point j stands at j*(total-1)/(points-1). A value covers the row places b .. b+n-1.
    grid = F.lit(points - 1)
    span = F.col("total") - 1
    steps = F.greatest(span, F.lit(1))
    last = F.col("b") + F.col("n") - 1
    hi = F.lit(points - 1).cast("long")

    def floor_div(a, b):
        return ((a - F.pmod(a, b)) / b).cast("long")

    def ceil_div(a, b):
        return -floor_div(-a, b)

    one_row = span == 0
    floor_from = F.when(one_row, F.lit(0)).otherwise(ceil_div(F.col("b") * grid, steps))
    floor_to = F.when(one_row, hi).otherwise(F.least(hi, ceil_div((last + 1) * grid, steps) - 1))
    ceil_from = F.when(one_row, F.lit(0)).otherwise(F.greatest(F.lit(0), floor_div((F.col("b") - 1) * grid, steps) + 1))
    ceil_to = F.when(one_row, hi).otherwise(F.least(hi, floor_div(last * grid, steps)))

    def serves(start, end):
        start, end = start.cast("long"), end.cast("long")
        return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<bigint>"))

    below = F.transform(serves(floor_from, floor_to), lambda j: F.struct(j.alias("j"), F.lit(0).alias("side")))
    above = F.transform(serves(ceil_from, ceil_to), lambda j: F.struct(j.alias("j"), F.lit(1).alias("side")))
    served = local.select("c", "total", "v", F.explode(F.concat(below, above)).alias("s"))
    ends = served.groupBy("c", "total", F.col("s.j").alias("j")).agg(
        F.max(F.when(F.col("s.side") == 0, F.col("v"))).alias("lo"),
        F.max(F.when(F.col("s.side") == 1, F.col("v"))).alias("up"),
    )
    share = F.pmod(F.col("j") * span, grid) / grid
    rows = ends.select("c", "j", (F.col("lo") + (F.col("up") - F.col("lo")) * share).alias("q")).collect()
    out: dict[str, list[float]] = {c: [] for c in columns}
    for r in sorted(rows, key=lambda r: (r["c"], r["j"])):
        out[columns[r["c"]]].append(r["q"])
    return out
