"""Covariance of feature columns, overall and inside overlapping time domains, and the gap between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetab.operators.ordering import time_folds

BLOCK_CELLS = 1 << 16
MERGE_TASKS = 16
_BLOCKS = "grp int, block int, bunch int, sums binary"


def _merged(pdf):
    """The sum of blocks of one group and number."""
    import numpy as np
    import pandas as pd

    total = np.sum([np.frombuffer(s) for s in pdf["sums"]], axis=0)
    return pd.DataFrame({**{c: pdf[c].iloc[:1] for c in ("grp", "block", "bunch")}, "sums": [total.tobytes()]})


def block_sums(df: DataFrame, columns: Sequence[str], by: str | None = None) -> tuple[DataFrame, int]:
    """``(grp, block, sums)``, and the columns a block has: a few rows of the matrices of pairwise counts and sums, as bytes.

    Each task adds up the outer products of its rows and sends one row per group and block; they are merged in two steps.
    """
    known = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(known)]).first()
    group = F.col(by).cast("int") if by else F.lit(0)
    x = df.select(group.alias("grp"), *[(v - (means[i] or 0.0)).alias(f"x{i}") for i, v in enumerate(known)])
    d = len(columns)
    width = max(1, BLOCK_CELLS // d)

    def outer(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        total = {}
        for pdf in batches:
            for g, rows in pdf.groupby("grp"):
                m = rows.drop(columns="grp").to_numpy(dtype="float64", na_value=np.nan)
                there = (~np.isnan(m)).astype("float64")
                m = np.nan_to_num(m, nan=0.0, posinf=np.inf, neginf=-np.inf)
                sums = (there.T @ there, m.T @ there, m.T @ m)
                total[g] = tuple(p + q for p, q in zip(total[g], sums)) if g in total else sums
        bunch = TaskContext.get().partitionId() // MERGE_TASKS
        for g, (n, s, p) in total.items():
            yield pd.DataFrame([
                (g, k, bunch, np.stack([m[a : a + width, a:] for m in (n, s, s.T, p)]).tobytes()) for k, a in enumerate(range(0, d, width))
            ], columns=["grp", "block", "bunch", "sums"])

    parts = x.mapInPandas(outer, _BLOCKS).groupBy("grp", "block", "bunch").applyInPandas(_merged, _BLOCKS)
    return parts.groupBy("grp", "block").applyInPandas(_merged, _BLOCKS).drop("bunch"), width


def _opened(sums: bytes, block: int, width: int, d: int):
    """``(n, sum_i, sum_j, sum_ij)`` of a block, and which of its cells have i <= j; the first row and column is ``block * width``."""
    import numpy as np

    first = block * width
    cells = np.frombuffer(sums).reshape(4, min(width, d - first), d - first)
    return cells, np.triu(np.ones(cells.shape[1:], dtype=bool))


def centred_sums(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """(group, i, j, n, sum_i, sum_j, sum_ij) for i <= j over columns centred at their overall mean.

    Each pair counts the rows where both of its values are present; null and NaN are missing. Groups can be merged by
    adding the sums.
    """
    blocks, width = block_sums(df, columns, by)
    d = len(columns)

    def spread(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for g, k, sums in zip(pdf["grp"], pdf["block"], pdf["sums"]):
                cells, upper = _opened(sums, k, width, d)
                i, j = np.nonzero(upper)
                n, sum_i, sum_j, sum_ij = (c[i, j] for c in cells)
                yield pd.DataFrame({
                    "grp": g, "i": i + k * width, "j": j + k * width, "n": n.astype("int64"), "sum_i": sum_i, "sum_j": sum_j, "sum_ij": sum_ij,
                })

    return blocks.mapInPandas(spread, "grp int, i int, j int, n bigint, sum_i double, sum_j double, sum_ij double")


def _covariance(n: str = "n"):
    return (F.col("sum_ij") - F.col("sum_i") * F.col("sum_j") / F.col(n)) / (F.col(n) - 1)


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample covariance as (i, j, cov) with column names, i before or equal to j, over the rows where both are present.

    It is null for pairs with fewer than two such rows.
    """
    names = F.array(*[F.lit(c) for c in columns])
    return centred_sums(df, columns).select(
        F.element_at(names, F.col("i") + 1).alias("i"), F.element_at(names, F.col("j") + 1).alias("j"),
        F.when(F.col("n") > 1, _covariance()).alias("cov"),
    )


def time_domains(df: DataFrame, time: str, folds: int = 9) -> DataFrame:
    """One row per row and overlapping domain: domain i covers folds i .. i + (folds+1)/2 - 1."""
    width = (folds + 1) // 2
    domains = F.sequence(F.greatest(F.lit(0), F.col("fold") - (width - 1)), F.least(F.col("fold"), F.lit(width - 1)))
    return time_folds(df, time, folds).withColumn("domain", F.explode(domains))


def covariance_gap(df: DataFrame, time: str, columns: Sequence[str], folds: int = 9) -> DataFrame:
    """One row: the mean over domains of ||C_all - C_domain||^2 / (4 d^2), domains with more than one row.

    Rows are aggregated once per fold; a domain is the sum of its folds' sums, so no row is repeated per domain. What is shuffled is
    a few blocks of sums per task and fold.
    """
    d, folds_in = len(columns), (folds + 1) // 2
    blocks, width = block_sums(time_folds(df.select(time, *columns), time, folds), columns, by="fold")

    def gaps(key, pdf):
        import numpy as np
        import pandas as pd

        cells = {}
        for g, sums in zip(pdf["grp"], pdf["sums"]):
            cells[g], upper = _opened(sums, key[0], width, d)

        def covariances(parts):
            n, sum_i, sum_j, sum_ij = sum(parts)
            with np.errstate(divide="ignore", invalid="ignore"):
                return n > 1, (sum_ij - sum_i * sum_j / n) / (n - 1)

        _, whole = covariances(cells.values())
        twice = np.where(np.eye(*upper.shape, dtype=bool), 1.0, 2.0)
        out = []
        for domain in range(folds_in):
            parts = [c for g, c in cells.items() if domain <= g < domain + folds_in]
            if parts:
                known, inside = covariances(parts)
                known &= upper
                if known.any():
                    out.append((domain, float(((whole - inside) ** 2 * twice)[known].sum())))
        return pd.DataFrame(out, columns=["domain", "square"])

    found = blocks.groupBy("block").applyInPandas(gaps, "domain int, square double")
    return found.agg(
        F.count_distinct("domain").alias("domains"), (F.sum("square") / (4.0 * d * d) / F.count_distinct("domain")).alias("gap")
    )
