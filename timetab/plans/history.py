"""History features: what an entity did before (or around) its anchor date, in growing time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetab.operators.aggregates import any_of_group, conditional_total
from timetab.operators.joins import lookup_join

# Horizons in days.
HORIZONS = [1, 3, 7, 14, 21, 28, 60, 90, 120, 150, 180]


def history_features(
    events: DataFrame,
    anchors: DataFrame,
    *,
    id_: str,
    date: str,
    anchor_date: str,
    matches: dict[str, tuple[str, str]],
    quantity: str,
    amount: str,
    carry: Sequence[str] = (),
    horizons: Sequence[int] = tuple(HORIZONS),
    min_days: int | None = 0,
) -> DataFrame:
    """Per anchored entity: total spend, and per match flag and horizon the count, quantity and amount.

    ``matches`` names a flag and the event and anchor columns that must be equal. An event counts in horizon d when it
    is fewer than d days before the anchor; ``min_days=0`` leaves out events after the anchor (no leak), ``None`` counts
    them too.

    Events are first reduced to one row per entity and horizon step, map-side, so the raw rows pay for three sums per
    flag instead of one per flag and horizon; the horizons are then running sums over at most len(horizons)+1 rows.
    """
    days = F.datediff(F.col(anchor_date), F.col(date))
    joined = lookup_join(events, anchors, [id_]).withColumn("_days", days)
    if min_days is not None:
        joined = joined.where(F.col("_days") >= min_days)
    step = F.lit(len(horizons))
    for i in range(len(horizons) - 1, -1, -1):
        step = F.when(F.col("_days") < horizons[i], F.lit(i)).otherwise(step)
    flagged = joined.withColumns({"_step": step} | {f"_{n}": F.col(a) == F.col(b) for n, (a, b) in matches.items()})
    q, a = F.col(quantity).cast("double"), F.col(amount).cast("double")
    per_step = [F.sum(a).alias("_total")]
    for n in matches:
        per_step += [
            F.count_if(F.col(f"_{n}")).alias(f"_n_{n}"),
            conditional_total(q, F.col(f"_{n}")).alias(f"_q_{n}"),
            conditional_total(a, F.col(f"_{n}")).alias(f"_a_{n}"),
        ]
    kept = [anchor_date, *carry]
    steps = flagged.groupBy(id_, "_step").agg(*any_of_group(kept), *per_step)

    measures = [m for n in matches for m in ((f"has_{n}", f"_n_{n}"), (f"has_{n}_q", f"_q_{n}"), (f"has_{n}_a", f"_a_{n}"))]
    out = [*any_of_group(kept), F.coalesce(F.sum("_total"), F.lit(0.0)).alias("total_spend")]
    out += [F.sum(c).alias(name) for name, c in measures]
    out += [
        F.expr(f"sum(if(_step <= {i}, `{c}`, 0)) AS `{name}_{d}`") for i, d in enumerate(horizons) for name, c in measures
    ]
    return steps.groupBy(id_).agg(*out)


def purchase_flags(features: DataFrame, flags: Sequence[str], combinations: Sequence[Sequence[str]]) -> DataFrame:
    """``never_<flag>`` per flag, and per combination whether every flag in it ever held, as float."""
    out = {f"never_{f}": (F.col(f"has_{f}") == 0).cast("float") for f in flags}
    for names in combinations:
        every = F.lit(True)
        for n in names:
            every = every & (F.col(f"has_{n}") != 0)
        out["has_" + "_and_".join(names)] = every.cast("float")
    return features.withColumns(out)
