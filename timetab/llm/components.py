"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetab.session import materialise


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node of ``links``: label is the smallest node of its component.

    Every node takes the smallest label among its neighbours and itself, then the label of that label, until nothing
    changes: stars end after two rounds, chains after a logarithmic number. Each round is written to the shared folder.
    """
    both = materialise(links.select(F.col(a).alias("node"), F.col(b).alias("other"))
                       .unionAll(links.select(F.col(b), F.col(a))).distinct(), "links")
    labels = materialise(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other").groupBy("node").agg(
            F.min("seen").alias("seen")
        )
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = materialise(
            step.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels"
        )
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
