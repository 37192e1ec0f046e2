"""From a role table and a split to a model-ready table: every transform is fitted on the training part."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetab.functions.columns import Roles
from timetab.operators.encoding import encode_vocabulary, fit_vocabulary, one_hot
from timetab.operators.profiling import value_counts
from timetab.operators.scaling import (
    LabelScale, fit_label, fit_quantiles, mean_and_std, scale_identity, scale_quantile, scale_standard,
)

# Policy names for numeric and categorical features, and the numeric policy each kind of table wants:
# tables whose features come scaled already are left as they are.
NUM_POLICIES = ("standard", "identity", "noisy-quantile", "noisy-quantile-old")
CAT_POLICIES = ("ordinal", "one-hot")


def numeric_policy(scaled_already: bool) -> str:
    return "identity" if scaled_already else "noisy-quantile"


@dataclass(frozen=True)
class Built:
    data: DataFrame
    label: LabelScale | None
    cardinalities: dict[str, int]


def build_dataset(
    df: DataFrame, roles: Roles, *, num_policy: str | None = None, cat_policy: str | None = None, seed: int = 0,
    scale_label: bool = False, exact: bool = True, noise: bool = True,
) -> Built:
    """Transform ``df`` (row_id, part, role columns, y) by the given policies.

    One-hot turns a categorical column into an array column of its training size; val and test values that training
    has not seen are all zeros there, and take the next free code under "ordinal".
    """
    train = df.where(F.col("part") == "train")
    out, sizes, label = df, {}, None
    if num_policy is not None:
        if num_policy not in NUM_POLICIES:
            raise ValueError(f"unknown numeric policy {num_policy}")
        if num_policy == "standard":
            out = scale_standard(out, mean_and_std(train, roles.num))
        elif num_policy == "identity":
            out = scale_identity(out, roles.num)
        else:
            kind = ("fixed" if num_policy == "noisy-quantile" else "relative") if noise else None
            out = scale_quantile(out, fit_quantiles(train, roles.num, noise=kind, seed=seed, exact=exact))
    if cat_policy is not None:
        if cat_policy not in CAT_POLICIES:
            raise ValueError(f"unknown categorical policy {cat_policy}")
        if roles.cat:
            vocabulary = fit_vocabulary(train, roles.cat)
            out, sizes = encode_vocabulary(out, vocabulary), vocabulary.sizes
            if cat_policy == "one-hot":
                out = out.withColumns({c: one_hot(c, sizes[c]) for c in roles.cat})
    if scale_label and roles.task == "regression":
        label = fit_label(train)
        out = out.withColumn("y", label.apply("y"))
    return Built(out, label, sizes)


def cardinalities(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct training values per categorical column, and of the label if it is among them."""
    train = df.where(F.col("part") == "train")
    seen = value_counts(train, columns).where(F.col("value").isNotNull()).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(seen, "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("n"))


def part_sizes(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split", "part").agg(F.count(F.lit(1)).alias("n_rows"))
