"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timetab.llm.blocks import mixed
from timetab.llm.texts import word_hashes, words_of
from timetab.operators.ordering import order_cutoffs
from timetab.session import materialise

BUCKETS = 1 << 14
TARGET_DOCUMENTS = 20_000
SPAN = 100
WEIGHTS = "row_key long, doc_id long, n_features long, log_ratio double"


def features(text: bytes | None, buckets: int) -> np.ndarray:
    """Buckets of the words and word pairs of a text, A-Z lowered."""
    one = word_hashes(words_of(text, lower=True))
    pairs = mixed(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) if len(one) > 1 else one[:0]
    return (np.concatenate([one, pairs]) % np.uint64(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts (one column, binary): summed per task, then over tasks."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for pdf in batches:
            for t in pdf.iloc[:, 0]:
                total += np.bincount(features(t, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    found = texts.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in found:  # at most one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of the buckets' probability in the target model over that in the raw model, both smoothed."""
    return np.log((target + smooth) / (target.sum() + smooth * len(target))) - np.log((raw + smooth) / (raw.sum() + smooth * len(raw)))


def gumbel(seed: int, *keys: Column) -> Column:
    """A Gumbel variate per row, the same on every run."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) + F.lit(0.5)) / F.lit(2.0**53)
    return -F.log(-F.log(uniform))


def importance_sample(
    docs: DataFrame, target_ids: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = 0.9, seed: int = 7,
    buckets: int = BUCKETS, target_documents: int = TARGET_DOCUMENTS, span: int = SPAN,
) -> DataFrame:
    """``doc_id, n_features, log_weight, gumbel_key, kept`` per row; ``kept`` marks a sample of ``share`` of the rows.

    ``target_ids`` (one column) names documents of the wanted kind; the target model is fitted on at most
    ``target_documents`` of them, first by hash. The raw model counts all rows. log_weight is the mean log ratio of the two models
    over the words and word pairs of the whole text, times ``span``: the weight of a text of ``span`` features, so that long
    texts are not favoured. gumbel_key adds a Gumbel variate, and the rows with the largest keys are drawn, which samples
    without replacement in proportion to the weights. Exactly ``floor(share * rows)`` rows are kept, ties by row.

    Null, empty and blank texts have no features and the weight of an average text, 0. Without target documents all weights
    are 0 and the sample is uniform. Rows that repeat a doc_id are drawn each for itself. Other columns are not read.
    """
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    wanted = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    first = wanted.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(target_documents)
    target = bucket_counts(body.join(F.broadcast(first), "doc_id", "left_semi").select("text"), buckets)
    ratio = log_ratios(target, bucket_counts(body.select("text"), buckets)) if target.any() else np.zeros(buckets)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [features(t, buckets) for t in pdf.pop("text")]
            pdf["n_features"] = [len(f) for f in found]
            pdf["log_ratio"] = [float(ratio[f].sum()) for f in found]
            yield pdf.astype({"doc_id": "Int64"})

    rows = body.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", "text").mapInPandas(weigh, WEIGHTS)
    weight = F.when(F.col("n_features") > 0, span * F.col("log_ratio") / F.col("n_features")).otherwise(F.lit(0.0))
    weighed = materialise(
        rows.withColumn("log_weight", weight).withColumn("gumbel_key", F.col("log_weight") + gumbel(seed, F.col("row_key"), F.col("doc_id"))),
        "weights",
    )
    cut = order_cutoffs(weighed.select("gumbel_key", "row_key"), ["gumbel_key", "row_key"], lambda n: [n - int(share * n)], leaf_rows=10_000) \
        if weighed.limit(1).count() else None
    kept = cut[0].reached() if cut else F.lit(False)
    return weighed.select("doc_id", "n_features", "log_weight", "gumbel_key", kept.alias("kept"))
