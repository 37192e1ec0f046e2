"""A training corpus from raw documents: rules, exact and near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the last return the
columns of ``documents``. A stage's rows are written as Parquet and read again as the next one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timetab.llm.blocks import store_blocks
from timetab.llm.exact_dedup import exact_filter
from timetab.llm.ngram_join import one_of_each_group
from timetab.llm.packing import pack_documents
from timetab.llm.quality_rules import quality_filter
from timetab.llm.substring_dedup import strip_repeated
from timetab.session import materialise


def _stored(docs: DataFrame) -> DataFrame:
    """Blocks that carry the other columns along."""
    return store_blocks(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text")])


def _restored(rows: DataFrame, docs: DataFrame, text: Column, changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``docs``: carried ones as they were, or as ``changed`` says where that is not null."""
    rows = rows.withColumn("carried", F.from_json("carried", docs.drop("doc_id", "text").schema))

    def column(name: str) -> Column:
        if name in ("doc_id", "text"):
            return F.col("doc_id") if name == "doc_id" else text
        old = F.col(f"carried.{name}")
        return F.coalesce(changed[name], old) if changed and name in changed else old

    return rows.select(*[column(c).alias(c) for c in docs.columns])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; cutoffs are learned from ``labels``."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), joint=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id, and one of rows that repeat it."""
    return exact_filter(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the least doc_id."""
    blocks = _stored(docs)
    first = one_of_each_group(blocks)
    return _restored(blocks.join(first, "row_key", "left_semi"), docs, F.col("text").cast("string"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once; those that had nothing else go.

    A document that loses nothing keeps its text as it is; of others the words left are joined by one space, and n_chars is
    measured anew.
    """
    rows = strip_repeated(_stored(docs), keep_unchanged=True).where("n_removed = 0 OR n_removed < n_words")
    text = F.col("kept").cast("string")
    changed = {"n_chars": F.when(F.col("n_removed") > 0, F.length(text).cast("long"))}
    return _restored(rows, docs, text, changed)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as spec:
        return pack_documents(docs, spec.read())


STAGES = [
    ("quality rules", rules),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("substring dedup", passages),
    ("best-fit packing", packing),
]

# The packing stage needs a tokenizer, which SQL has not; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
