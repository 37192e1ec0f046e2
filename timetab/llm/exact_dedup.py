"""Exact duplicates through an extendible-hash index on shared files. Only Spark's own functions are used."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timetab.operators.joins import in_table, not_in_table, salted_join
from timetab.session import fresh_path, materialise

BUCKET_ENTRIES = 256
SLOTS = 1 << 12  # buckets hold more entries where the directory would pass about so many slots
TASK_ROWS = 1 << 16
STEP_BITS = 8
MOST_BITS = 20


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; null is empty."""
    text = F.coalesce(text, F.lit(""))
    other = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    # lower() is many times faster than translate() and does the same where no other letter has a lower case.
    plain = (F.octet_length(text) == F.length(text)) | (F.lower(other) == other)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def hash_key(text: Column, hash_bits: int) -> Column:
    """The leading bits of a 64-bit hash, in the high bits of a long."""
    return F.xxhash64(text).bitwiseAND(F.lit(-(1 << (64 - hash_bits))))


def slot_of(key: Column, depth: int) -> Column:
    """The directory slot of a key: its leading ``depth`` bits."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def grow_directory(entries: DataFrame, key: str, capacity: int, hash_bits: int = 64) -> tuple[int, list[int]]:
    """``(depth, bucket of each of the 2**depth slots)`` such that no bucket has more than ``capacity`` entries.

    An overfull bucket is split by its next bit; when its depth passes the directory's, the directory doubles. Entries are
    counted ``STEP_BITS`` bits further at a time, only in overfull buckets, so what reaches the driver is in proportion to
    the number of buckets. A bucket whose keys have no bits left, or agree in ``MOST_BITS`` bits, stays overfull: its entries
    are chained, and Spark sorts and joins them like others.
    """
    hash_bits = min(hash_bits, MOST_BITS)
    leaves: dict[tuple[int, int], int] = {}
    open_ = {(0, 0): entries.count()}
    while open_:
        counts: dict[tuple[int, int], int] = {}
        for depth in {d for d, _ in open_}:
            upto = min(hash_bits, depth + STEP_BITS)
            split = [p for (d, p), n in open_.items() if d == depth and n > capacity and depth < hash_bits]
            leaves.update({k: n for k, n in open_.items() if k[0] == depth and k[1] not in set(split)})
            if not split:
                continue
            found = entries.where(slot_of(F.col(key), depth).isin(split)).groupBy(slot_of(F.col(key), upto).alias("slot")).count().collect()
            level = {r["slot"]: r["count"] for r in found}
            pending = {(depth, p) for p in split}
            while pending:
                d, p = pending.pop()
                for child in ((d + 1, 2 * p), (d + 1, 2 * p + 1)):
                    room = upto - child[0]
                    n = sum(level.get((child[1] << room) + i, 0) for i in range(1 << room))
                    if n <= capacity:
                        leaves[child] = n
                    elif child[0] < upto:
                        pending.add(child)
                    else:
                        counts[child] = n
        open_ = counts
    depth = max((d for d, _ in leaves), default=0)
    slots = [0] * (1 << depth)
    for bucket, (d, p) in enumerate(sorted(leaves, key=lambda x: x[1] << (depth - x[0]))):
        for i in range(1 << (depth - d)):
            slots[(p << (depth - d)) + i] = bucket
    return depth, slots


def bucket_of(key: Column, directory: tuple[int, list[int]]) -> Column:
    depth, slots = directory
    literal = F.split(F.lit(",".join(map(str, slots))), ",")
    return F.get(literal, slot_of(key, depth).cast("int")).cast("int")


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_entries: int = BUCKET_ENTRIES, hash_bits: int = 64,
    row_key: str | None = None, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, row_key`` per row of ``docs``, dropped ones too.

    Texts are equal when identical after A-Z are lowered; null counts as empty. Of equal texts the row with the largest
    doc_id is kept; of rows that repeat that doc_id, or where all doc_ids are null, one. keep_id is null only if no row of
    the group has a doc_id. Other columns are not read; an empty table gives no rows. ``row_key`` names a stored column of
    distinct longs, or rows are numbered here.

    Tasks combine their rows of a hash into one entry; the entries go into an extendible-hash index, whose buckets lie sorted in
    the files of the tasks that own them. Texts whose hash occurs again are compared byte by byte: where different ones share a
    hash, its entry becomes a chain with one entry per text. Rows then look their hash up; a hash with more than ``task_rows``
    rows is dealt out to as many tasks as it needs. Texts move only to be compared, once per task and distinct text.
    """
    if not 0 < hash_bits <= 64:
        raise ValueError("hash_bits must be 1 to 64")
    spark = docs.sparkSession
    number = F.monotonically_increasing_id() if row_key is None else F.col(row_key)
    body = docs.select(number.alias("row_key"), F.col(doc_id).cast("long").alias("doc_id"), lowered(F.col(text)).alias("body"))
    keyed = body.withColumn("key", hash_key(F.col("body"), hash_bits))
    rows = materialise(keyed.select("row_key", "doc_id", "key", F.sha2("body", 256).alias("text_sha256")), "rows")

    def combined(rows: DataFrame, *by: str) -> DataFrame:
        # A null doc_id is less than any other; of equal ones the least row counts.
        last = F.max(F.struct("doc_id", (-F.col("row_key")).alias("back"))).alias("last")
        return rows.groupBy(*by).agg(last, F.count(F.lit(1)).alias("group_size")).select(
            *by, F.col("last.doc_id").alias("keep_id"), (-F.col("last.back")).alias("keep_row"), "group_size"
        )

    entries = materialise(combined(rows, "key"), "entries")
    directory = grow_directory(entries, "key", max(bucket_entries, -(-entries.count() // SLOTS)), hash_bits)
    again = entries.where("group_size > 1").select("key")
    texts = in_table(keyed.select("key", "body"), again, "key", task_rows=task_rows).distinct()
    chains = materialise(texts.groupBy("key").count().where("count > 1").select("key"), "chains")
    any_chain = chains.limit(1).count() > 0
    index = entries.withColumn("chain_sha", F.lit(None).cast("string"))
    if any_chain:
        chained = combined(in_table(rows, chains, "key", task_rows=task_rows), "key", "text_sha256")
        index = not_in_table(index, chains, "key").unionByName(chained.withColumnRenamed("text_sha256", "chain_sha"))
    index_path = fresh_path(spark, "index")
    index = index.withColumn("bucket", bucket_of(F.col("key"), directory))
    index.repartition("bucket").sortWithinPartitions("bucket", "key").write.parquet(index_path)
    index = spark.read.schema(index.schema).parquet(index_path)

    asked = rows.withColumn("bucket", bucket_of(F.col("key"), directory))
    hot = materialise(
        entries.where(F.col("group_size") > task_rows).select("key", F.ceil(F.col("group_size") / task_rows).cast("int").alias("_salts")), "hot"
    )
    found = salted_join(asked, index, ["key", "bucket"], hot=hot)
    if any_chain:
        found = found.where("chain_sha IS NULL OR chain_sha = text_sha256")
    return found.select(
        "doc_id", "keep_id", "group_size", (F.col("row_key") == F.col("keep_row")).alias("kept"), "text_sha256", "row_key"
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """``exact_groups`` without its row numbers."""
    return exact_groups(docs, doc_id, text, **options).drop("row_key")


def exact_filter(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns: only numbers of dropped rows meet the stored rows."""
    stored = materialise(docs.select(F.monotonically_increasing_id().alias("row_key"), F.struct(*docs.columns).alias("row")), "numbered")
    own = stored.select("row_key", F.col("row")[doc_id].alias("doc_id"), F.col("row")[text].alias("text"))
    dropped = exact_groups(own, row_key="row_key", **options).where(~F.col("kept")).select("row_key")
    return not_in_table(stored, dropped, "row_key").select("row.*")
