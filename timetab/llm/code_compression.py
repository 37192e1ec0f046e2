"""Product codes of integer vectors through per-dimension value dictionaries.

A block of vectors is stored as dictionaries, the distinct integers of each dimension, and codes into them. In a round, the squared
difference of every distinct integer to every codebook entry is tabulated once per block and dimension; a part's distance to an entry
is then a sum of gathers from these tables. Only sums and counts per entry leave the tasks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetab.llm.vectors import block_rows, exact_integers, narrowed, usable, whole
from timetab.operators.joins import lookup_join
from timetab.session import materialise

PARTS, ENTRIES, ROUNDS = 8, 16, 6
BLOCK_CELLS = 1 << 20
BLOCK = "n int, vec_ids array<long>, labels array<string>, sizes binary, words binary, word_kind string, codes binary, code_kind string"
CODED = "vec_id long, label string, code string, error long"
Book = list[list[list[int]]]  # part, entry, component


def store_codes(rows: DataFrame, factor: int, cells: int = BLOCK_CELLS) -> DataFrame:
    """Blocks of ``rows`` (vec_id, label, vector): per dimension the sorted distinct integers, and each component as its place there."""

    def make(table: pa.Table, components: np.ndarray) -> dict:
        values = whole(components, factor)
        words, codes = zip(*(np.unique(values[:, d], return_inverse=True) for d in range(values.shape[1])))
        held, placed = narrowed(np.concatenate(words)), np.stack(codes)
        placed = placed.astype(np.uint16 if placed.max() < 1 << 16 else np.uint32)
        return {
            "n": len(values), "vec_ids": table["vec_id"].to_pylist(), "labels": table["label"].to_pylist(),
            "sizes": np.array([len(w) for w in words], dtype=np.int32).tobytes(), "words": held.tobytes(), "word_kind": held.dtype.str,
            "codes": placed.tobytes(), "code_kind": placed.dtype.str,
        }

    return materialise(block_rows(rows, "vector", cells, make, BLOCK), "codes")


def _read(block: dict) -> tuple[list[np.ndarray], np.ndarray]:
    sizes = np.frombuffer(block["sizes"], dtype=np.int32)
    words = np.frombuffer(block["words"], dtype=np.dtype(block["word_kind"])).astype(np.int64)
    codes = np.frombuffer(block["codes"], dtype=np.dtype(block["code_kind"])).reshape(len(sizes), block["n"])
    return np.split(words, np.cumsum(sizes)[:-1]), codes


def nearest(words: list[np.ndarray], codes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(entry, squared distance)`` of each row of one part: ``words`` and ``codes`` by dimension, ``entries`` by entry and dimension.

    Of equally near entries the first is taken. Where 64 bits might not hold a distance, Python's integers are used.
    """
    reach = max([float(np.abs(w).max()) for w in words] + [float(np.abs(entries.astype(np.float64)).max())])
    wide = len(words) * (2 * reach) ** 2 >= 2**62
    distance = None
    for word, code, entry in zip(words, codes, entries.T):
        if wide:
            word, entry = exact_integers(word), np.array([int(x) for x in entry], dtype=object)
        # One row per distinct integer, one column per entry.
        table = (word[:, None] - entry[None, :]) ** 2
        part = table[code]
        distance = part if distance is None else distance + part
    chosen = np.argmin(distance, axis=1) if not wide else np.array([min(range(len(d)), key=lambda i, d=d: d[i]) for d in distance], dtype=np.int64)
    return chosen, distance[np.arange(len(chosen)), chosen]


def _parts(blocks: Iterator[pa.RecordBatch], book: Book):
    """Each block, and for each of its parts the words, codes and nearest entries."""
    entries = [np.array(part, dtype=np.int64) for part in book]
    for batch in blocks:
        for block in batch.to_pylist():
            words, codes = _read(block)
            width = len(words) // len(book)
            for p, part in enumerate(entries):
                span = slice(p * width, (p + 1) * width)
                yield block, p, words[span], codes[span], *nearest(words[span], codes[span], part)


def next_book(blocks: DataFrame, book: Book) -> Book:
    """One round: every part goes to its nearest entry, every entry becomes floor(sum / count) of its parts; unused ones stay."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [[0] * len(part) for part in book]
        sums = [[[0] * len(entry) for entry in part] for part in book]
        for _, p, words, codes, chosen, _ in _parts(batches, book):
            for e, n in enumerate(np.bincount(chosen, minlength=len(book[p])).tolist()):
                counts[p][e] += n
            for d, (word, code) in enumerate(zip(words, codes)):
                # How often each distinct integer fell to each entry, then whole numbers of any size.
                hits = np.bincount(chosen * len(word) + code, minlength=len(book[p]) * len(word)).reshape(len(book[p]), len(word))
                small = float(np.abs(word).max()) * hits.sum() < 2**62
                totals = hits @ word if small else hits.astype(object) @ exact_integers(word)
                for e, total in enumerate(totals.tolist()):
                    sums[p][e][d] += total
        rows = [{"part": p, "counts": json.dumps(counts[p]), "sums": json.dumps(sums[p])} for p in range(len(book)) if any(counts[p])]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("counts", pa.string()), ("sums", pa.string())]))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        counts, sums = None, None
        for c, s in zip(map(json.loads, pdf["counts"]), map(json.loads, pdf["sums"])):
            counts = c if counts is None else [x + y for x, y in zip(counts, c)]
            sums = s if sums is None else [[x + y for x, y in zip(a, b)] for a, b in zip(sums, s)]
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "counts": [json.dumps(counts)], "sums": [json.dumps(sums)]})

    schema = "part int, counts string, sums string"
    # A row per task and part is merged in two steps, and one row per part reaches the driver.
    partial = blocks.mapInArrow(add_up, schema).withColumn("bunch", F.spark_partition_id() % 64)
    partial = partial.groupBy("part", "bunch").applyInPandas(lambda pdf: merge(pdf), schema)
    new = [list(part) for part in book]
    for row in partial.groupBy("part").applyInPandas(merge, schema).collect():
        for e, (n, total) in enumerate(zip(json.loads(row["counts"]), json.loads(row["sums"]))):
            if n:
                new[row["part"]][e] = [t // n for t in total]
    return new


def assign(blocks: DataFrame, book: Book) -> DataFrame:
    """``vec_id, label, code, error`` of each row."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, error = [], 0
        for block, p, _, _, chosen, distance in _parts(batches, book):
            code, error = [*code, chosen], error + distance
            if p == len(book) - 1:
                digits = np.array([f"{e:02x}" for e in range(256)], dtype=object)
                text = digits[code[0]]
                for c in code[1:]:
                    text = text + digits[c]
                fits = [int(x) if x < 2**63 else None for x in error.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block["vec_ids"], pa.int64()), pa.array(block["labels"], pa.string()), pa.array(text, pa.string()),
                     pa.array(fits, pa.int64())], names=["vec_id", "label", "code", "error"])
                code, error = [], 0

    return blocks.mapInArrow(coded, CODED)


def digest(book: Book) -> str:
    return hashlib.sha256(",".join(str(x) for part in book for entry in part for x in entry).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = 4096, vec_id: str = "vec_id",
    vector: str = "embedding", label: str = "label", cells: int = BLOCK_CELLS,
) -> tuple[DataFrame, Book]:
    """``(vec_id, label, code, error, label_error)`` of each usable row, and the final codebooks by part, entry and component.

    Components are floor(factor * x). Codebooks start as the parts of the ``entries`` smallest vec_ids (fewer where there are fewer rows); in
    each round every part goes to the nearest entry (the first of equally near ones) and entries become the floor of the mean.

    Vectors that are null, empty or hold a null or non-finite component (or one whose integer is beyond 2**53) are left out; so are
    those of another length than the row with the smallest vec_id. That length must be a multiple of ``parts``, or it is a ValueError. Rows
    that repeat a vec_id are rows of their own, and start codebooks in the order of their integers; a null vec_id comes last. Null labels
    are one label; ``label`` is returned as text. An error that a long cannot hold is null. An empty table gives no rows and an empty codebook.

    Rows are encoded once, where they lie; a round reads the codes and shuffles one row per task and part.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector")
    ).where(usable(F.col("vector"), factor))
    whole_numbers = F.transform("vector", lambda x: F.floor(x * factor).cast("long"))
    first_rows = rows.select("vec_id", whole_numbers.alias("v")).orderBy(F.col("vec_id").asc_nulls_last(), "v")
    first = first_rows.limit(1).collect()
    if not first:
        return spark.createDataFrame([], f"{CODED}, label_error long"), []
    dims = len(first[0]["v"])
    if dims % parts:
        raise ValueError(f"{dims} components do not make {parts} equal parts")
    width = dims // parts
    start = [r["v"] for r in first_rows.where(F.size("v") == dims).limit(entries).collect()]
    book: Book = [[v[p * width : (p + 1) * width] for v in start] for p in range(parts)]
    blocks = store_codes(rows.where(F.size("vector") == dims), factor, cells)
    for _ in range(rounds):
        book = next_book(blocks, book)
    coded = materialise(assign(blocks, book), "coded")
    # A null label is a group of its own: its key is null in the flag's place, not in the name's.
    keyed = coded.withColumn("label_key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    totals = keyed.groupBy("label_key").agg(F.try_sum("error").alias("label_error"))
    return lookup_join(keyed, totals, ["label_key"]).select("vec_id", "label", "code", "error", "label_error"), book
