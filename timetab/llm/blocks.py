"""Which hashed keys of a corpus occur more than once: asked by blocks of documents, answered by fragments of the key space.

A document table is stored once, dealt into blocks of bounded size and bucketed by block. In each round every block turns
its documents into 64-bit keys and sends each distinct key once, with its count in the block, to the fragment of the key
space that it falls in (so a key that stands in a third of all documents sends one entry per block, not one per
document). A fragment adds up the counts and answers each block with one byte per key. Since the table is bucketed, later
rounds meet their answers without moving the texts again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetab.session import store_bucketed

U = np.uint64
BLOCK_BYTES = 4 << 20
FRAGMENT_BYTES = 16 << 20
QUESTION = "fragment long, block long, keys binary, extra binary"
ANSWER = "stage int, block long, fragment long, levels binary"
_A, _B = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def store_blocks(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Store ``row_key, block, doc_id, text`` (as bytes) in the shared folder, bucketed by block, without a shuffle.

    ``row_key`` tells rows apart that repeat a doc_id. A block ends with the text that brings it to ``block_bytes`` or more, however
    many bytes a partition unpacks to; so only a block of one longer text has more than twice as many. The columns in ``carry`` go along
    as JSON in ``carried``.
    """
    taken = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")]
    if carry is not None:
        taken.append(F.to_json(F.struct(*carry)).alias("carried"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rows, block, filled = TaskContext.get().partitionId() << 32, 0, 0, 0
        for batch in batches:
            own = []
            for n in pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist():
                own.append(base + block)
                filled += n
                if filled >= block_bytes:
                    block, filled = block + 1, 0
            keys = pa.array(range(base + rows, base + rows + len(own)), pa.int64())
            rows += len(own)
            yield pa.RecordBatch.from_arrays([keys, pa.array(own, pa.int64()), *batch.columns], names=["row_key", "block", *batch.schema.names])

    narrow = docs.select(*taken)
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    schema = "row_key long, block long, doc_id long, text binary" + (", carried string" if carry is not None else "")
    return store_bucketed(narrow.mapInArrow(deal, schema), "block", total)


def fragments_for(blocks: DataFrame, share: float = 1.0) -> int:
    """Fragments such that each gets about ``FRAGMENT_BYTES`` of text; ``share``: keys per byte against op1's."""
    total = blocks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(share * total / FRAGMENT_BYTES))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * _A
    x ^= x >> U(29)
    x = x * _B
    return x ^ (x >> U(32))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a = a * _A
    a ^= a >> U(32)
    a += b
    a *= _B
    a ^= a >> U(29)
    return a


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of every ``width`` consecutive values, by joining powers of two."""
    if len(values) < width:
        return values[:0]
    out, done, run, step = None, 0, values, 1
    while True:
        if width & step:
            part = run[done:]
            out = part if out is None else _joined(out[: len(part)], part)
            done += step
        if done == width:
            return mixed(out[: len(values) - width + 1])
        run = _joined(run[:-step], run[step:])
        step *= 2


def places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end: of each element its place in its text, and the number of elements from it to the text's end."""
    lengths = np.asarray(lengths, dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(starts, lengths)
    return place, np.repeat(lengths, lengths) - place


def fragment_of(sorted_keys: np.ndarray, fragments: int) -> np.ndarray:
    """Fragment of each key; it grows with the key."""
    return ((sorted_keys >> U(32)) * U(fragments)) >> U(32)


def _borders(sorted_keys: np.ndarray, fragments: int) -> tuple[np.ndarray, np.ndarray]:
    own = fragment_of(sorted_keys, fragments).astype(np.int64)
    return np.unique(own, return_index=True)


def ask(block: int, keys: np.ndarray, counts: np.ndarray, fragments: int, wide: bool) -> pd.DataFrame:
    """Question rows of one block: ``keys`` sorted and distinct; ``wide`` sends 64 bits, else the low 32 (a filter)."""
    ids, at = _borders(keys, fragments)
    ends = np.append(at[1:], len(keys))
    sent = keys if wide else keys.astype(np.uint32)
    counts = np.minimum(counts, 255).astype(np.uint8)
    return pd.DataFrame({
        "fragment": ids, "block": np.full(len(ids), block, dtype=np.int64),
        "keys": [sent[a:b].tobytes() for a, b in zip(at, ends)], "extra": [counts[a:b].tobytes() for a, b in zip(at, ends)],
    })


def tally(wide: bool, stage: int):
    """The fragment's work: 0 for a key that occurs once, else a level that grows with the logarithm of its count."""
    kind = np.uint64 if wide else np.uint32

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(k, dtype=kind) for k in pdf["keys"]]
        _, own = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(own, weights=np.frombuffer(b"".join(pdf["extra"]), dtype=np.uint8))
        level = np.where(total > 1, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(total, 1)))), 0).astype(np.uint8)[own]
        return answer_rows(pdf, level, [len(p) for p in parts], stage)

    return add_up


def answer_rows(pdf: pd.DataFrame, level: np.ndarray, lengths: list[int], stage: int) -> pd.DataFrame:
    """One row per question whose answer is not all zero."""
    ends = np.cumsum(lengths)
    out = [
        (stage, b, f, level[e - n : e].tobytes())
        for b, f, n, e in zip(pdf["block"], pdf["fragment"], lengths, ends) if level[e - n : e].any()
    ]
    return pd.DataFrame(out, columns=["stage", "block", "fragment", "levels"])


def answered(answers: pd.DataFrame, stage: int, keys: np.ndarray, fragments: int) -> np.ndarray:
    """The level of each of a block's keys (sorted and distinct, as they were asked)."""
    level = np.zeros(len(keys), dtype=np.uint8)
    mine = answers[answers["stage"] == stage]
    if len(mine) and len(keys):
        ids, at = _borders(keys, fragments)
        start = dict(zip(ids.tolist(), at.tolist()))
        for f, data in zip(mine["fragment"], mine["levels"]):
            got = np.frombuffer(data, dtype=np.uint8)
            level[start[f] : start[f] + len(got)] = got
    return level


def ask_blocks(blocks: DataFrame, emit, answers: DataFrame | None = None, schema: str = QUESTION) -> DataFrame:
    """Run ``emit(block, rows[, answers])`` on every block."""
    if answers is None:
        return blocks.groupBy("block").applyInPandas(lambda key, pdf: emit(key[0], pdf), schema)

    def both(key, pdf, got):
        return emit(key[0], pdf, got)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(both, schema)


def answer_fragments(questions: DataFrame, add_up) -> DataFrame:
    return questions.groupBy("fragment").applyInPandas(add_up, ANSWER)
