"""Removal of word passages that occur more than once, found through anchors at the positions of a difference cover."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetab.llm.blocks import (
    answer_fragments, answered, ask, ask_blocks, fragments_for, places, store_blocks, tally, window_hashes,
)
from timetab.llm.texts import word_hashes, words_of
from timetab.session import materialise

PERIOD = 21
COVER = (0, 1, 4, 14, 16)  # every difference modulo 21 is one of these less another
KEPT = "row_key long, doc_id long, n_words long, n_removed long, kept binary, carried string"


def covers(cover: Sequence[int], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


class _Words:
    """The hashes of the words of one block's texts laid end to end; the words themselves are cut anew where they are needed."""

    def __init__(self, pdf: pd.DataFrame, width: int, cover: Sequence[int], period: int):
        self.width, self.period = width, period
        hashes = [word_hashes(words_of(t, lower=False)) for t in pdf["text"]]
        self.lengths = np.array([len(h) for h in hashes], dtype=np.int64)
        self.hashes = np.concatenate([np.empty(0, dtype=np.uint64), *hashes])
        self.place, self.left = places(self.lengths)
        anchor = width - period + 1
        every = window_hashes(self.hashes, anchor)
        chosen = np.isin(np.arange(period), [c % period for c in cover])
        self.anchor_at = np.flatnonzero((self.left[: len(every)] >= anchor) & chosen[self.place[: len(every)] % period])
        self.anchors, self.anchor_of, self.anchor_counts = np.unique(
            every[self.anchor_at], return_inverse=True, return_counts=True
        )

    def extend(self, repeated: np.ndarray) -> None:
        """Windows that hold a repeated anchor at one of their first ``period`` places."""
        at = self.anchor_at[repeated[self.anchor_of]]
        near = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        np.add.at(near, at - np.minimum(self.place[at], self.period - 1), 1)
        np.add.at(near, at + 1, -1)
        near = np.cumsum(near)[:-1] > 0
        self.window_at = np.flatnonzero(near & (self.left >= self.width))
        every = window_hashes(self.hashes, self.width)
        self.windows, self.window_of, self.window_counts = np.unique(
            every[self.window_at], return_inverse=True, return_counts=True
        )

    def removed(self, repeated: np.ndarray) -> np.ndarray:
        at = self.window_at[repeated[self.window_of]]
        cover = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.width, -1)
        return np.cumsum(cover)[:-1] > 0


def strip_repeated(
    blocks: DataFrame, width: int = 35, cover: Sequence[int] = COVER, period: int = PERIOD, keep_unchanged: bool = False
) -> DataFrame:
    """``row_key, doc_id, n_words, n_removed, kept, carried`` of stored blocks; see ``substring_dedup``.

    With ``keep_unchanged`` a text that loses nothing is returned as it is, its white space included.
    """
    if not covers(cover, period):
        raise ValueError(f"{tuple(cover)} does not cover all differences modulo {period}")
    if width < period:
        raise ValueError("a window must be as long as the period at least")
    carried = "carried" in blocks.columns
    anchor_fragments, window_fragments = fragments_for(blocks, 0.3), fragments_for(blocks, 0.6)

    def anchors(block, pdf):
        w = _Words(pdf, width, cover, period)
        return ask(block, w.anchors, w.anchor_counts, anchor_fragments, wide=False)

    def windows(block, pdf, answers):
        w = _Words(pdf, width, cover, period)
        w.extend(answered(answers, 1, w.anchors, anchor_fragments) > 0)
        return ask(block, w.windows, w.window_counts, window_fragments, wide=True)

    def remove(block, pdf, answers):
        w = _Words(pdf, width, cover, period)
        w.extend(answered(answers, 1, w.anchors, anchor_fragments) > 0)
        gone = w.removed(answered(answers, 2, w.windows, window_fragments) > 0)
        ends = np.cumsum(w.lengths)
        counts, kept = [], []
        for text, end, n in zip(pdf["text"], ends, w.lengths):
            lost = gone[end - n : end]
            counts.append(int(lost.sum()))
            if keep_unchanged and not counts[-1]:
                kept.append(text)
                continue
            words = [x for x, out in zip(words_of(text, lower=False), lost.tolist()) if not out]
            kept.append(b" ".join(words))
        return pd.DataFrame({
            "row_key": pdf["row_key"], "doc_id": pdf["doc_id"].astype("Int64"), "n_words": w.lengths, "n_removed": counts,
            "kept": kept, "carried": pdf["carried"] if carried else [None] * len(pdf),
        })

    near = materialise(answer_fragments(ask_blocks(blocks, anchors), tally(wide=False, stage=1)), "anchors")
    same = materialise(answer_fragments(ask_blocks(blocks, windows, near), tally(wide=True, stage=2)), "windows")
    return ask_blocks(blocks, remove, near.unionAll(same), KEPT)


def substring_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 35,
    cover: Sequence[int] = COVER, period: int = PERIOD,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` per row: ``kept`` holds the words left, joined by one space.

    A word goes if a window of ``width`` words that covers it also starts anywhere else, the same text included. Windows
    are judged on the input. A null text has no words and keeps the empty text; so do empty and blank texts. Rows that
    repeat a doc_id, or are equal, are documents of their own, so equal rows of ``width`` words or more remove each
    other. A null doc_id stays null. Other columns are not read.

    Two equal windows at places i and j share a place k below ``period`` with i + k and j + k in the cover, so the
    anchors there (``width - period + 1`` words) are equal. Only anchors at cover places are hashed and counted; windows
    that hold a repeated one are extended to their full width and counted by a 64-bit hash.
    """
    out = strip_repeated(store_blocks(docs, doc_id, text), width, cover, period)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
