"""Removal of byte strings that occur more than once, through the phrases of a prefix-free parse.

A rolling hash over ``WINDOW`` bytes cuts each text at trigger windows, so equal strings are cut alike wherever they stand. The places of
a text fall into stretches whose strings of ``width`` bytes hold the same phrases. Stretches are grouped by a hash of these phrases: if all
stretches of a group have equal bytes around them, their strings are settled together, else each string is hashed and counted for
itself. No suffix array and no order of suffixes is built: only equality of ``width`` bytes decides what is removed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from timetab.llm.blocks import (
    answer_fragments, answer_rows, answered, ask, ask_blocks, fragments_for, store_blocks, tally, _borders,
)
from timetab.session import materialise

WINDOW = 16
PHRASE = 48
STRIPPED = (
    "row_key long, doc_id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary, carried string"
)
ALIKE, MIXED = 1, 2


def triggers(data: np.ndarray, phrase: int = PHRASE) -> np.ndarray:
    """Ends of the windows of ``WINDOW`` bytes whose hash is 0 modulo ``phrase``."""
    if len(data) < WINDOW:
        return np.empty(0, dtype=np.int64)
    x = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    step = 1
    while step < WINDOW:
        x = (x[:-step] ^ (x[:-step] >> np.uint32(15))) * np.uint32(0x85EBCA77) + x[step:]
        step *= 2
    x ^= x >> np.uint32(16)
    x *= np.uint32(0xC2B2AE3D)
    x ^= x >> np.uint32(13)
    return np.flatnonzero(x % np.uint32(phrase) == 0) + WINDOW


class _Parse:
    """The stretches of one block's texts whose strings of ``width`` bytes hold the same phrases."""

    def __init__(self, pdf: pd.DataFrame, width: int, phrase: int):
        self.width = width
        texts = [t or b"" for t in pdf["text"]]
        self.data = b"".join(texts)
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        cut = triggers(np.frombuffer(self.data, dtype=np.uint8), phrase)
        own = np.searchsorted(self.ends, cut - WINDOW, side="right")
        inside = cut <= self.ends[own] if len(cut) else np.empty(0, dtype=bool)
        cut, own = cut[inside], own[inside]
        far = cut[cut - width >= self.starts[own]] - width
        last = np.maximum(self.starts, self.ends - width + 1)
        # A new stretch begins where a trigger window leaves or enters, and at the first and past the last place of a text.
        begin = np.unique(np.concatenate([self.starts, last, cut - WINDOW + 1, far]))
        end = np.append(begin[1:], begin[-1:])
        text = np.searchsorted(self.ends, begin, side="right")
        known = text < len(self.ends)
        begin, end, text = begin[known], end[known], text[known]
        whole = (begin + width <= self.ends[text]) & (begin < end)
        self.begin, self.end = begin[whole], end[whole]
        first = np.searchsorted(cut, self.begin + WINDOW, side="left")
        final = np.searchsorted(cut, self.begin + width, side="right") - 1
        self.bare = first > final
        lead = np.append(cut, 0)[np.where(self.bare, len(cut), first)]
        tail = np.append(cut, 0)[np.where(self.bare, len(cut), final)]
        d, h = self.data, xxhash.xxh3_64_intdigest
        rows = np.flatnonzero(~self.bare)
        self.rows = rows
        core = np.fromiter(
            (h(d[a:b]) for a, b in zip((lead[rows] - WINDOW).tolist(), tail[rows].tolist())), dtype=np.uint64, count=len(rows)
        )
        around = np.fromiter(
            (h(d[a : b + width - 1], a - c + (1 << 32)) & 0xFFFFFFFF
             for a, b, c in zip(self.begin[rows].tolist(), self.end[rows].tolist(), lead[rows].tolist())),
            dtype=np.uint32, count=len(rows),
        )
        self.keys, at, self.of, counts = np.unique(core, return_index=True, return_inverse=True, return_counts=True)
        self.around = around[at] if len(at) else around
        differs = np.zeros(len(self.keys), dtype=bool)
        differs[self.of[around != self.around[self.of]]] = True
        self.counts = np.where(differs, 0, np.minimum(counts, 255)).astype(np.uint8)  # 0: the block itself has two kinds

    def ask(self, block: int, fragments: int) -> pd.DataFrame:
        ids, at = _borders(self.keys, fragments)
        ends = np.append(at[1:], len(self.keys))
        low = self.keys.astype(np.uint32)
        return pd.DataFrame({
            "fragment": ids, "block": np.full(len(ids), block, dtype=np.int64),
            "keys": [low[a:b].tobytes() for a, b in zip(at, ends)],
            "extra": [self.around[a:b].tobytes() + self.counts[a:b].tobytes() for a, b in zip(at, ends)],
        })

    def single(self, level: np.ndarray) -> None:
        """Strings to compare one by one: of stretches that occur in more than one kind, or hold no phrase."""
        state = np.zeros(len(self.begin), dtype=np.uint8)
        state[self.rows] = level[self.of]
        state[self.bare] = MIXED
        self.alike = np.flatnonzero(state == ALIKE)
        each = np.flatnonzero(state == MIXED)
        n = self.end[each] - self.begin[each]
        self.at = np.repeat(self.begin[each] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        d, w, h = self.data, self.width, xxhash.xxh3_64_intdigest
        keys = np.fromiter((h(d[i : i + w]) for i in self.at.tolist()), dtype=np.uint64, count=len(self.at))
        self.strings, self.string_of, self.string_counts = np.unique(keys, return_inverse=True, return_counts=True)

    def removed(self, repeated: np.ndarray) -> np.ndarray:
        cover = np.zeros(len(self.data) + 1, dtype=np.int32)
        at = self.at[repeated[self.string_of]]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.width, -1)
        np.add.at(cover, self.begin[self.alike], 1)
        np.add.at(cover, self.end[self.alike] - 1 + self.width, -1)
        return np.cumsum(cover, dtype=np.int32)[:-1] > 0


def compare_stretches(stage: int):
    """A fragment's work: 0 for phrases that stand once, ALIKE if all their surroundings are equal, else MIXED."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, dtype=np.uint32) for k in pdf["keys"]]
        around = np.concatenate([np.frombuffer(x, dtype=np.uint32, count=len(k)) for k, x in zip(keys, pdf["extra"])])
        counts = np.concatenate([np.frombuffer(x, dtype=np.uint8, offset=4 * len(k)) for k, x in zip(keys, pdf["extra"])])
        _, at, own = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        mixed = np.zeros(len(at), dtype=bool)
        mixed[own[(around != around[at][own]) | (counts == 0)]] = True
        total = np.bincount(own, weights=counts)
        level = np.where(mixed, MIXED, np.where(total > 1, ALIKE, 0)).astype(np.uint8)[own]
        return answer_rows(pdf, level, [len(k) for k in keys], stage)

    return compare


def strip_repeated_bytes(blocks: DataFrame, width: int = 400, phrase: int = PHRASE) -> DataFrame:
    """What ``suffix_dedup`` returns, of stored blocks, with ``row_key`` and the carried columns."""
    if width <= WINDOW:
        raise ValueError(f"strings must be longer than {WINDOW} bytes")
    carried = "carried" in blocks.columns
    phrase_fragments, string_fragments = fragments_for(blocks, 0.3), fragments_for(blocks, 0.6)

    def phrases(block, pdf):
        return _Parse(pdf, width, phrase).ask(block, phrase_fragments)

    def strings(block, pdf, answers):
        p = _Parse(pdf, width, phrase)
        p.single(answered(answers, 1, p.keys, phrase_fragments))
        return ask(block, p.strings, p.string_counts, string_fragments, wide=True)

    def remove(block, pdf, answers):
        p = _Parse(pdf, width, phrase)
        p.single(answered(answers, 1, p.keys, phrase_fragments))
        gone = p.removed(answered(answers, 2, p.strings, string_fragments) > 0)
        data = np.frombuffer(p.data, dtype=np.uint8)
        counts, starts, ends, kept = [], [], [], []
        for a, b in zip(p.starts.tolist(), p.ends.tolist()):
            lost = gone[a:b]
            counts.append(int(lost.sum()))
            if counts[-1]:
                edge = np.flatnonzero(np.diff(lost.astype(np.int8), prepend=0, append=0))
                starts.append(edge[0::2]), ends.append(edge[1::2])
                kept.append(data[a:b][~lost].tobytes())
            else:
                starts.append([]), ends.append([])
                kept.append(p.data[a:b])
        return pd.DataFrame({
            "row_key": pdf["row_key"], "doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": p.lengths, "n_removed": counts,
            "starts": starts, "ends": ends, "kept": kept, "carried": pdf["carried"] if carried else [None] * len(pdf),
        })

    alike = materialise(answer_fragments(ask_blocks(blocks, phrases), compare_stretches(stage=1)), "stretches")
    same = materialise(answer_fragments(ask_blocks(blocks, strings, alike), tally(wide=True, stage=2)), "strings")
    return ask_blocks(blocks, remove, alike.unionAll(same), STRIPPED)


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 400, phrase: int = PHRASE) -> DataFrame:
    """``doc_id, n_bytes, n_removed, starts, ends, kept`` per row: maximal removed runs and the bytes left (UTF-8, binary).

    A byte goes if a string of ``width`` bytes that covers it also starts anywhere else, the same text included; no string
    crosses texts, and strings are judged on the input. Null and empty texts have no bytes. Rows that repeat a doc_id, or
    are equal, are documents of their own, so equal rows of ``width`` bytes or more remove each other. A null doc_id stays
    null. Other columns are not read.

    Where all places that hold the same phrases have equal surroundings, their strings are settled together. Strings of
    other places, and strings without a phrase, are compared one by one by a 64-bit hash of their bytes.
    """
    out = strip_repeated_bytes(store_blocks(docs, doc_id, text), width, phrase)
    return out.drop("row_key", "carried")
