"""Best-fit-decreasing packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timetab.session import materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
CACHE = 150_000
# Latin letters and numbers below U+0250, all of them composed. Special tokens, controls, odd blanks, other scripts, and
# U+0130, whose lower case is two characters, are odd.
_KINDS = {k: "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
_CUT = re.compile(rf"[{_KINDS['L']}]+|'(?:[stmd]|re|ve|ll)|[{_KINDS['N']}]|[^\s{_KINDS['L']}{_KINDS['N']}]+").findall
_ODD = re.compile("<\\||[^\t\n\r -~\u00a1-\u012f\u0131-\u024f]").search
_BLANK = re.compile("[\t\n\r ]+").split


class Recent:
    """What ``compute`` gives for a key, kept for the keys of late: two dicts of at most ``CACHE`` keys, the older one goes."""

    def __init__(self, compute):
        self.compute, self.new, self.old = compute, {}, {}

    def __call__(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.compute(key)
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[key] = value
        return value


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is visible, else the next one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


class WordEncoder:
    """Ids (little-endian unsigned 32-bit) of texts by a tokenizer that drops white space and merges inside words only.

    Latin text is cut into words here as the tokenizer would, and its model merges each distinct word; words of late are
    looked up. Stretches between blanks with anything else in them go to the tokenizer as they are.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.words = Recent(self.word)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        found = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(found)}I", *found)

    def latin(self, text: str) -> bytes:
        get, words = self.words.new.get, self.words
        return b"".join([get(w) or words(w) for w in _CUT(text.lower())])

    def __call__(self, text: str) -> bytes:
        if not _ODD(text):
            return self.latin(text)
        return b"".join([self.encode(c) if _ODD(c) else self.latin(c) for c in _BLANK(text)])


def tokenised_pieces(docs: DataFrame, spec: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, nth``: each document's ids and ``end_id``, cut at ``capacity``.

    ``spec`` is the tokenizer's JSON. ``nth`` numbers the pieces of one length within a partition (``part``).
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # the vocabulary file, about 2 MB at any size of the corpus

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder(shared.value)  # it goes with the task: an idle worker holds no words
        end = np.array([end_id], dtype="<u4").tobytes()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        part = TaskContext.get().partitionId()
        for pdf in batches:
            rows = []
            for key, value in zip(pdf["doc_id"], pdf["text"]):
                ids = (encoder(value) if value else b"") + end
                n = len(ids) // 4
                for i, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    rows.append((key, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]).astype({"doc_id": "Int64"})

    taken = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return taken.mapInPandas(cut, PIECES)


class _OpenBins:
    """Open bins by remaining capacity: a segment tree over the capacities finds the tightest that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.bins: list[deque] = [deque() for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        i = room + self.size
        self.any[i] = bool(self.bins[room])
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of ``length`` or more that an open bin has."""
        i = length + self.size
        while not self.any[i]:
            while i & 1:  # a right child: what is right of it hangs elsewhere
                i //= 2
            if i == 0:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size

    def put(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.bins[room].append((first, count))
            self._mark(room)

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins of a remaining capacity: consecutive numbers, as (first, count)."""
        first, count = self.bins[room].popleft()
        if count > most:
            self.bins[room].appendleft((first + most, count - most))
            count = most
        self._mark(room)
        return first, count


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over the number of items of each length.

    Rows (length, first item, items, first bin, items per bin, offset of the first): item q of the row goes to bin
    ``first bin + q // per bin`` at ``offset + q % per bin * length``. Items of one length and bins with one remaining
    capacity are interchangeable, so the work and the rows depend on ``capacity``, not on the number of items.
    """
    bins, plan, opened = _OpenBins(capacity), [], 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit a capacity of {capacity}")
        done, total = 0, counts[length]
        while done < total:
            room = bins.tightest(length)
            fresh = room is None
            room = capacity if fresh else room
            per, left = room // length, total - done
            most = max(1, left // per)
            if fresh:
                first, count, opened = opened, most, opened + most
            else:
                first, count = bins.take(room, most)
            per = min(per, left)
            plan.append((length, done, count * per, first, per, capacity - room))
            bins.put(room - per * length, first, count)
            done += count * per
    return np.array(plan, dtype=np.int64).reshape(-1, 6)


def best_fit_pack(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces with ``part`` and ``nth`` (see ``tokenised_pieces``).

    Only the number of pieces per length (at most ``capacity`` rows) reaches the driver, and a plan of the size of the
    capacity goes out.
    """
    counts = pieces.groupBy("part", length).agg(F.count(F.lit(1)).alias("n"))
    totals = {r[length]: r["n"] for r in counts.groupBy(length).agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_plan(totals, capacity)
    # Row numbers of a plan in order of (length, first item): length and number make one key.
    span = max(totals.values(), default=0) + 1
    key = plan[:, 0] * span + plan[:, 1]
    order = np.argsort(key, kind="stable")
    plan, key = plan[order], key[order]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, item = pdf[length].to_numpy(), pdf.pop("item").to_numpy()
            row = plan[np.searchsorted(key, n * span + item, side="right") - 1]
            q = item - row[:, 1]
            pdf["sequence_id"] = row[:, 3] + q // row[:, 4]
            pdf["offset"] = row[:, 5] + q % row[:, 4] * n
            yield pdf

    earlier = Window.partitionBy(length).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", length, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    numbered = pieces.join(base, ["part", length]).withColumn("item", F.col("base") + F.col("nth"))
    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.select(*kept).dtypes) + ", sequence_id long, offset long"
    return numbered.select(*kept, "item").mapInPandas(place, schema)


def pack_documents(
    docs: DataFrame, spec: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece of a document.

    A document is its ids without special tokens, then ``end_id``; null, empty and blank texts are ``end_id`` alone. A
    longer one than ``capacity`` is cut into pieces of ``capacity``, the last may be shorter. Every row is packed, also
    rows that repeat a doc_id or have none; other columns are not read. An empty table gives no rows. Sequences are
    numbered from 0, and pieces lie in them gaplessly from offset 0.
    """
    pieces = materialise(tokenised_pieces(docs, spec, capacity, end_id, doc_id, text), "pieces")
    return best_fit_pack(pieces, capacity)
