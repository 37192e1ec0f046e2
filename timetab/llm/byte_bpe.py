"""Byte-level BPE encoding and decoding: ranked merges folded over the bytes of distinct words."""

from __future__ import annotations

import base64
import heapq
import json
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timetab.llm.blocks import FRAGMENT_BYTES
from timetab.session import materialise, store_bucketed

FACTOR = 4093
BLOCK_CHARS = 20_000_000
FOLD_BYTES = 1024  # longer words are merged with a heap: the fold's work grows with the square of a word's bytes
PARSED = "block long, kind int, doc_id long, numbers binary, fragment long, lengths binary, words binary"
DICTIONARY = "fragment long, lengths binary, words binary, sizes binary, ids binary"
ANSWERED = "block long, fragment long, sizes binary, ids binary"
# Latin letters and numbers below U+0250; anything else but plain blanks goes the general way.
LATIN = {k: "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
ODD = re.compile("[^\t\n\r -~\u00a1-\u024f]").search


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 piece and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _json(value, kind: T.DataType) -> Column:
    """A large literal; Spark folds it once, when the query is planned."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _hex_pieces(ranks: dict[bytes, int]) -> list[str]:
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    return pieces


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, as the end of a fold over nothing: around an array's item Spark derives the type of the whole
    body again for every word."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


class RankMap:
    """The ranks of merged pairs as a literal map, by the ids of the two parts.

    A part of a word is one long: the rank of what it makes with the next part (``none`` if they do not merge), its first byte's
    place in the word, its id. So the least part is the one to merge, the first of equals. ``known``, the literal, is meant to stand in a query
    once, bound to a variable: each place where it stands costs the driver and every task a copy.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.bits = max(ranks.values()).bit_length()
        self.shift = 61 - self.bits
        if self.shift - self.bits < FOLD_BYTES.bit_length():
            raise ValueError("the ranks are too large to fold")
        self.none = 1 << 61
        pairs = [(a, b, rank) for piece, rank in ranks.items() for a, b in self._parts(piece, ranks)]
        # An odd factor makes the left part follow from the bucket and the right part, so the right part is key enough.
        self.size = 1 << max(self.bits, len(pairs).bit_length())
        buckets: list[dict[int, int] | None] = [None] * self.size
        for a, b, rank in pairs:
            at = (a * FACTOR + b) % self.size
            buckets[at] = buckets[at] or {}
            buckets[at][b] = rank << self.shift
        found = _json(buckets, T.ArrayType(T.MapType(T.StringType(), T.LongType()))).cast("array<map<bigint,bigint>>")
        single = _json([ranks[bytes([i])] for i in range(256)], T.ArrayType(T.LongType()))
        self.known = F.struct(found.alias("found"), single.alias("single"))

    @staticmethod
    def _parts(piece: bytes, ranks: dict[bytes, int]) -> Iterator[tuple[int, int]]:
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                yield a, b

    def id(self, part: Column) -> Column:
        return part.bitwiseAND(F.lit((1 << self.bits) - 1))

    def place(self, part: Column) -> Column:
        return part.bitwiseAND(F.lit((1 << self.shift) - (1 << self.bits)))

    def part(self, known: Column, id_: Column, place: Column, after: Column) -> Column:
        """A part, given its id and the next one's; the rank of the two is the id of what they make together."""
        at = (id_ * F.lit(FACTOR).cast("long") + after).bitwiseAND(F.lit(self.size - 1).cast("long"))
        rank = F.coalesce(F.element_at(F.get(known["found"], at), after), F.lit(self.none))
        return rank.bitwiseOR(place).bitwiseOR(id_)


def folded_ids(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of a word of bytes: its single bytes, folded by merging the adjacent pair of least rank, the first of equals, until none has one."""
    own = RankMap(ranks)
    n, none = F.octet_length(word), F.array().cast("array<int>")

    def singles(known: Column, letters: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.get(known["single"], F.ascii(F.substring(letters, i, F.lit(1)))))

    def merged(known: Column, acc: Column, least: Column, before: Column) -> Column:
        new, left = F.shiftright(least, own.shift), F.get(acc, before - 1)
        made = own.part(known, new, own.place(least), own.id(F.get(acc, before + 2)))
        rest = F.slice(acc, before + 3, n)
        begun = F.array(own.part(known, own.id(left), own.place(left), new), made)
        return F.when(before > 0, F.concat(F.slice(acc, F.lit(1), before - 1), begun, rest)).otherwise(F.concat(F.array(made), rest))

    def fold(known: Column, letters: Column) -> Column:
        def begin(ids: Column) -> Column:
            return F.transform(ids, lambda a, i: own.part(known, a, F.shiftleft(i.cast("long"), own.bits), F.get(ids, i + 1)))

        def step(acc: Column, _: Column) -> Column:
            def merge(least: Column) -> Column:
                # Not array_position: it leaves its loop by an exception.
                before = F.size(F.filter(acc, lambda x: own.place(x) < own.place(least)))
                return F.when(least >= own.none, acc).otherwise(_let(before, lambda b: merged(known, acc, least, b)))

            return _let(F.array_min(acc), merge)

        steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(none)
        return F.aggregate(steps, _let(singles(known, letters), begin), step, lambda acc: F.transform(acc, lambda x: own.id(x).cast("int")))

    ids = _let(own.known, lambda known: _let(F.decode(word, "ISO-8859-1"), lambda letters: fold(known, letters)))
    return F.when(n > 0, ids).otherwise(none)


def heaped_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word, with a heap of pairs and a linked list of parts."""
    part = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(ranks[p], i, p) for i in range(len(word) - 1) if (p := word[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, piece = heapq.heappop(heap)
        j = after[i] if part[i] is not None else len(word)
        if part[i] is None or j >= len(word) or len(part[i]) + len(part[j]) != len(piece) or part[i] + part[j] != piece:
            continue
        part[i], part[j], after[i] = piece, None, after[j]
        if after[i] < len(word):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(word) and (both := part[a] + part[b]) in ranks:
                heapq.heappush(heap, (ranks[both], a, both))
    return [ranks[p] for p in part if p is not None]


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes (binary) of an array of ids: the pieces of a literal array, joined. Null gives null, no ids give no bytes."""
    # Bytes as the letters of the same number, so that pieces join as text.
    letters = [bytes.fromhex(p).decode("latin-1") for p in _hex_pieces(ranks)]
    literal = _json(letters, T.ArrayType(T.StringType()))
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), ""), "ISO-8859-1")


class _Numbers(dict):
    """Numbers words in the order they come, so frequent words mostly have small numbers."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def latin_pattern(pattern: str) -> str | None:
    """The same pattern for Python's own, faster engine, for texts of Latin letters; None if it asks for more than L and N."""
    out, inside = [], False
    for token in re.findall(r"\\p\{[^}]*\}|\\.|.", pattern, re.DOTALL):
        inside = token == "[" or (inside and token != "]")
        kind = LATIN.get(token[3:-1]) if token.startswith("\\p{") else None
        if token.startswith("\\p{") and kind is None or token.startswith("\\P"):
            return None
        out.append(token if kind is None else kind if inside else f"[{kind}]")
    return "".join(out)


def _planes(numbers: bytes) -> bytes:
    """32-bit numbers as their first bytes, then their second ones and so on: small numbers compress better so."""
    return np.frombuffer(numbers, dtype=np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


def _pack(parts: list[bytes], numbers: bool = False) -> tuple[bytes, bytes]:
    """Lengths of the parts, and the parts joined; ``numbers``: they hold 32-bit numbers."""
    lengths, joined = np.array([len(x) for x in parts], dtype=np.uint32), b"".join(parts)
    return zlib.compress(_planes(lengths.tobytes()), 1), zlib.compress(_planes(joined) if numbers else joined, 1)


def _unpack(lengths: bytes, joined: bytes, numbers: bool = False) -> list[bytes]:
    ends = np.cumsum(_numbers(zlib.decompress(lengths)), dtype=np.int64).tolist()
    joined = zlib.decompress(joined)
    joined = _numbers(joined).tobytes() if numbers else joined
    return [joined[a:b] for a, b in zip([0, *ends], ends)]


TEXT, QUESTION, ORDER = 0, 1, 2


def _rows(block: int, kind: int, doc_ids=None, numbers=None, fragments=None, lengths=None, words=None) -> pd.DataFrame:
    n = len(next(x for x in (numbers, fragments) if x is not None))
    none = [None] * n
    return pd.DataFrame({
        "block": np.full(n, block, dtype=np.int64), "kind": np.full(n, kind, dtype=np.int32),
        "doc_id": pd.array(none if doc_ids is None else doc_ids, dtype="Int64"), "numbers": none if numbers is None else numbers,
        "fragment": pd.array(none if fragments is None else fragments, dtype="Int64"),
        "lengths": none if lengths is None else lengths, "words": none if words is None else words,
    })


def _split(pattern: str, fragments: int):
    """Texts of about ``BLOCK_CHARS`` in all become a block: per text the numbers of its words, per fragment the block's
    distinct words, and the order that the words have by fragment and number."""

    def block_rows(block: int, doc_ids: list, coded: list[bytes], numbers: _Numbers) -> Iterator[pd.DataFrame]:
        yield _rows(block, TEXT, doc_ids, coded)
        own = [w.encode() for w in numbers]
        dealt = np.fromiter((xxhash.xxh3_64_intdigest(w) % fragments for w in own), dtype=np.int64, count=len(own))
        order = np.argsort(dealt, kind="stable")
        yield _rows(block, ORDER, numbers=[zlib.compress(_planes(order.astype(np.uint32).tobytes()), 1)])
        ids, at = np.unique(dealt[order], return_index=True)
        packed = [_pack([own[k] for k in x.tolist()]) for x in np.split(order, at[1:])] if len(own) else []
        yield _rows(block, QUESTION, fragments=ids, lengths=[p[0] for p in packed], words=[p[1] for p in packed])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, latin = regex.compile(pattern).findall, latin_pattern(pattern)
        plain = re.compile(latin).findall if latin else None
        block = TaskContext.get().partitionId() << 32
        for pdf in batches:
            numbers, doc_ids, coded, size = _Numbers(), [], [], 0
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                words = [] if not text else plain(text) if plain and not ODD(text) else find(text)
                coded.append(_planes(np.fromiter(map(numbers.__getitem__, words), dtype=np.uint32, count=len(words)).tobytes()))
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                size += len(text or "")
                if size >= BLOCK_CHARS:
                    yield from block_rows(block, doc_ids, coded, numbers)
                    block += 1
                    numbers, doc_ids, coded, size = _Numbers(), [], [], 0
            if doc_ids:
                yield from block_rows(block, doc_ids, coded, numbers)
                block += 1

    return run


def _distinct(ranks: dict[bytes, int]):
    """The distinct words of a fragment; those too long for the fold with their ids."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        words = set()
        for lengths, joined in zip(pdf["lengths"], pdf["words"]):
            words.update(_unpack(lengths, joined))
        words = list(words)
        return pd.DataFrame({
            "fragment": np.full(len(words), key[0], dtype=np.int64), "word": words,
            "long_ids": [heaped_ids(w, ranks) if len(w) > FOLD_BYTES else None for w in words],
        })

    return run


def _dictionary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words and their ids, a row per fragment of a batch."""
    for pdf in batches:
        rows = []
        for fragment, own in pdf.groupby("fragment"):
            rows.append((fragment, *_pack(list(own["word"])), *_pack([np.asarray(i, dtype=np.uint32).tobytes() for i in own["ids"]], True)))
        yield pd.DataFrame(rows, columns=["fragment", "lengths", "words", "sizes", "ids"])


def _answers(key: tuple, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    ids = {}
    for lengths, words, sizes, codes in zip(known["lengths"], known["words"], known["sizes"], known["ids"]):
        ids.update(zip(_unpack(lengths, words), _unpack(sizes, codes, True)))
    rows = [
        (block, key[0], *_pack([ids[w] for w in _unpack(lengths, words)], True))
        for block, lengths, words in zip(asked["block"], asked["lengths"], asked["words"])
    ]
    return pd.DataFrame(rows, columns=["block", "fragment", "sizes", "ids"])


def _encoded(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The ids of a block's texts from those of its words, which come by fragment and number."""
    order = _numbers(zlib.decompress(pdf["numbers"][pdf["kind"] == ORDER].iloc[0]))
    texts, got = pdf[pdf["kind"] == TEXT], answers.sort_values("fragment")
    lengths = [_numbers(zlib.decompress(x)) // 4 for x in got["sizes"]]
    codes = [_numbers(zlib.decompress(x)) for x in got["ids"]]
    none = [np.empty(0, dtype=np.uint32)]
    by_order, codes = np.concatenate(lengths or none).astype(np.int64), np.concatenate(codes or none).astype(np.int32)
    size, start = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
    size[order], start[order] = by_order, np.cumsum(by_order) - by_order
    ids = []
    for data in texts["numbers"]:
        words = _numbers(data)
        n = size[words]
        ids.append(codes[np.repeat(start[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
    return pd.DataFrame({"doc_id": texts["doc_id"].astype("Int64"), "ids": ids})


def bpe_encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` per row: each match of ``pattern`` in the whole text encoded by ``ranks``, as tiktoken does.

    Null and empty texts have no ids. Every row is encoded, also rows that repeat a doc_id or have none; other columns are
    not read. ``ranks`` must hold all 256 single bytes.

    Each distinct word of the corpus is encoded once, by a fold of Spark's array functions over its bytes. A batch of texts is a
    block: it keeps the texts as numbers of its words, asks for the words and gets their ids. No table of words is
    broadcast, since it grows with the corpus.
    """
    if any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("the ranks must hold every single byte")
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    fragments = max(1, math.ceil((body.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / FRAGMENT_BYTES))
    parsed = store_bucketed(body.mapInPandas(_split(pattern, fragments), PARSED), "block")
    asked = parsed.where(F.col("kind") == QUESTION).select("fragment", "block", "lengths", "words")
    # Stored between the steps: a task then runs one Python worker at a time.
    words = asked.groupBy("fragment").applyInPandas(_distinct(ranks), "fragment long, word binary, long_ids array<int>")
    folded = F.when(F.col("long_ids").isNull(), folded_ids(F.col("word"), ranks)).otherwise(F.col("long_ids"))
    ids = materialise(words.select("fragment", "word", folded.alias("ids")), "ids")
    known = ids.mapInPandas(_dictionary, DICTIONARY)
    answers = asked.groupBy("fragment").cogroup(known.groupBy("fragment")).applyInPandas(_answers, ANSWERED)
    texts = parsed.where(F.col("kind") != QUESTION).select("block", "kind", "doc_id", "numbers")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_encoded, "doc_id long, ids array<int>")
