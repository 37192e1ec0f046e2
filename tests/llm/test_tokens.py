"""BPE against tiktoken, packing against tokenizers and a plain best fit."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from made import frame, odd_rows, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from timetab.llm.byte_bpe import _numbers, _pack, _planes, _unpack, bpe_encode, decode, folded_ids, heaped_ids, read_ranks
from timetab.llm.packing import WordEncoder, best_fit_plan, pack_documents

RANKS = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
SPEC = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
ODD = [
    "a  b   c    d", " \n x \n\n  y\t\tz  ", "it's we'll they'd I'M 'tis", "naïve Ünïcödé ΑΣΣ İstanbul ǅ ß ﬁ", "日本語 テキスト 123 ４５", " nb sp\x85nel\x1cfs",
    "é combining ́lone", "emoji 😀👩‍👩‍👧 end", "x" * 300, "#$%^&*()!!! ...", "<|endoftext|> a<|startoftext|>b", "tab\tnew\r\nline\x0b\x0c", "½ ² ٣",
]


def test_bpe_against_tiktoken(spark):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    rows = [*odd_rows(), *[(1000 + i, t) for i, t in enumerate(ODD)], (2000, "".join(random.Random(1).choice("abcde") for _ in range(3000)))]
    out = bpe_encode(frame(spark, rows), RANKS, public_tokenizers.PATTERN)
    got = out.select("doc_id", "ids", decode(F.col("ids"), RANKS).alias("bytes")).collect()
    want = Counter((d, tuple(known.encode_ordinary(t or "")), (t or "").encode()) for d, t in rows)
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["bytes"])) for r in got) == want


def test_bpe_documents(documents):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    want = {r["doc_id"]: known.encode_ordinary(r["text"]) for r in documents.collect()}
    assert {r["doc_id"]: r["ids"] for r in bpe_encode(documents, RANKS, public_tokenizers.PATTERN).collect()} == want


def test_fold_equals_heap(spark):
    r = random.Random(3)
    words = [bytes(r.choice(b"aeinrst \xc3\xa9") for _ in range(n)) for n in range(1, 60)]
    df = spark.createDataFrame([(bytearray(w),) for w in words], "w binary").select("w", folded_ids(F.col("w"), RANKS).alias("ids"))
    assert {bytes(x["w"]): x["ids"] for x in df.collect()} == {w: heaped_ids(w, RANKS) for w in words}


def test_fold_holds_its_ranks_once(spark):
    assert str(folded_ids(F.col("w"), RANKS)).count("from_json(") == 2  # the pairs and the single bytes, no copies
    odd = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"aa": 257, b"aab": 300, b"aaa": 299, b"aabaa": 301}
    words = [bytes(random.Random(i).choices(b"ab", k=i % 14)) for i in range(200)]
    df = spark.createDataFrame([(bytearray(w),) for w in words] + [(None,)], "w binary").select("w", folded_ids(F.col("w"), odd).alias("ids"))
    assert {bytes(x["w"] or b""): x["ids"] for x in df.collect()} == {w: heaped_ids(w, odd) for w in words}


def test_packed_numbers():
    r = np.random.default_rng(5)
    for n in (0, 1, 1000):
        numbers = np.minimum(r.zipf(1.2, n), 1 << 31).astype(np.uint32)
        assert _numbers(_planes(numbers.tobytes())).tolist() == numbers.tolist()
    parts = [r.integers(0, 50000, k).astype(np.uint32).tobytes() for k in r.integers(0, 9, 5000)]
    assert _unpack(*_pack(parts, True), True) == parts and _unpack(*_pack(parts)) == parts
    assert sum(map(len, _pack(parts, True))) < 0.8 * sum(map(len, _pack(parts)))


def test_bpe_empty(spark):
    assert bpe_encode(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe_encode(frame(spark, []), {b"a": 0}, public_tokenizers.PATTERN)


def test_word_encoder():
    whole = Tokenizer.from_str(SPEC)
    own = WordEncoder(SPEC)
    for text in [*ODD, prose(1, 200), *[t for _, t in odd_rows() if t]]:
        assert np.frombuffer(own(text), dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 7, 50, 100, 4096])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 300))] + [capacity // 3 + 1] * r.randint(0, 50)
    plan = best_fit_plan(Counter(lengths), capacity)
    fill, used = Counter(), Counter()
    for n, first, many, bin_, per, offset in plan.tolist():
        for q in range(many):
            b, o = bin_ + q // per, offset + q % per * n
            assert fill[b] == o or (b, o) not in used
            used[b, o] = n
            fill[b] = max(fill[b], o + n)
    for b in fill:  # gapless
        at = 0
        for o in sorted(o for x, o in used if x == b):
            assert o == at
            at = o + used[b, o]
        assert at == fill[b] <= capacity
    assert Counter(used.values()) == Counter(lengths)
    assert sorted(capacity - x for x in fill.values()) == brute.best_fit(lengths, capacity)


def check_packing(rows, pieces, capacity):
    whole = Tokenizer.from_str(SPEC)
    ids = [(d, [*whole.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows]
    want = Counter(
        (d, i, s, len(x[s : s + capacity]), zlib.crc32(np.array(x[s : s + capacity], dtype="<u4").tobytes()))
        for d, x in ids for i, s in enumerate(range(0, len(x), capacity))
    )
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == want
    sequences = {}
    for r in pieces:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) == len(brute.best_fit([n for x in want.elements() for n in [x[3]]], capacity))


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(spark, capacity):
    rows = [*odd_rows(), *[(1000 + i, t) for i, t in enumerate(ODD)]]
    check_packing(rows, pack_documents(frame(spark, rows, 5), SPEC, capacity).collect(), capacity)


def test_packing_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    check_packing(rows, pack_documents(documents, SPEC).collect(), 4096)


def test_packing_empty(spark):
    assert pack_documents(frame(spark, []), SPEC).count() == 0
