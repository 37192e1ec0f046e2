"""Near, exact and substring duplicates against brute force."""

from __future__ import annotations

import random
from collections import Counter

import brute
import numpy as np
import pytest
from made import frame, odd_rows, prose
from pyspark.sql import functions as F

from timetab.llm import blocks as B
from timetab.llm.components import connected_components
from timetab.llm.exact_dedup import exact_dedup, exact_filter, grow_directory
from timetab.llm.ngram_join import ngram_components
from timetab.llm.substring_dedup import COVER, PERIOD, covers, substring_dedup
from timetab.llm.suffix_dedup import suffix_dedup


def test_blocks_by_bytes(spark):
    """Blocks hold a bounded number of bytes, whatever one partition unpacks to; a row is in one block."""
    rows = [(i, "same words " * 50) for i in range(500)] + [(1000, "x" * 50_000), (1001, None), (None, "")]
    df = B.store_blocks(frame(spark, rows, 2), carry=["label"], block_bytes=10_000)
    sizes = {r["block"]: (r["n"], r["most"]) for r in df.selectExpr("block", "octet_length(text) AS n").groupBy("block").agg(
        F.sum("n").alias("n"), F.max("n").alias("most")).collect()}
    assert len(sizes) >= 27 and all((n or 0) < 10_000 + (most or 0) for n, most in sizes.values())
    assert df.count() == len(rows) == df.select("row_key").distinct().count()
    assert bag((d, None if t is None else bytes(t).decode()) for d, t in df.select("doc_id", "text").collect()) == bag(rows)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return Counter(tuple(tuple(x) if isinstance(x, list) else bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows)


def test_window_hashes():
    values = np.array([3, 1, 4, 1, 5, 3, 1, 4, 1, 5], dtype=np.uint64)
    for width in (1, 2, 3, 5):
        got = B.window_hashes(values, width)
        want = [tuple(values[i : i + width]) for i in range(len(values) - width + 1)]
        assert len(got) == len(want)
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(want)) for j in range(len(want)))
    assert len(B.window_hashes(values, 11)) == 0


@pytest.mark.parametrize("percent", [80, 60])
def test_ngram_components(spark, percent):
    rows = odd_rows()
    assert bag(ngram_components(frame(spark, rows), percent=percent).collect()) == bag(brute.components(rows, percent))


def test_ngram_hot_family(spark):
    """Near copies of one text become one component without all their pairs; a chain holds together by its links."""
    w = prose(11, 120).split()
    rows = [(i, " ".join([*w[: i % 110], f"e{i}", *w[i % 110 + 1 :]])) for i in range(300)]
    chain = prose(12, 200).split()
    rows += [(1000 + i, " ".join([f"c{j}" if j < 6 * i else x for j, x in enumerate(chain)])) for i in range(20)]
    assert bag(ngram_components(frame(spark, rows, 7)).collect()) == bag(brute.components(rows))


@pytest.mark.parametrize("seed", range(4))
def test_ngram_families(spark, seed):
    """Families around texts that need not be there, whose members are linked to some of the others only."""
    r = random.Random(seed)
    rows = []
    for f in range(6):
        base = prose(100 * seed + f, r.randint(60, 160)).split()
        for _ in range(r.choice([5, 40])):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice([f"n{r.randrange(10**6)}", f"s{r.randrange(3)}"])
            if r.random() < 0.3:
                w = w[: r.randint(40, len(w))]
            if r.random() < 0.2:
                w += [f"t{r.randrange(10**6)}" for _ in range(r.randint(1, 20))]
            rows.append((len(rows), " ".join(w)))
    assert bag(ngram_components(frame(spark, rows, 4)).collect()) == bag(brute.components(rows))


def test_ngram_documents(documents):
    assert bag(ngram_components(documents).collect()) == bag(brute.components(pairs(documents)))


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (5, 6), (6, 7), (7, 7)], "a long, b long")
    assert {tuple(r) for r in connected_components(links).collect()} == {*((i, 1) for i in range(1, 8)), (8, 8), (9, 8)}


def test_cover():
    assert covers(COVER, PERIOD)
    assert not covers((0, 1, 4), PERIOD)


@pytest.mark.parametrize("width", [35, 21])
def test_substring(spark, width):
    rows = odd_rows()
    assert bag(substring_dedup(frame(spark, rows), width=width).collect()) == bag(brute.stripped_words(rows, width))


def test_substring_documents(documents):
    assert bag(substring_dedup(documents).collect()) == bag(brute.stripped_words(pairs(documents)))


@pytest.mark.parametrize("width,phrase", [(400, 48), (40, 8)])
def test_suffix(spark, width, phrase):
    rows = odd_rows()
    assert bag(suffix_dedup(frame(spark, rows), width=width, phrase=phrase).collect()) == bag(brute.stripped_bytes(rows, width))


def test_suffix_documents(documents):
    assert bag(suffix_dedup(documents).collect()) == bag(brute.stripped_bytes(pairs(documents)))


@pytest.mark.parametrize("bits,capacity,task_rows", [(64, 256, 1 << 16), (64, 3, 2), (3, 2, 1), (1, 100, 3)])
def test_exact(spark, bits, capacity, task_rows):
    rows = odd_rows()
    options = {"hash_bits": bits, "bucket_entries": capacity, "task_rows": task_rows}
    assert bag(exact_dedup(frame(spark, rows), **options).collect()) == bag(brute.exact_groups(rows))
    filtered = exact_filter(frame(spark, rows), **options)
    assert filtered.columns == frame(spark, rows).columns
    kept = Counter((r["doc_id"], (r["text"] or "")) for r in filtered.collect())
    groups = brute.exact_groups(rows)
    assert sum(kept.values()) == sum(bool(g[3]) for g in groups) and set(kept.values()) == {1}
    assert Counter(d for d, _ in kept) == Counter(g[0] for g in groups if g[3])


def test_exact_hot_text(spark):
    """A text in most rows is dealt out, and buckets of a few entries split."""
    rows = [(i, "Hot text") for i in range(400)] + [(1000 + i, f"text {i % 300}") for i in range(450)]
    got = exact_dedup(frame(spark, rows, 9), bucket_entries=8, task_rows=50)
    assert bag(got.collect()) == bag(brute.exact_groups(rows))


def test_directory(spark):
    """Buckets hold their capacity, are as few as splits allow, and cover the key space."""
    keys = [(i * 0x9E3779B97F4A7C15 + 77) % 2**64 - 2**63 for i in range(2000)] + [5] * 50
    depth, slots = grow_directory(spark.createDataFrame([(k,) for k in keys], "key long"), "key", 20)
    fill = Counter(slots[(k % 2**64) >> (64 - depth)] for k in keys)
    own = slots[5 >> (64 - depth)]
    assert len(slots) == 1 << depth
    assert all(n <= 20 for b, n in fill.items() if b != own) and fill[own] >= 50
    assert slots == sorted(slots)


@pytest.mark.parametrize("operator", [ngram_components, substring_dedup, suffix_dedup, exact_dedup])
def test_empty(spark, operator):
    assert operator(frame(spark, [])).count() == 0
    assert operator(frame(spark, [(None, None)])).count() == 1
