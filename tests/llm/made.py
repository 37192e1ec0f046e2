"""Small frames with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

import pytest

SF_DIR = "/root/testdata/sf0.001"
# Extra columns named like the operators' own.
SCHEMA = "doc_id long, text string, lang string, row_key string, block string, n string, label string, key string, carried string"


def frame(spark, rows, slices=3):
    """rows: (doc_id, text)."""
    extra = [(d, t, "en", "x", "y", None, "z", "k", "c") for d, t in rows]
    return spark.createDataFrame(spark.sparkContext.parallelize(extra, slices), SCHEMA) if extra else spark.createDataFrame([], SCHEMA)


def prose(seed, n, vocabulary=5000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    base, shared = prose(1, 300), prose(2, 60)
    w = base.split()
    near = " ".join([*w[:100], "changed", *w[101:]])
    family = [" ".join([*w[:i], f"edit{i}", *w[i + 1 :]]) for i in range(0, 300, 25)]
    rows = [
        (None, None), (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "One TWO"), (6, base), (6, base), (7, base.upper()),
        (8, near), (9, prose(3, 80) + " " + shared + " " + prose(4, 90)), (10, shared + "\n" + prose(5, 70)), (11, prose(6, 40) + " " + shared),
        (12, "Ünï çödé   \x1f naïve ÀÉ İstanbul ΑΣ word"), (13, "ünï çödé   \x1f naïve ÀÉ İstanbul ΑΣ word"),
        (14, "a" * 3000), (15, "ab" * 900), (16, "x y " * 400), (None, base), (17, prose(7, 4000, 400)), (18, prose(8, 3000, 40)),
        (19, "word " * 200), (20, prose(9, 2000) + " end"), (21, prose(9, 2000)), (22, "tail"), (22, "tail"), (None, "tail"),
    ]
    return rows + [(100 + i, f) for i, f in enumerate(family)]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
