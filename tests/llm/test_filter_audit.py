"""The filter audit against a plain walk through every order."""

from __future__ import annotations

import random
import re
from fractions import Fraction
from itertools import permutations

import pytest

from timetab.llm.filter_audit import audit_part, coalition_removals, filter_audit, shapley_values

SCHEMA = "doc_id long, text string, lang string, part string, fails string, sha string, good string, n string, first string, step string"


def failing(rows):
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ""
        fails += "A" * (len(words) < 200)
        fails += "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
        fails += "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * any(i is not None and j is not None and j < i and (t or "") == text for j, t, _ in rows)
        out.append(fails)
    return out


def brute(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    fails, out = failing(rows), {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(i, f) for (i, _, p), f in zip(rows, fails) if (p or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                redundant = sum(x in f for _, f in mine) - len(gone)
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), redundant, sum(f == x for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, rows, labels, **options):
    extra = [(i, t, p, "p", "f", "s", "g", "n", "f", "s") for i, t, p in rows]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(extra, 3), SCHEMA) if extra else spark.createDataFrame([], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit(docs, marks, **options).collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got}
    assert len(out) == len(got)
    return out


def made_rows():
    r = random.Random(3)
    plain = [" ".join(f"word{r.randrange(900)}" for _ in range(260)) for _ in range(6)]
    rows = [(None, None, None), (1, None, "en"), (2, "", "en"), (3, " \t\x0b\n", "de"), (None, plain[0], "de"), (4, plain[0], "de"), (5, plain[0], "en"),
            (5, plain[0], "en"), (6, plain[0].upper(), "en"), (7, plain[1] + " #", None), (8, "same " * 300, "en"), (9, "A b & " * 90, ""),
            (10, "ÄÖÜ " * 210, "de"), (11, plain[2] + "\x1fx", "de"), (12, "a b " * 250, "de"), (13, "long " * 50_000 + "Z|", "en")]
    rows += [(20 + i, plain[3], r.choice(["en", "de"])) for i in range(30)]
    rows += [(100 + i, r.choice(plain) + r.choice(["", " %", " UPPER" * 40]), r.choice(["en", "fr"])) for i in range(30)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 130)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("limit", [None, 0])
def test_audit(spark, limit):
    rows, labels = made_rows()
    assert audited(spark, rows, labels, limit=limit) == brute(rows, labels)


def test_odd_tables(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    assert audited(spark, [(1, "x", "en")], []) == brute([(1, "x", "en")], [])
    assert audited(spark, [(1, "x", "en"), (2, "x", None)], [], part=None).keys() == brute([(1, "x", "")], []).keys()


def test_least_squares_is_shapley():
    r = random.Random(4)
    for m in (1, 2, 3, 5):
        value = [0] + [r.randrange(-50, 50) for _ in range((1 << m) - 1)]
        plain = [Fraction(0)] * m
        orders = list(permutations(range(m)))
        for order in orders:
            before = 0
            for f in order:
                plain[f] += Fraction(value[before | 1 << f] - value[before], len(orders))
                before |= 1 << f
        assert shapley_values(value) == plain


def test_removals():
    assert coalition_removals({0: 5, 1: 2, 3: 4}, 2) == [0, 6, 4, 6]
    import pandas as pd

    out = audit_part("x", pd.DataFrame({"fails": [0, 1, 3], "n": [5, 2, 4], "good": [1, 1, 0], "toxic": [0, 0, 1]}), "AB")
    assert out[out["step"] == 1][["filter_order", "kept", "removed", "redundant", "unique_fails", "shapley"]].values.tolist() == [
        ["AB", 5, 6, 0, 2, 8], ["BA", 7, 4, 0, 0, 4]]
