"""How filters of a corpus interact: what each removes in every order, and its Shapley share by exact constrained least squares.

What a set of filters removes together, its coalition's value, is counted for all 32 sets. Shapley values are the solution of a least
squares problem over the coalitions: additive shares that fit their values best under the Shapley kernel, and add up to what all
filters remove. The normal equations are solved in fractions, so the shares are exact. What a filter removes at a step of an order is the
difference of two coalitions.
"""

from __future__ import annotations

import string
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timetab.operators.joins import lookup_join, salted_join
from timetab.session import materialise

BLANK = "\t\n\x0b\x0c\r"
COUNTED = ["n", "good", "toxic"]
AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
    "toxic_lost long, shapley long"
)


def text_filters(text: Column) -> dict[str, Column]:
    """Failure of the four filters that look at one text: A too short, B repetitive, C shouting, D with markup symbols."""
    words = F.filter(F.split(F.translate(text, BLANK, " " * len(BLANK)), " "), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, string.ascii_uppercase, ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def shapley_weights(m: int) -> list[Fraction]:
    """The kernel weight of a coalition by its size; the empty and the full one are constraints instead."""
    return [Fraction(0) if s in (0, m) else Fraction(m - 1, comb(m, s) * s * (m - s)) for s in range(m + 1)]


def solve(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """Gauss-Jordan elimination in fractions."""
    rows = [[*row, b] for row, b in zip(matrix, right)]
    for i in range(len(rows)):
        pivot = next(r for r in range(i, len(rows)) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(len(rows)):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    return [row[-1] for row in rows]


def shapley_values(value: list[int]) -> list[Fraction]:
    """Shapley values of a game by its coalitions' values (bit f of an index: player f takes part), from weighted least squares.

    Minimises the kernel-weighted sum of (value(S) - sum of shares in S)**2 subject to the shares' sum being the full coalition's value: the
    normal equations with one multiplier.
    """
    m = (len(value) - 1).bit_length()
    weight = shapley_weights(m)
    matrix = [[Fraction(0)] * (m + 1) for _ in range(m + 1)]
    right = [Fraction(0)] * (m + 1)
    for s in range(1, len(value) - 1):
        players = [f for f in range(m) if s >> f & 1]
        for f in players:
            right[f] += weight[len(players)] * (value[s] - value[0])
            for g in players:
                matrix[f][g] += weight[len(players)]
    for f in range(m):
        matrix[f][m] = matrix[m][f] = Fraction(1)
    right[m] = Fraction(value[-1] - value[0])
    return solve(matrix, right)[:m]


def coalition_removals(failing: dict[int, int], m: int) -> list[int]:
    """For every set of filters, how many documents fail at least one of them; ``failing`` counts documents by the set that they fail."""
    return [sum(n for fails, n in failing.items() if fails & s) for s in range(1 << m)]


def audit_part(part: str, rows: pd.DataFrame, filters: str) -> pd.DataFrame:
    """All orders and steps of one part; ``rows`` counts documents, good and toxic ones by the set of filters they fail."""
    m = len(filters)
    removals = {c: coalition_removals(dict(zip(rows["fails"].tolist(), map(int, rows[c]))), m) for c in COUNTED}
    value, everyone = removals["n"], int(rows["n"].sum())
    shares = [int(x * factorial(m)) for x in shapley_values(value)]
    out = []
    for order in permutations(range(m)):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed = value[after] - value[before]
            others = (1 << m) - 1 - (1 << f)
            out.append((
                part, "".join(filters[i] for i in order), step, everyone - value[after], removed, value[1 << f] - removed,
                value[-1] - value[others], removals["good"][after] - removals["good"][before],
                removals["toxic"][after] - removals["toxic"][before], shares[f],
            ))
            before = after
    return pd.DataFrame(out, columns=[c.split()[0] for c in AUDIT.split(", ")])


def failing_sets(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str | None = "lang", limit: int | None = None
) -> DataFrame:
    """``part, fails, n, good, toxic``: documents by part and the set of filters that they fail (bit 0 is A, bit 4 is E).

    Texts are measured and hashed once and move no more. A document passes E if it is the smallest doc_id of its text: one join on (text's
    hash, doc_id), so a text that stands in a third of all rows is no hot key. ``limit`` is the size up to which a table may be broadcast.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    group = F.lit("") if part is None else F.coalesce(F.col(part).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), group.alias("part"), body.alias("body"))
    flags = text_filters(F.col("body"))
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(flags.values())), F.lit(0))
    rows = materialise(rows.select("doc_id", "part", F.sha2("body", 256).alias("sha"), bits.alias("fails")), "flags")
    # Copies of a row count as many: rows that repeat a doc_id with its text all pass or all fail.
    firsts = rows.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    options = {} if limit is None else {"limit": limit}
    joined = lookup_join(rows, known, ["doc_id"], "left", **options)
    joined = salted_join(joined, firsts, ["doc_id", "sha"], "left")
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return joined.groupBy("part", (F.col("fails") + F.when(later, 1 << len(flags)).otherwise(0)).alias("fails")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(F.col("toxic"), 1)).alias("toxic")
    )


def filter_audit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str | None = "lang", limit: int | None = None
) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` of five filters.

    One row per part, order of the filters ABCDE and step. Filters A to D look at a text (see ``text_filters``); E fails if a row with a smaller
    doc_id anywhere in the table has the identical text. ``kept`` counts after the step, ``removed`` in it, ``redundant`` what fails the filter
    but went before, ``unique_fails`` what fails no other, ``good_lost`` and ``toxic_lost`` removed documents so labelled, ``shapley`` what the
    filter removes summed over all orders.

    A null text is empty, a null part the empty name. A row without a doc_id never fails E, makes no other row fail it and has no label; rows that
    repeat a doc_id count each, and are no copies of one another. A document labelled more than once is good or toxic if one
    of its labels says so. Other columns are not read; an empty table gives no rows. At most 32 counts per part leave the aggregate.
    """
    counted = failing_sets(docs, labels, doc_id, text, part, limit)

    def audit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return audit_part(key[0], rows, "ABCDE")

    return counted.groupBy("part").applyInPandas(audit, AUDIT)
