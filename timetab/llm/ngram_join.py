"""Near-duplicate documents by Jaccard similarity of word n-grams, joined by vertical partitions of the n-gram order."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timetab.llm.blocks import (
    answer_fragments, answered, ask, ask_blocks, fragments_for, store_blocks, tally, window_hashes,
)
from timetab.llm.components import connected_components
from timetab.llm.texts import word_hashes, words_of
from timetab.session import materialise

FOUND = "row_key long, doc_id long, n_shingles long, class binary, central double, tokens array<long>, prefix array<long>"
VERTICAL = 8


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, a text without words has none."""
    found = words_of(text, lower=True)
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], dtype=np.uint64)
    return np.unique(window_hashes(word_hashes(found), words))


class _Sets:
    """The distinct shingle sets of one block, and the distinct shingles of all of them."""

    def __init__(self, pdf: pd.DataFrame, words: int):
        self.sets = [shingle_set(t, words) for t in pdf["text"]]
        self.classes = [xxhash.xxh3_128_digest(s.tobytes()) for s in self.sets]
        self.first = {}
        for i, c in enumerate(self.classes):
            if len(self.sets[i]):
                self.first.setdefault(c, i)
        own = [self.sets[i] for i in self.first.values()]
        every = np.concatenate(own) if own else np.empty(0, dtype=np.uint64)
        self.keys, self.at, self.counts = np.unique(every, return_inverse=True, return_counts=True)


def _needed(n, percent: int):
    """The least overlap of a set of n with any set it may be linked to."""
    return -(-n * percent // 100)


def find_candidates(blocks: DataFrame, words: int, percent: int) -> DataFrame:
    """Every document with its class (equal sets), and of classes that can have a partner the shared shingles and the prefix.

    A shingle of one class only cannot overlap. A class whose shared shingles are fewer than the least overlap is out; of
    the others the prefix of the global order (rare first, lone shingles before all) must meet any partner's prefix.
    ``central`` is the mean level of a class's shingles: of a family of near copies, the one that most others resemble leads.
    """
    fragments = fragments_for(blocks)

    def first_round(block, pdf):
        s = _Sets(pdf, words)
        return ask(block, s.keys, s.counts, fragments, wide=False)

    def second_round(block, pdf, answers):
        s = _Sets(pdf, words)
        level = answered(answers, 1, s.keys, fragments)[s.at]
        tokens, prefixes, central, done = {}, {}, {}, 0
        for c, i in s.first.items():
            own = s.sets[i]
            n, mine = len(own), level[done : done + len(own)]
            done += n
            shared = mine > 0
            many, least = int(shared.sum()), _needed(n, percent)
            if many >= least:
                kept, weight = own[shared], mine[shared]
                tokens[i] = kept.view(np.int64)
                central[i] = float(weight.sum()) / n
                prefixes[i] = kept[np.lexsort((kept, weight))][: many - least + 1].view(np.int64)
        rows = range(len(s.sets))
        return pd.DataFrame({
            "row_key": pdf["row_key"], "doc_id": pdf["doc_id"].astype("Int64"), "n_shingles": [len(x) for x in s.sets], "class": s.classes,
            "central": [central.get(i) for i in rows], "tokens": [tokens.get(i) for i in rows], "prefix": [prefixes.get(i) for i in rows],
        })

    answers = materialise(answer_fragments(ask_blocks(blocks, first_round), tally(wide=False, stage=1)), "shared")
    return materialise(ask_blocks(blocks, second_round, answers, FOUND), "sets")


def one_per_class(found: DataFrame) -> DataFrame:
    """The sets of classes that can have a partner, once per class; ``many`` is the number of shared shingles."""
    one = found.where("tokens IS NOT NULL").groupBy("class").agg(
        *[F.first(c).alias(c) for c in ("n_shingles", "central", "tokens", "prefix")]
    )
    return materialise(one.withColumnRenamed("n_shingles", "n").withColumn("many", F.size("tokens").cast("long")), "classes")


def _met(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) with the parts of both sets in each vertical fragment of the shingle order."""
    piece = F.transform(
        F.sequence(F.lit(0), F.lit(VERTICAL - 1)),
        lambda v: F.filter("tokens", lambda t: F.shiftright(t, 60).bitwiseAND(F.lit(VERTICAL - 1)) == v),
    )
    cut = classes.select("class", F.posexplode(piece).alias("v", "part"))
    left = pairs.join(cut.withColumnRenamed("class", "a"), "a").withColumnRenamed("part", "part_a")
    return left.join(cut.withColumnRenamed("class", "b").withColumnRenamed("part", "part_b"), ["b", "v"])


def similar_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked: overlaps are counted per vertical fragment, then summed per pair."""
    partial = _met(pairs, classes).select("a", "b", "na", "nb", F.size(F.array_intersect("part_a", "part_b")).cast("long").alias("overlap"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap")).where(_similar(percent)).select("a", "b")


def _similar(percent: int) -> Column:
    return 100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))


def _sizes_fit(percent: int) -> Column:
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _ordered(x: str, y: str, nx: str, ny: str) -> list[Column]:
    """A pair's columns a < b with their sizes."""
    first = F.col(x) < F.col(y)
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b"),
            F.when(first, F.col(nx)).otherwise(F.col(ny)).alias("na"), F.when(first, F.col(ny)).otherwise(F.col(nx)).alias("nb")]


def choose_pivots(classes: DataFrame) -> DataFrame:
    """``class, n, many, pivot``: of all classes that share a prefix shingle with it, the most central, maybe itself.

    Classes without a shared prefix shingle have no partner and are left out.
    """
    postings = classes.select("class", F.explode("prefix").alias("token"), F.struct("central", "class").alias("self"))
    tops = postings.groupBy("token").agg(F.max("self").alias("top"), F.min("self").alias("low")).where("top <> low")
    best = postings.join(tops, "token").groupBy("class").agg(F.max("top").alias("top"))
    return classes.select("class", "n", "many").join(best.select("class", F.col("top.class").alias("pivot")), "class")


def compare_to_pivots(pivots: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Each class next to its pivot: overlap, whether linked, and the shared shingles it lacks or has beyond the pivot's."""
    pairs = pivots.where("class <> pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b"), F.col("n").alias("na"))
    sizes = classes.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("many").alias("many_b"))
    met = _met(pairs, classes).groupBy("a", "b", "na").agg(
        F.sum(F.size(F.array_intersect("part_a", "part_b"))).alias("overlap"),
        F.flatten(F.collect_list(F.array_except("part_b", "part_a"))).alias("lacks"),
        F.flatten(F.collect_list(F.array_except("part_a", "part_b"))).alias("beyond"),
    )
    return met.join(sizes, "b").withColumn("linked", _similar(percent))


def difference_candidates(stars: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes with one pivot that may be linked, are not known to be connected, and of which one is not linked to the pivot.

    With D the shingles of the pivot that a class lacks and E those it has beyond it, two classes x and z overlap in
    n(pivot) - |D(x)| - |D(z)| + |D(x) & D(z)| + |E(x) & E(z)|. If z is not linked to the pivot, a link of x and z therefore
    needs more than |D(x)| - f * (n(pivot) - n(x)) shingles in common between their differences, f being the share of the
    summed sizes that a link's overlap must reach. So only a prefix of x's differences, rare ones first, looks for z.
    """
    whole = 100 + percent
    d, e = F.col("nb") - F.col("overlap"), F.col("na") - F.col("overlap")
    least = F.greatest(F.lit(1), F.floor((whole * d - percent * (F.col("nb") - F.col("na"))) / F.lit(whole)) + 1)
    lone_extra, lone_pivot = e - F.size("beyond"), F.col("nb") - F.col("many_b")
    known = stars.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a")).withColumns({
        # What the prefix holds after the shingles that no other class has.
        "room": d + e - least + 1 - lone_extra, "lone_pivot": lone_pivot, "own": F.size("lacks") + F.size("beyond"),
        "differs": F.concat(
            F.transform("lacks", lambda t: F.struct(F.lit(0).alias("kind"), t.alias("token"))),
            F.transform("beyond", lambda t: F.struct(F.lit(1).alias("kind"), t.alias("token"))),
        ),
    })
    # All classes of a star lack the shingles that only the pivot has: one common mark stands for them.
    mark = F.when(F.col("lone_pivot") > 0, F.array(F.struct(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("token")))).otherwise(
        F.array().cast("array<struct<kind:int,token:long>>")
    )
    spread = known.select("a", "b", "na", "label", "linked", "room", "own", F.explode(F.concat("differs", mark)).alias("t"))
    targets = spread.where("NOT linked").select("b", "t", F.col("a").alias("z"), F.col("na").alias("nz"), F.col("label").alias("other"))
    wanted = targets.groupBy("b", "t").agg(F.count(F.lit(1)).alias("u"))
    probes = spread.where("room > 0").join(wanted, ["b", "t"], "left")
    order = Window.partitionBy("a").orderBy(F.col("t.kind") == 2, F.coalesce("u", F.lit(0)), "t")
    probes = probes.withColumn("nth", F.row_number().over(order)).where(
        F.col("u").isNotNull() & F.when(F.col("t.kind") == 2, F.col("room") > F.col("own")).otherwise(F.col("nth") <= F.col("room"))
    ).select("a", "b", "t", "na", "label")
    met = probes.join(targets, ["b", "t"]).where("a <> z AND label <> other")
    return met.select(*_ordered("a", "z", "na", "nz")).where(_sizes_fit(percent)).distinct()


def cross_candidates(classes: DataFrame, pivots: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that share a prefix shingle, have different pivots and are not known to be connected.

    Groups (shingle, pivot, component) meet first, then their members, so no pair inside a star or a component is made.
    """
    known = pivots.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    postings = classes.select("class", F.explode("prefix").alias("token")).join(known, "class")
    mixed = postings.groupBy("token").agg(
        F.min("pivot").alias("p"), F.max("pivot").alias("q"), F.min("label").alias("l"), F.max("label").alias("m")
    ).where("p <> q AND l <> m").select("token")
    left = materialise(postings.join(mixed, "token"), "mixed")
    groups = left.select("token", "pivot", "label").distinct()
    ours = groups.select("token", F.col("pivot").alias("p"), F.col("label").alias("l"))
    theirs = groups.select("token", F.col("pivot").alias("q"), F.col("label").alias("m"))
    meet = ours.join(theirs, "token").where("p < q AND l <> m")

    def members(names: tuple[str, ...]) -> DataFrame:
        return left.select("token", *[F.col(a).alias(b) for a, b in zip(("pivot", "label", "class", "n", "many"), names)])

    # The overlap is at most the shared shingles of the smaller side.
    reach = (100 + percent) * F.least("kx", "ky") >= percent * (F.col("nx") + F.col("ny"))
    pairs = meet.join(members(("p", "l", "x", "nx", "kx")), ["token", "p", "l"]).join(
        members(("q", "m", "y", "ny", "ky")), ["token", "q", "m"]
    ).where(reach)
    return pairs.select(*_ordered("x", "y", "nx", "ny")).where(_sizes_fit(percent)).distinct()


def link_classes(classes: DataFrame, percent: int) -> DataFrame:
    """``node, label``: the components that links make among classes; classes without a link are left out.

    A family of thousands of near copies must not become all its pairs. Every class is compared with its pivot. Two classes
    of one pivot are linked through it, or differ from it alike and meet by their differences; classes of different
    pivots meet by their prefixes. So every pair is verified, or connected, or proved not to be linked.
    """
    pivots = materialise(choose_pivots(classes), "pivots")
    stars = materialise(compare_to_pivots(pivots, classes, percent), "stars")
    linked = stars.where("linked").select("a", "b")
    labels = connected_components(linked)
    near = materialise(difference_candidates(stars, labels, percent), "near")
    cross = materialise(cross_candidates(classes, pivots, labels, percent), "cross")
    more = materialise(similar_pairs(near.unionAll(cross), classes, percent), "links")
    # Only links between components are left, and they join whole components.
    named = more
    for side in ("a", "b"):
        own = labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
        named = named.join(own, side, "left").withColumn(f"{side}_label", F.coalesce(f"{side}_label", side))
    joined = connected_components(named.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))
    top = joined.select(F.col("node").alias("label"), F.col("label").alias("top"))
    every = labels.unionAll(joined.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    return materialise(every.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "components")


def grouped_rows(blocks: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``row_key, doc_id, n_shingles, label`` of stored blocks: label names the component; rows without words have none."""
    found = find_candidates(blocks, words, percent)
    labels = link_classes(one_per_class(found), percent)
    rows = found.select("row_key", "doc_id", "n_shingles", "class")
    named = rows.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    return named.select("row_key", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("label")).alias("label"))


def one_of_each_group(blocks: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The row_key of the first row of each component (least doc_id, then row), and of every row without words."""
    rows = grouped_rows(blocks, words, percent)
    first = rows.where("label IS NOT NULL").groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("first")
    )
    return first.select("first.row_key").unionAll(rows.where("label IS NULL").select("row_key"))


def ngram_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: components of links ``100 * overlap >= percent * union``.

    Shingles are ``words`` consecutive words of the text with A-Z lowered. A text with fewer words is one shingle; null,
    empty and blank texts have none, are linked with nothing and are their own component. component_id is the smallest
    doc_id that links reach. Rows that repeat a doc_id are documents of their own that share the id; rows with a null
    doc_id count as documents, and a component of such rows only has a null id. Other columns are not read.

    Vertical partitioning: the order of all shingles is cut into fragments. The first pass counts, per fragment, in how
    many classes a shingle stands (see ``blocks``); the last counts partial overlaps of candidate pairs per fragment and
    sums them per pair. Shingles are 64-bit hashes.
    """
    rows = materialise(grouped_rows(store_blocks(docs, doc_id, text), words, percent), "grouped")
    least = rows.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = rows.where("label IS NOT NULL").join(least, "label").select("doc_id", "n_shingles", "component_id")
    return linked.unionAll(rows.where("label IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
