"""Quality rules whose cutoffs are chosen on labelled documents with exact binomial bounds. Only Spark's own functions are used."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timetab.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]+"
PLACE_BITS = 20
RISK = 0.01
CONFIDENCE_LOSS = 0.05
# Of the confidence loss, what the joint cutoffs leave to the separate ones.
SEPARATE_SHARE = 0.1

# Each rule's value (a large one is bad) and the cutoffs that are tried, from the loosest to the strictest.
RULES = {
    "symbols": ("n_symbols / n_words", [1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02]),
    "dup_lines": ("n_dup_lines / n_lines", [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "repeats": ("n_repeat_words / n_words", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08]),
    "long_words": ("word_chars / n_words", [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.5, 9.0]),
    "short_words": ("-word_chars / n_words", [-1.5, -2.0, -2.5, -3.0, -3.25, -3.5, -3.75, -4.0]),
}


def _word(words: Column, i: Column) -> Column:
    return F.get(words, i)


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that occurs twice or more in the array.

    Windows are sorted as longs, the hash before the place, so equal ones are neighbours; the words decide. Past a million
    words (the room for the place) hash and place are sorted as a struct.
    """
    windows = F.size(words) - 2
    low, high = F.lit((1 << PLACE_BITS) - 1).cast("long"), F.lit(-(1 << PLACE_BITS)).cast("long")

    def hashed(i: Column) -> Column:
        return F.xxhash64(_word(words, i), _word(words, i + 1), _word(words, i + 2))

    def same(a: Column, b: Column) -> Column:
        out = _word(words, a) == _word(words, b)
        for k in (1, 2):
            out = out & (_word(words, a + k) == _word(words, b + k))
        return out

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), 0)

    def packed(ordered: Column) -> Column:
        def key(x: Column) -> Column:
            return F.shiftright(x, PLACE_BITS)

        def place(x: Column) -> Column:
            return x.bitwiseAND(low).cast("int")

        def meets(x: Column, y: Column) -> Column:
            return F.coalesce((key(x) == key(y)) & same(place(x), place(y)), F.lit(False))

        twice = F.filter(ordered, lambda x, i: meets(x, F.get(ordered, i + 1)) | meets(x, F.get(ordered, i - 1)))
        found = F.when(
            F.size(F.array_distinct(F.transform(ordered, key))) < F.size(ordered), F.sort_array(F.transform(twice, place))
        ).otherwise(F.array().cast("array<int>"))
        return let(found, covered)

    def structs(ordered: Column) -> Column:
        def meets(x: Column, y: Column) -> Column:
            return F.coalesce((x["h"] == y["h"]) & same(x["i"], y["i"]), F.lit(False))

        twice = F.filter(ordered, lambda x, i: meets(x, F.get(ordered, i + 1)) | meets(x, F.get(ordered, i - 1)))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    every = F.sequence(F.lit(0), windows - 1)
    small = let(F.sort_array(F.transform(every, lambda i: hashed(i).bitwiseAND(high).bitwiseOR(i.cast("long")))), packed)
    large = let(F.sort_array(F.transform(every, lambda i: F.struct(hashed(i).alias("h"), i.alias("i")))), structs)
    return F.when(windows < 2, F.lit(0).cast("long")).when(windows < (1 << PLACE_BITS), small).otherwise(large)


def text_measures(docs: DataFrame, doc_id: str, text: str, stratum: str | None, whole_rows: bool = False) -> DataFrame:
    """``doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed`` per row.

    All are measured on whole texts. ``whole_rows`` adds all columns of ``docs`` as the struct ``row``.
    """
    row = [F.struct(*docs.columns).alias("row")] if whole_rows else []
    taken = ["row"] if whole_rows else []
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    group = F.lit("") if stratum is None else F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    lines = F.filter(F.split("body", "\n", -1), lambda x: x.rlike(WORD))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), group.alias("stratum"), body.alias("body"), *row).select(
        *taken, "doc_id", "stratum", "body", F.regexp_extract_all("body", F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines")
    ).select(
        *taken, "doc_id", "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.regexp_replace("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), summed term by term in logarithms; 1 where k/n reaches p, which no bound can pass."""
    start = F.struct((n * F.log1p(F.lit(-p))).alias("term"), (n * F.log1p(F.lit(-p))).alias("total"))
    odds = F.log(F.lit(p / (1 - p)))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        # The larger first: log(e^a + e^b) = a + log(1 + e^(b - a)).
        return F.struct(
            term.alias("term"),
            (F.greatest(acc["total"], term) + F.log1p(F.exp(-F.abs(acc["total"] - term)))).alias("total"),
        )

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    tail = F.exp(F.aggregate(steps, start, step, lambda acc: acc["total"]))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(tail)


def risk_cutoffs(holdout: DataFrame, rules: dict = RULES, risk: float = RISK, loss: float = CONFIDENCE_LOSS) -> DataFrame:
    """``stratum, rule, cutoff``: per stratum and rule the strictest cutoff that is safe on ``holdout`` (good documents only).

    The risk is shared evenly by the rules, so a stratum loses at most ``risk`` of its good documents to all of them. A cutoff is safe if
    an exact binomial test rejects that it loses more than its share. Cutoffs are nested and tried from loose to strict,
    so each stratum and rule is one fixed sequence, and Bonferroni over strata and rules holds the chance of any unsafe
    cutoff below ``loss``. A stratum with too few documents for any bound gets no cutoff.
    """
    tried = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.expr(value).cast("double").alias("value"),
                 F.array(*[F.lit(float(c)) for c in cutoffs]).alias("cutoffs"))
        for name, (value, cutoffs) in rules.items()
    ])
    # The number of cutoffs a document passes beyond: cutoffs fall, so those are the last ones.
    beyond = holdout.select("stratum", F.explode(tried).alias("t")).select(
        "stratum", "t.rule", F.size(F.filter("t.cutoffs", lambda c: F.col("t.value") > c)).alias("lost")
    )
    counted = beyond.groupBy("stratum", "rule", "lost").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("stratum", "rule")
    grid = [(name, i, float(c), len(cutoffs)) for name, (_, cutoffs) in rules.items() for i, c in enumerate(cutoffs)]
    levels = F.inline(F.array(*[
        F.struct(F.lit(n).alias("for_rule"), F.lit(i).alias("nth"), F.lit(c).alias("cutoff"), F.lit(m).alias("many")) for n, i, c, m in grid
    ]))
    every = counted.withColumn("all", F.sum("n").over(total)).select("*", levels).where("rule = for_rule")
    # Cutoff number i (from 0, the loosest) is passed beyond by documents that pass many - i cutoffs or more.
    tested = every.groupBy("stratum", "rule", "nth", "cutoff", "all").agg(
        F.sum(F.when(F.col("lost") >= F.col("many") - F.col("nth"), F.col("n")).otherwise(0)).alias("k")
    )
    strata = max(1, holdout.select("stratum").distinct().count())
    passed = tested.withColumn("p", binomial_tail(F.col("k"), F.col("all"), risk / len(rules)))
    return passed.where(F.col("p") <= loss / (strata * len(rules))).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def joint_levels(rules: dict) -> list[dict[str, float]]:
    """Settings of all rules at once, from the loosest to the strictest: each rule goes evenly through its own cutoffs."""
    steps = max(len(cutoffs) for _, cutoffs in rules.values())
    return [{name: float(cutoffs[-(-(i + 1) * len(cutoffs) // steps) - 1]) for name, (_, cutoffs) in rules.items()} for i in range(steps)]


def _level_losses(holdout: DataFrame, rules: dict, levels: list[dict[str, float]], pool: bool) -> DataFrame:
    """``stratum, nth, all, k``: of a stratum's documents, how many setting ``nth`` rejects; with ``pool`` also of all strata, under null."""
    # The number of settings that reject a document: they are nested, so those are the last ones.
    lost = F.aggregate(
        F.array(*[F.struct(F.expr(value).cast("double").alias("value"), F.array(*[F.lit(level[name]) for level in levels]).alias("cutoffs"))
                  for name, (value, _) in rules.items()]),
        F.lit(0), lambda acc, t: F.greatest(acc, F.size(F.filter(t["cutoffs"], lambda c: t["value"] > c))),
    )
    counted = holdout.select("stratum", lost.alias("lost")).groupBy("stratum", "lost").agg(F.count(F.lit(1)).alias("n"))
    if pool:
        counted = counted.select(F.explode(F.array("stratum", F.lit(None).cast("string"))).alias("stratum"), "lost", "n")
    every = counted.withColumn("all", F.sum("n").over(Window.partitionBy("stratum"))).withColumn(
        "nth", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1)))
    )
    return every.groupBy("stratum", "nth", "all").agg(F.sum(F.when(F.col("lost") >= len(levels) - F.col("nth"), F.col("n")).otherwise(0)).alias("k"))


def _settings(chosen: DataFrame, levels: list[dict[str, float]]) -> DataFrame:
    """``stratum, rule, cutoff`` of each stratum's setting ``nth``."""
    grid = F.array(*[
        F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(cutoff).alias("cutoff")) for rule, cutoff in level.items()]) for level in levels
    ])
    return chosen.where("nth IS NOT NULL").select("stratum", F.inline(F.get(grid, F.col("nth"))))


def stepdown_cutoffs(holdout: DataFrame, rules: dict = RULES, risk: float = RISK, loss: float = CONFIDENCE_LOSS) -> DataFrame:
    """``stratum, rule, cutoff``: per stratum the strictest setting of all rules together that is proved safe for that stratum.

    A setting is safe if an exact binomial test rejects that it loses ``risk`` or more of the stratum's good documents. Settings are nested
    and tested from loose to strict for all strata at once. Within a setting Holm's step-down holds: of m strata, the i-th least
    p-value must be at most ``loss / (m - i + 1)``, and so must those before it. The next setting is tested only if every stratum passed, so
    each family of tests has the whole ``loss``, and the chance that any stratum gets an unsafe setting is at most ``loss``.

    Strata with too few documents to pass even without a single loss are left out beforehand, smallest first, by their sizes only; they
    get no cutoff, since nothing can be proved for them. One stratum alone needs 299 documents at the default parameters.
    """
    levels = joint_levels(rules)
    tested = materialise(
        _level_losses(holdout, rules, levels, pool=False).withColumn("p", binomial_tail(F.col("k"), F.col("all"), risk)), "tested"
    )
    # What a stratum would need if it lost nothing: with r - 1 smaller ones in the family it is tested at loss / r.
    by_size = Window.orderBy("all", "stratum")
    sizes = tested.where("nth = 0").select("stratum", "all", F.row_number().over(by_size).alias("r"))
    smallest = F.greatest(F.exp(F.col("all") * math.log1p(-risk)), F.lit(1e-300))
    short = (F.col("r") - F.floor(F.least(F.lit(loss) / smallest, F.lit(1e9)))).alias("short")
    worst = F.max("short").over(Window.orderBy("r").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    sizes = sizes.select("stratum", "r", short).withColumn("worst", worst)
    first = sizes.where("worst <= r - 1").agg(F.min("r").alias("first"))
    family = sizes.join(F.broadcast(first), F.col("r") >= F.col("first")).select("stratum")

    own = tested.join(family, "stratum")
    order, level = Window.partitionBy("nth").orderBy("p", "stratum"), Window.partitionBy("nth")
    holm = F.col("p") <= F.lit(loss) / (F.count(F.lit(1)).over(level) - F.row_number().over(order) + 1)
    passed = materialise(own.withColumn("holm", holm).withColumn("safe", F.bool_and("holm").over(order)), "settings")
    # The last setting that is tested is the first that some stratum fails.
    stop = passed.agg(F.coalesce(F.min(F.when(~F.col("safe"), F.col("nth"))), F.lit(len(levels))).alias("stop"))
    chosen = passed.join(F.broadcast(stop), F.col("nth") <= F.col("stop")).where("safe").groupBy("stratum").agg(F.max("nth").alias("nth"))
    return _settings(chosen, levels)


def joint_cutoffs(holdout: DataFrame, rules: dict = RULES, risk: float = RISK, loss: float = CONFIDENCE_LOSS) -> DataFrame:
    """``stratum, rule, cutoff``: per stratum the strictest setting of all rules together that is safe on ``holdout``.

    Settings are nested, so a stratum is one fixed sequence whose tests have the whole ``risk``; Bonferroni over the strata and
    the pool of all strata holds the chance of any unsafe setting below ``loss``. A stratum without a safe setting of its own
    takes the pool's, or the strictest looser one that costs at most ``risk`` of its own documents in the sample. That is no bound for
    the stratum: only the pool's loss is bounded, the stratum's is an estimate. A stratum that has no document in ``holdout`` gets no cutoff.
    """
    levels = joint_levels(rules)
    tested = _level_losses(holdout, rules, levels, pool=True)
    tests = holdout.select("stratum").distinct().count() + 1
    passed = materialise(tested.withColumn("safe", binomial_tail(F.col("k"), F.col("all"), risk) <= loss / tests), "settings")
    pool = passed.where("stratum IS NULL AND safe").agg(F.max("nth").alias("pool"))
    own = passed.where("stratum IS NOT NULL").crossJoin(F.broadcast(pool)).groupBy("stratum").agg(
        F.coalesce(F.max(F.when(F.col("safe"), F.col("nth"))), F.max(F.when((F.col("nth") <= F.col("pool")) & (F.col("k") <= risk * F.col("all")), F.col("nth")))).alias("nth")
    )
    return _settings(own, levels)


def _wide(cutoffs: DataFrame, rules: dict, prefix: str) -> DataFrame:
    wide = cutoffs.groupBy("stratum").pivot("rule", list(rules)).agg(F.min("cutoff"))
    return wide.select("stratum", *[F.col(r).alias(f"{prefix}_{r}") for r in rules])


def _beyond(rules: dict, prefix: str) -> Column:
    out = F.lit(False)
    for name, (value, _) in rules.items():
        out = out | F.coalesce(F.expr(value) > F.col(f"{prefix}_{name}"), F.lit(False))
    return out


def _stricter_cutoffs(measured: DataFrame, holdout: DataFrame, rules: dict, risk: float, loss: float) -> DataFrame:
    """Per stratum the joint or the separate cutoffs, whichever reject more documents; both are safe at once."""
    joint = materialise(_wide(joint_cutoffs(holdout, rules, risk, loss * (1 - SEPARATE_SHARE)), rules, "joint"), "joint")
    alone = materialise(_wide(risk_cutoffs(holdout, rules, risk, loss * SEPARATE_SHARE), rules, "alone"), "alone")
    both = joint.join(alone, "stratum", "full")
    rejected = measured.drop("row").where(~F.col("base_failed")).join(F.broadcast(both), "stratum").groupBy("stratum").agg(
        *[F.count(F.when(_beyond(rules, p), 1)).alias(p) for p in ("joint", "alone")]
    )
    return both.join(rejected, "stratum").select(
        "stratum", *[F.when(F.col("joint") >= F.col("alone"), F.col(f"joint_{r}")).otherwise(F.col(f"alone_{r}")).alias(f"cutoff_{r}") for r in rules]
    )


def _judged(
    docs: DataFrame, labels: DataFrame, doc_id: str, text: str, stratum: str | None, rules: dict, risk: float, loss: float, joint: bool,
    whole_rows: bool,
) -> DataFrame:
    measured = materialise(text_measures(docs, doc_id, text, stratum, whole_rows), "measures")
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality")
    ).where("quality = 1").select("doc_id")
    holdout = measured.drop("row").where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    if joint:
        wide = materialise(_stricter_cutoffs(measured, holdout, rules, risk, loss), "cutoffs")
    else:
        wide = _wide(materialise(stepdown_cutoffs(holdout, rules, risk, loss), "cutoffs"), rules, "cutoff")
    judged = measured.join(wide, "stratum", "left")
    beyond = _beyond(rules, "cutoff")
    return judged.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(~beyond))


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str | None = "lang",
    rules: dict = RULES, risk: float = RISK, loss: float = CONFIDENCE_LOSS, joint: bool = False,
) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` per row.

    base_failed: under 50 words, or over half of them in three-word windows that occur twice or more. ``kept`` is false if
    base_failed, or if a rule's value is beyond its cutoff in the document's stratum: see ``stepdown_cutoffs``, whose bound holds for each
    stratum. With ``joint`` small strata borrow cutoffs (``joint_cutoffs``), or separate cutoffs are taken where they reject more. Cutoffs are chosen on all labelled documents with quality 1 that pass the base rules. A document labelled more than once is good if
    all its labels say so; null labels and ids say nothing.

    Null, empty and blank texts have no words and fail the base rules. A null stratum is one with the empty name. Rows that repeat a
    doc_id are judged each for itself. Without labels nothing beyond the base rules is rejected. Other columns are not read.
    """
    return _judged(docs, labels, doc_id, text, stratum, rules, risk, loss, joint, whole_rows=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def quality_filter(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str | None = "lang",
    rules: dict = RULES, risk: float = RISK, loss: float = CONFIDENCE_LOSS, joint: bool = False,
) -> DataFrame:
    """The rows of ``docs`` that ``quality_verdicts`` keeps, with all their columns."""
    judged = _judged(docs, labels, doc_id, text, stratum, rules, risk, loss, joint, whole_rows=True)
    return judged.where("kept").select("row.*")
