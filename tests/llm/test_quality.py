"""Rules, language identification and importance resampling."""

from __future__ import annotations

import math
import random
import zlib

import brute
import corpus_pipeline
import numpy as np
import pytest
from made import frame, odd_rows, prose
from pyspark.sql import functions as F

from timetab.llm.importance import bucket_counts, features, importance_sample, log_ratios
from timetab.llm.language_id import CrossParser, identify_languages, phrases, suffix_automaton
from timetab.llm.quality_rules import (
    PLACE_BITS, _stricter_cutoffs, binomial_tail, joint_cutoffs, joint_levels, quality_filter, quality_verdicts, repeated_words, risk_cutoffs,
    stepdown_cutoffs,
)

LABELS = "doc_id long, quality int, toxic int"


def test_measures(spark):
    rows = [*odd_rows(), (500, "a#b $$ |x|\na#b $$ |x|\n\n \na#b $$ |x|"), (501, "a b c a b c a b"), (502, "x x x x"), (503, "p q")]
    got = quality_verdicts(frame(spark, rows), spark.createDataFrame([], LABELS)).collect()
    want = []
    for d, t in rows:
        w = brute.words(t)
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        again = brute.repeated_words(w)
        failed = len(w) < 50 or 100 * again > 50 * len(w)
        symbols = sum(c in "#*$%&|<>" for c in t or "")
        want.append((d, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), again, failed, not failed))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_repeats_of_many_words(spark):
    """Past the room for packed places the structs give the same."""
    n = (1 << PLACE_BITS) + 10
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i % (n - 5)).cast("string")).alias("w"))
    assert df.select(repeated_words(F.col("w"))).first()[0] == 2 * 5


def test_binomial_tail(spark):
    cases = [(k, n) for n in (1, 10, 300, 5000) for k in (0, 1, 3, 40) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", binomial_tail(F.col("k"), F.col("n"), 0.01))
    for k, n, p in df.collect():
        want = sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)) if k < n * 0.01 else 1.0
        assert p == pytest.approx(want, rel=1e-9)


def test_cutoffs(spark):
    """The strictest cutoff whose loss is proved small; none where documents are too few."""
    rules = {"r": ("v", [0.9, 0.5, 0.2, 0.1])}
    rows = [("a", 0.15 if i < 20 else 0.05) for i in range(20_000)] + [("b", 0.0)] * 50 + [("a", 0.3)]
    got = risk_cutoffs(spark.createDataFrame(rows, "stratum string, v double"), rules, risk=0.001).collect()
    assert [tuple(r) for r in got] == [("a", "r", 0.2)]
    strict = risk_cutoffs(spark.createDataFrame(rows, "stratum string, v double"), rules, risk=0.01).collect()
    assert [tuple(r) for r in strict] == [("a", "r", 0.1)]


def test_false_rejections_stay_in_bounds(spark):
    r = random.Random(5)
    clean = [(i, prose(i, 60 + r.randrange(60), 3000)) for i in range(1500)]
    junk = [(5000 + i, " ".join("###" if r.random() < 0.5 else f"w{r.randrange(3000)}" for _ in range(80))) for i in range(50)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean[:1200]] + [(i, 0, 0) for i, _ in junk] + [(None, 1, 0), (1, None, 0), (2, 1, 0)], LABELS)
    out = {x["doc_id"]: x["kept"] for x in quality_verdicts(frame(spark, clean + junk), labels, risk=0.05).collect()}
    assert sum(not out[i] for i, _ in clean) <= 0.05 * len(clean)
    assert not any(out[i] for i, _ in junk)
    kept = quality_filter(frame(spark, clean + junk), labels, risk=0.05)
    assert {x["doc_id"] for x in kept.collect()} == {i for i, k in out.items() if k} and kept.columns == frame(spark, []).columns


def test_joint_cutoffs(spark):
    """A stratum's own sequence has the whole risk; a small one takes the pool's setting if its own documents allow it."""
    rules = {"r": ("v", [0.9, 0.5, 0.2, 0.1]), "q": ("w", [0.8, 0.4])}
    assert joint_levels(rules) == [{"r": 0.9, "q": 0.8}, {"r": 0.5, "q": 0.8}, {"r": 0.2, "q": 0.4}, {"r": 0.1, "q": 0.4}]
    # 4 strata and the pool: 459 documents without a loss are enough at one percent, 458 are not.
    assert 0.99**459 <= 0.05 / 5 < 0.99**458
    rows = [("a", 0.15, 0.0)] * 459 + [("b", 0.0, 0.0)] * 200 + [("c", 0.0, 0.5)] * 50 + [("d", 0.0, 0.0)] * 5000 + [("d", 0.15, 0.0)] * 10
    got = {}
    for s, rule, cutoff in joint_cutoffs(spark.createDataFrame(rows, "stratum string, v double, w double"), rules).collect():
        got.setdefault(s, {})[rule] = cutoff
    # The pool loses 50 of 5719 at (0.2, 0.4), too many to be proved, so it stops at (0.5, 0.8).
    assert got == {"a": {"r": 0.2, "q": 0.4}, "b": {"r": 0.5, "q": 0.8}, "c": {"r": 0.5, "q": 0.8}, "d": {"r": 0.1, "q": 0.4}}
    short = spark.createDataFrame([("a", 0.0, 0.0)] * 300, "stratum string, v double, w double")
    assert joint_cutoffs(short, rules).count() == 0


def test_joint_setting_spares_a_small_stratum(spark):
    """The pool's setting is loosened for a stratum that would lose its own good documents, and not used where none is labelled."""
    rules = {"r": ("v", [0.9, 0.5, 0.2, 0.1])}
    rows = [("a", 0.0)] * 5000 + [("b", 0.3)] * 20 + [("c", 0.95)] * 5
    got = joint_cutoffs(spark.createDataFrame(rows, "stratum string, v double"), rules).collect()
    assert sorted(map(tuple, got)) == [("a", "r", 0.1), ("b", "r", 0.5)]


def test_pipeline_rules_act_on_few_labels(spark, tmp_path):
    """With the production parameters, languages of some 500 labelled documents and a smaller one lose their junk."""
    sizes = {"en": 480, "fr": 480, "de": 480, "es": 120}
    good = [(1000 * j + i, prose(1000 * j + i, 60, 3000), lang) for j, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    junk = [(9000 + i, " ".join("###" if k % 3 == 0 else f"w{(7 * i + k) % 3000}" for k in range(80)), lang) for i, lang in enumerate([*sizes, "xx"] * 5)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    spark.createDataFrame([(d, 1, 0) for d, *_ in good] + [(d, 0, 0) for d, *_ in junk], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.rules(spark, docs, str(tmp_path)).collect()}
    # No document of the language "xx" is labelled good, so nothing is known of it.
    assert kept == {d for d, *_ in good} | {d for d, _, lang in junk if lang == "xx"}


def brute_stepdown(rows, levels, risk, loss):
    """rows: (stratum, lost), lost being the number of levels that reject the document."""
    def tail(k, n):
        return 1.0 if k >= n * risk else sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))

    size = {s: sum(x == s for x, _ in rows) for s in {s for s, _ in rows}}
    family = sorted(size, key=lambda s: (size[s], s))
    while family and any((1 - risk) ** size[s] > loss / r for r, s in enumerate(family, 1)):
        family.pop(0)
    chosen = {}
    for nth in range(levels):
        ps = sorted((tail(sum(x == s and lost >= levels - nth for x, lost in rows), size[s]), s) for s in family)
        done = True
        for i, (p, s) in enumerate(ps):
            done = done and p <= loss / (len(ps) - i)
            if done:
                chosen[s] = nth
        if not done:
            break
    return chosen


def test_stepdown_cutoffs(spark):
    """Holm within a setting, one setting after the other, and no stratum that cannot be proved safe."""
    rules = {"r": ("v", [0.9, 0.5, 0.2, 0.1])}
    value = [0.0, 0.15, 0.3, 0.7, 0.95]  # of a document that the last 0, 1, .. settings reject
    r = random.Random(8)
    cases = [
        [("a", 0)] * 299, [("a", 0)] * 298, [("a", 0)] * 299 + [("b", 0)] * 299, [("a", 0)] * 299 + [("b", 0)] * 400 + [("c", 0)] * 20,
        [("a", 0)] * 5000 + [("a", 1)] * 10 + [("b", 0)] * 600 + [("b", 2)] * 2, [("a", 4)] * 400 + [("b", 0)] * 900,
    ]
    cases += [[(s, r.choice([0] * 300 + [1, 2, 3, 4])) for s, n in zip("abcd", [r.randint(200, 2000) for _ in range(4)]) for _ in range(n)] for _ in range(3)]
    for rows in cases:
        holdout = spark.createDataFrame([(s, value[lost]) for s, lost in rows], "stratum string, v double")
        got = {x["stratum"]: x["cutoff"] for x in stepdown_cutoffs(holdout, rules).collect()}
        assert got == {s: rules["r"][1][nth] for s, nth in brute_stepdown(rows, 4, 0.01, 0.05).items()}
    # Sizes alone decide who takes part: the smallest goes until all could pass.
    assert brute_stepdown(cases[1], 4, 0.01, 0.05) == {} and brute_stepdown(cases[2], 4, 0.01, 0.05) == {"b": 3}


def test_verdicts_of_the_query_act(spark):
    """With the production parameters, languages of some hundred labelled documents lose their junk; where nothing is proved, none goes."""
    sizes = {"en": 480, "fr": 480, "de": 400, "es": 310, "it": 120}
    good = [(1000 * j + i, prose(1000 * j + i, 60, 3000), lang) for j, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    junk = [(9000 + i, " ".join("###" if k % 3 == 0 else f"w{(7 * i + k) % 3000}" for k in range(80)), lang) for i, lang in enumerate([*sizes, "xx"] * 5)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1, 0) for d, *_ in good] + [(d, 0, 0) for d, *_ in junk], LABELS)
    lost = {r["doc_id"] for r in quality_verdicts(docs, labels).collect() if not r["kept"]}
    assert lost == {d for d, _, lang in junk if lang in ("en", "fr", "de", "es")}


def test_joint_or_separate(spark):
    """A stratum that the separate sequences serve better keeps their cutoffs."""
    rules = {"r": ("v", [0.9, 0.1]), "q": ("w", [0.8, 0.4])}
    good = [("a", 0.0, 0.5)] * 9000
    measured = spark.createDataFrame([*good, *[("a", 0.3, 0.0)] * 40], "stratum string, v double, w double").withColumn("base_failed", F.lit(False))
    holdout = spark.createDataFrame(good, "stratum string, v double, w double")
    assert {tuple(r) for r in joint_cutoffs(holdout, rules).collect()} == {("a", "r", 0.9), ("a", "q", 0.8)}
    assert [tuple(r) for r in _stricter_cutoffs(measured, holdout, rules, 0.01, 0.05).collect()] == [("a", 0.1, 0.8)]


def test_automaton():
    text = " the cat sat on the mat "
    moves = suffix_automaton(text)

    def holds(s):
        state = 0
        for c in s:
            state = moves[state].get(c)
            if state is None:
                return False
        return True

    parts = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    assert all(holds(s) for s in parts)
    r = random.Random(1)
    for _ in range(500):
        s = "".join(r.choice("thecasmon ") for _ in range(r.randint(1, 5)))
        assert holds(s) == (s in parts)

    def parsed(word):
        n = 0
        while word:
            k = max([k for k in range(1, len(word) + 1) if word[:k] in parts], default=1)
            word, n = word[k:], n + 1
        return n

    for w in (" cat ", " mats ", " zzz ", " theatz ", "x", " ", "q t"):
        assert phrases(moves, w) == parsed(w), w


def test_rare_words_of_many_languages():
    """Every word handed over is learned whole, however many languages there are."""
    r = random.Random(3)
    learned = {f"l{i:03}": sorted({"".join(r.choices("abcdefghijklmnop", k=8)) for _ in range(600)}) for i in range(256)}
    parser = CrossParser(learned)
    assert all(phrases(a, f" {words[-1]} ") == 1 for a, words in zip(parser.automata, learned.values()))


def test_parser_bounds(monkeypatch):
    import timetab.llm.language_id as L

    learned = {"a": ["alpha", "beta", "gamma"], "b": ["uno", "dos", "tres"]}
    text = " ".join(random.Random(2).choice(["Alpha,", "beta", "dos!", "x1", "9"]) for _ in range(500))
    whole = CrossParser(learned).totals(text)
    monkeypatch.setattr(L, "CACHE", 4)
    monkeypatch.setattr(L, "SLICE", 3)
    assert (CrossParser(learned).totals(text) == whole).all()


def test_language(spark, documents):
    held = F.crc32(F.col("doc_id").cast("string")) % 3
    got = identify_languages(documents, held != 1, F.xxhash64("doc_id")).collect()
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    apart = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(got) == len(truth)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in apart) >= 0.95 * len(apart)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "123 --", "fr"), (5, "", None), (None, "the dog", None),
            (6, "le chien", None), (6, "the cat", "fr"), (7, "LE CHAT!", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r)[:2] for r in identify_languages(df, F.col("doc_id") < 3, F.xxhash64("doc_id")).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (6, "fr"), (6, "en"), (7, "fr")], key=str)
    nothing = identify_languages(df, F.lit(False), F.xxhash64("doc_id")).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert identify_languages(df.limit(0), F.lit(True), F.xxhash64("doc_id")).count() == 0


def test_importance(spark):
    r = random.Random(4)
    good = [(i, prose(i, 80, 500)) for i in range(300)]
    bad = [(1000 + i, " ".join(f"z{r.randrange(500)}" for _ in range(80))) for i in range(100)]
    rows = good + bad + [(2000, None), (2001, " "), (None, prose(1, 30)), (1, prose(1, 80, 500))]
    df = frame(spark, rows)
    ids = spark.createDataFrame([(i,) for i in range(0, 300, 3)] + [(None,), (0,)], "doc_id long")
    out = importance_sample(df, ids, share=0.75, buckets=4096).collect()
    assert len(out) == len(rows) and sum(x["kept"] for x in out) == int(0.75 * len(rows))
    # The counts and weights are those of a plain computation.
    target, raw = np.zeros(4096), np.zeros(4096)
    for d, t in rows:
        f = np.bincount(features(None if t is None else t.encode(), 4096), minlength=4096)
        raw += f
        if d is not None and d < 300 and d % 3 == 0:
            target += f
    ratio = log_ratios(target, raw)
    want = {d: 100 * ratio[f].sum() / len(f) if len(f := features(None if t is None else t.encode(), 4096)) else 0 for d, t in rows if d != 1}
    assert all(x["log_weight"] == pytest.approx(want[x["doc_id"]]) for x in out if x["doc_id"] in want)
    lost = [x["doc_id"] for x in out if not x["kept"]]
    assert sum(1000 <= d < 2000 for d in lost if d is not None) >= 90
    again = importance_sample(df, ids, share=0.75, buckets=4096).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_importance_edges(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert importance_sample(frame(spark, []), none).count() == 0
    out = importance_sample(frame(spark, [(i, "a b") for i in range(10)]), none, share=0.5).collect()
    assert sum(x["kept"] for x in out) == 5 and {x["log_weight"] for x in out} == {0.0}
    assert bucket_counts(frame(spark, [(1, None)]).selectExpr("cast(text as binary)"), 64).sum() == 0
