"""The stages of the pipeline, each held against a plain version on its own input."""

from __future__ import annotations

import corpus_pipeline
import brute
import pytest
from made import SF_DIR
from test_tokens import check_packing

from timetab.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) of each stage."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = materialise(stage(spark, docs, SF_DIR), "stage")
        out[name] = (docs, result)
        docs = result
    return out


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.dtypes == before.dtypes, name
        assert 0 < after.count() <= before.count()


def test_rules(stages):
    before, after = (rows(x) for x in stages["quality rules"])
    kept = set(after)
    assert kept <= set(before)
    for r in before:
        w = brute.words(r[1])
        if len(w) < 50 or 100 * brute.repeated_words(w) > 50 * len(w):
            assert r not in kept
    assert len(before) - len(after) <= sum(len(brute.words(r[1])) < 50 or 100 * brute.repeated_words(brute.words(r[1])) > 50 * len(brute.words(r[1])) for r in before) + len(before) // 20


def test_exact(stages):
    before, after = (rows(x) for x in stages["exact dedup"])
    best = {}
    for r in before:
        key = (r[1] or "").translate(brute.UPPER)
        best[key] = max(best.get(key, r), r)
    assert after == sorted(best.values())


def test_near(stages):
    before, after = (rows(x) for x in stages["n-gram Jaccard join"])
    groups = {}
    for r, (_, n, c) in zip(before, brute.components([(r[0], r[1]) for r in before])):
        groups.setdefault(c if n else ("alone", r[0]), []).append(r)
    assert after == sorted(min(g) for g in groups.values())


def test_passages(stages):
    before, after = (rows(x) for x in stages["substring dedup"])
    want = []
    for r, (_, n, lost, kept) in zip(before, brute.stripped_words([(r[0], r[1]) for r in before])):
        if lost == 0:
            want.append(r)
        elif lost < n:
            want.append((r[0], kept, r[2], r[3], len(kept)))
    assert after == sorted(want)


def test_packing(stages):
    before, after = stages["best-fit packing"]
    check_packing([(r["doc_id"], r["text"]) for r in before.collect()], after.collect(), 4096)


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF_DIR).count() == stages["best-fit packing"][1].count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_documents(spark):
    """Nulls, empty and repeated rows, and a column that is named like the stages' own, pass through all stages."""
    text = " ".join(f"w{i}" for i in range(120))
    data = [(None, None, "en", "s", None, 1), (1, text, None, "s", 5, 2), (1, text, "en", None, 5, 3), (2, "", "en", "s", 0, 4), (None, text.upper(), "en", "s", 5, 5),
            (3, " ".join(f"v{i}" for i in range(99)), "en", "s", 7, 6)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, row_key int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF_DIR), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row_key"], name
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 3]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF_DIR)
        assert empty.count() == 0
