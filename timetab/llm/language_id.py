"""Language identification by cross-parsing: the language whose labelled text parses a document in the fewest phrases wins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCUMENTS = 1000
SAMPLE_WORDS = 4000
LANGUAGES = 256
CACHE = 200_000
SLICE = 100_000
_LETTERS = regex.compile(r"\p{L}+")


def sampled_words(
    labelled: DataFrame, lang: str, text: str, order: Column, documents: int = SAMPLE_DOCUMENTS, words: int = SAMPLE_WORDS,
    languages: int = LANGUAGES,
) -> dict[str, list[str]]:
    """The most frequent words per language in a bounded sample: ``documents`` rows per language, first in ``order`` (a long).

    ``order`` must spread evenly over all longs. At most ``languages`` languages (the most frequent) and ``words`` words
    of each reach the driver.
    """
    sizes = labelled.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "lang"
    ).limit(languages)
    # Twice the wanted share by hash first, so that the ranking below sees a bounded number of rows.
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), order.alias("place")).join(
        F.broadcast(sizes), "lang"
    ).where((F.col("place") / F.lit(2.0**64) + 0.5) * F.col("n") <= F.lit(2.0 * documents + 50))
    nearest = Window.partitionBy("lang").orderBy("place")
    sample = rows.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= documents)
    spoken = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counted = spoken.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counted.withColumn("nth", F.row_number().over(rank)).where(F.col("nth") <= words)
    learned: dict[str, list[str]] = {r["lang"]: [] for r in sizes.collect()}
    for r in top.orderBy("lang", "nth").select("lang", "word").collect():
        learned[r["lang"]].append(r["word"])
    return {k: v for k, v in sorted(learned.items()) if v}


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the automaton that accepts just the substrings of ``text``; state 0 is the empty string."""
    moves: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


def phrases(moves: list[dict[str, int]], word: str) -> int:
    """Into how many longest matches the word falls; a letter without any match is a phrase too."""
    count, state = 0, 0  # in state 0 no phrase is open
    for c in word:
        onward = moves[state].get(c)
        if onward is None:
            count += state != 0
            onward = moves[0].get(c)
            if onward is None:
                count += 1
                onward = 0
        state = onward
    return count + (state != 0)


class CrossParser:
    """Phrases of a text per language, by words; what it has seen of words is kept up to a bound."""

    def __init__(self, learned: dict[str, list[str]]):
        self.names = list(learned)
        self.automata = [suffix_automaton(" " + " ".join(words) + " ") for words in learned.values()]
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[str, int] = {}
        self.table = np.zeros((CACHE, len(self.names) + 1), dtype=np.int64)

    def _chunk(self, chunk: str) -> int:
        row = len(self.chunks)
        total = [0] * (len(self.names) + 1)
        for word in _LETTERS.findall(chunk.lower()):
            known = self.words.get(word)
            if known is None:
                if len(self.words) >= CACHE:
                    self.words.clear()
                known = self.words[word] = [*(phrases(a, f" {word} ") for a in self.automata), len(word)]
            total = [a + b for a, b in zip(total, known)]
        self.table[row] = total
        self.chunks[chunk] = row
        return row

    def totals(self, text: str) -> np.ndarray:
        """Phrases per language, then letters."""
        out, parts = np.zeros(len(self.names) + 1, dtype=np.int64), text.split()
        for start in range(0, len(parts), SLICE):
            part = parts[start : start + SLICE]
            if len(self.chunks) + len(part) > CACHE:
                missing = set(part) - self.chunks.keys()
                if len(self.chunks) + len(missing) > CACHE:
                    self.chunks.clear()
            get = self.chunks.get
            rows = [row if (row := get(c)) is not None else self._chunk(c) for c in part]
            out += self.table[np.array(rows, dtype=np.int64)].sum(axis=0)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and how much fewer phrases it needs than the second, as a share; ``und`` for no letters."""
        if not text or not self.names:
            return "und", 0.0
        *counts, letters = self.totals(text).tolist()
        if not letters:
            return "und", 0.0
        order = sorted(range(len(counts)), key=lambda i: (counts[i], self.names[i]))
        if len(order) == 1:
            return self.names[0], 1.0
        best, second = counts[order[0]], counts[order[1]]
        return self.names[order[0]], 1.0 - best / second


_PARSERS: dict[str, CrossParser] = {}


def identify_languages(
    docs: DataFrame, learn_from: Column, order: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    documents: int = SAMPLE_DOCUMENTS, words: int = SAMPLE_WORDS, languages: int = LANGUAGES,
) -> DataFrame:
    """``doc_id, lang_pred, score`` per row: the language whose sampled words parse the text in the fewest phrases.

    Learned from rows where ``learn_from`` is true and lang is not null: a sample of ``documents`` rows per language (first
    in ``order``), of whose words the ``words`` most frequent make up the language's text, at most ``languages`` languages.
    Predictions read the text only, all of it. A phrase is the longest match in the language's suffix automaton, which
    holds whole words between blanks; letters are compared in lower case and phrases end with the word. As the letters are the
    same for all languages, fewest phrases are fewest per letter. Ties go to the first name. score is 0 to 1: one less the
    ratio of phrases to those of the second language. Null texts, texts without a letter, and all texts if nothing was
    learned are ``und`` with score 0. Rows that repeat a doc_id are predicted each for itself. Only the columns named are read.
    """
    spark = docs.sparkSession
    learned = spark.sparkContext.broadcast(
        sampled_words(docs.where(learn_from), lang, text, order, documents, words, languages)
    )  # at most languages x words entries
    name = uuid.uuid4().hex  # of this model in the workers

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = _PARSERS.get(name)
        if parser is None:
            _PARSERS.clear()
            parser = _PARSERS[name] = CrossParser(learned.value)
        for pdf in batches:
            got = [parser.predict(t) for t in pdf.pop("text")]
            pdf["lang_pred"] = [g[0] for g in got]
            pdf["score"] = [g[1] for g in got]
            yield pdf.astype({"doc_id": "Int64"})

    taken = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return taken.mapInPandas(predict, "doc_id long, lang_pred string, score double")
