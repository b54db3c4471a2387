"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.stage import Stage

SCORES = "doc_id long, score double, predicted int, n_matches long, n_words long"

# Letters that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ʟ": "l", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
HIDDEN = "­​‌‍⁠﻿"
_BETWEEN = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")


class _Folds(dict):
    """For str.translate: what a character becomes; anything but letters and digits a space."""

    def __init__(self):
        super().__init__({ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()} | {ord(c): None for c in HIDDEN})

    def __missing__(self, c: int):
        self[c] = out = chr(c) if chr(c).isalpha() or unicodedata.combining(chr(c)) else " "
        return out


_FOLDS = _Folds()


def fold(text: str | None) -> str:
    """Lower case, homoglyphs and digits as the letters they stand for, words between single spaces.

    A sign counts as a letter only between two letters, so that ornaments at a word's end go.
    """
    text = unicodedata.normalize("NFKC", text or "").lower() if text and not text.isascii() else (text or "").lower()
    text = _BETWEEN.sub(lambda m: SIGNS[m[0]], text)
    return f" {' '.join(text.translate(_FOLDS).split())} "


@dataclass(frozen=True)
class Lexicon:
    """Weights of patterns (``" word "`` or the beginning ``" wor"`` of words) and the fitted scale."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    scale: tuple[float, float, float] = (-2.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            found.add_word(pattern, (pattern, weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (f" {phrase} ", None))
        if self.weights or self.exceptions:
            found.make_automaton()
        return found

    def score(self, total: float, words: int) -> float:
        a, b, c = self.scale
        x = a + b * math.log1p(total) + c * total / max(words, 10)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def found_in(automaton, folded: str) -> tuple[dict[int, tuple[str, float]], list[tuple[int, int]]]:
    """The heaviest pattern that begins at each place, and the places that exception phrases cover, merged and in order."""
    best: dict[int, tuple[str, float]] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for end, (pattern, weight) in automaton.iter(folded):
            start = end - len(pattern) + 1
            if weight is None:
                spared.append((start, end))
            elif start not in best or weight > best[start][1]:
                best[start] = (pattern, weight)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spared):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return best, merged


def _harmless(at: int, spared: list[tuple[int, int]]) -> bool:
    i = bisect_right(spared, (at, math.inf)) - 1
    return i >= 0 and at < spared[i][1]


def matches(automaton, folded: str) -> tuple[float, int]:
    """Sum of the weights, the heaviest for each word, without those inside an exception; and their number."""
    best, spared = found_in(automaton, folded)
    kept = [w for at, (_, w) in best.items() if not _harmless(at, spared)]
    return sum(kept), len(kept)


def _patterns(folded: str, shortest: int, longest: int) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in range(shortest, min(longest, len(w)) + 1)}


def _phrases(automaton, folded: str) -> set[str]:
    """Matched words together with the word before and with the word behind: what may be an exception."""
    out = set()
    for at in found_in(automaton, folded)[0]:
        to = folded.find(" ", at + 1)
        if at > 0:
            out.add(folded[folded.rfind(" ", 0, at) + 1 : to])
        if to < len(folded) - 1:
            out.add(folded[at + 1 : folded.find(" ", to + 1)])
    return out


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int, most: int) -> dict[str, float]:
    """Patterns by how surely they mark toxic texts, leaving out what a chosen beginning already covers."""
    rated = []
    for pattern, t, n in counts:
        odds = math.log((t + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))
        rated.append((odds / math.sqrt(1 / (t + 0.5) + 1 / (n + 0.5)), len(pattern), pattern, odds))
    chosen: dict[str, float] = {}
    for sure, _, pattern, odds in sorted(rated, reverse=True):
        if len(chosen) >= most or sure < 2.3:
            break
        if odds > 2.5 and not any(pattern[:k] in chosen for k in range(2, len(pattern))):
            chosen[pattern] = odds
    return chosen


def fit_scale(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, stage: Stage, most_docs: int = 20_000, most_patterns: int = 2_000, most_candidates: int = 20_000, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn the lexicon from labelled rows (doc_id, toxic) whose crc32(doc_id) mod 5 isn't 0.

    Bounds, which limit the size of the model and never what is scored: ``most_docs`` labelled
    rows are read, the first by a hash of doc_id; of the patterns that are common enough and at
    least 8 times as frequent in toxic texts, the ``most_candidates`` of the highest ratio are
    rated, and the ``most_patterns`` surest become the lexicon. Patterns are whole words of any
    length and beginnings of 4 to 8 letters; each distinct text counts once, so a copied text
    doesn't count as evidence many times.

    Exceptions are learned too: a matched word and a neighbour of it are one when at least three
    clean texts have them and toxic texts no more than an eighth as often; ``exceptions`` adds
    phrases to those. Rows without a label or text are left out. Without any toxic row the lexicon
    is empty.
    """
    known = labels.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id").groupBy(F.md5("text").alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = stage.save(rows, "labelled")
    size = {r.toxic: r.n for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(True, 0), size.get(False, 0)
    if not toxic:
        return Lexicon({}, exceptions)
    least = max(3, toxic // 250)
    counted = _counted(rows, lambda: lambda folded: _patterns(folded, 4, 8))
    strong = counted.filter((F.col("t") >= least) & (F.col("t") * (clean + 1) > 8 * F.col("n") * (toxic + 1)))
    top = strong.orderBy(F.desc(F.col("t") / (F.col("n") + 1)), "pattern").limit(most_candidates).collect()
    lexicon = Lexicon(choose([(r.pattern, r.t, r.n) for r in top], toxic, clean, most_patterns), exceptions)

    def around() -> Callable[[str], set[str]]:
        automaton = lexicon.automaton()
        return lambda folded: _phrases(automaton, folded)

    mild = _counted(rows, around).filter((F.col("n") >= 3) & (F.col("n") * (toxic + 1) > 8 * F.col("t") * (clean + 1)))
    learned = [r.pattern for r in mild.orderBy(F.desc("n"), "pattern").limit(most_patterns).collect()]
    lexicon = Lexicon(lexicon.weights, (*exceptions, *learned))
    marks = _matched(rows.select(F.col("toxic").cast("long").alias("doc_id"), "text"), lexicon, raw=True).select("doc_id", "score", "n_words").toPandas()
    total, words = marks["score"].to_numpy(), np.maximum(marks["n_words"].to_numpy(), 10)
    x = np.stack([np.ones(len(marks)), np.log1p(total), total / words], 1)
    return Lexicon(lexicon.weights, lexicon.exceptions, tuple(fit_scale(x, (marks["doc_id"] > 0).to_numpy(float)).tolist()))


def _counted(rows: DataFrame, make: Callable[[], Callable[[str], set[str]]]) -> DataFrame:
    """How many toxic (t) and clean (n) texts have each pattern, with partial counts in the tasks; ``make`` runs once in each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, patterns = (Counter(), Counter()), make()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[1 if toxic else 0].update(patterns(fold(text)))
        # a pattern of which this task saw nothing in a toxic text can still count against it
        names = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"pattern": part, "t": [seen[1][p] for p in part], "n": [seen[0][p] for p in part]})

    return rows.select("text", "toxic").mapInArrow(count, "pattern string, t long, n long").groupBy("pattern").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))


def _matched(docs: DataFrame, lexicon: Lexicon, raw: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, texts = (batch.column(c).slice(at, 256) for c in ("doc_id", "text"))
                score, predicted, hits, count = [], [], [], []
                for text in texts.to_pylist():
                    folded = fold(text)
                    total, n = matches(automaton, folded)
                    words = folded.count(" ") - 1
                    score.append(total if raw else lexicon.score(total, words))
                    predicted.append(int(score[-1] >= 0.5))
                    hits.append(n)
                    count.append(words)
                yield pa.RecordBatch.from_arrays([keys, pa.array(score, pa.float64()), pa.array(predicted, pa.int32()), pa.array(hits, pa.int64()), pa.array(count, pa.int64())], [c.split()[0] for c in SCORES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCORES)


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs``, all columns, without the documents whose score is 0.5 or more; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 256):
                for text in batch.column("text").slice(at, 256).to_pylist():
                    folded = fold(text)
                    keep.append(lexicon.score(matches(automaton, folded)[0], folded.count(" ") - 1) < 0.5)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Toxicity of each document from its whole text: score (0 to 1), predicted, n_matches, n_words.

    The sum of the weights of matched words goes into a logistic scale together with its share of
    the words. Null and empty texts have no match and the score of that. Rows stay as they are,
    repeated or with a null doc_id, and nothing is shuffled.
    """
    return _matched(docs, lexicon)
