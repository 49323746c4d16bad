"""Language identification by rank-order profiles.

Texts are lower-cased; every run of letters, with a blank on either side, gives its character
n-grams of 1 to 3.  A language's profile is its PROFILE most frequent n-grams over all training
documents, in rank order; a document's profile likewise.  The out-of-place distance adds up, over
the document's n-grams, how far each one's rank is from its rank in the language's profile, or
PROFILE if it isn't there.  The language with the smallest distance is predicted.

Counting is exact: three code points of 21 bits fit a 64-bit key.  Counts are added up per task
and language before the shuffle, and only profiles, PROFILE rows for each of at most LANGUAGES
languages, reach the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, ship

PROFILE = 300
FLUSH = 400_000
CHARS = 500_000
LANGUAGES = 5_000
BLANK = 0x20
_BITS = np.int64(21)


@functools.cache
def _letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _runs(text: str) -> np.ndarray:
    """The code points of the text's letter runs, lower-cased, with one blank on either side of each."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters = _letter_table()[codes]
    if not letters.any():
        return np.empty(0, np.uint32)
    # Everything else becomes one blank between runs, and one at each end.
    padded = np.full(len(codes) + 2, BLANK, np.uint32)
    padded[1:-1] = np.where(letters, codes, np.uint32(BLANK))
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != BLANK) | (padded[:-1] != BLANK)
    return padded[keep]


def _keys(runs: np.ndarray, first: int, last: int) -> np.ndarray:
    """The keys of the n-grams that begin at places first..last of the runs."""
    c = runs[first : last + 2].astype(np.int64)
    own = min(last, len(runs)) - first
    inner = c != BLANK
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    middle = inner[1:-1]
    return np.concatenate([c[:own][inner[:own]], two[:own], three[:own][middle[:own]]])


def gram_keys(text: str) -> np.ndarray:
    """The keys of all n-grams of the text's padded letter runs, unsorted; empty if it has no letter."""
    runs = _runs(text)
    return _keys(runs, 0, len(runs)) if len(runs) else np.empty(0, np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each is there; a long text is counted CHARS places at a time."""
    runs = _runs(text)
    if len(runs) <= CHARS:
        return np.unique(_keys(runs, 0, len(runs)) if len(runs) else np.empty(0, np.int64), return_counts=True)
    total: list[tuple[np.ndarray, np.ndarray]] = []
    for first in range(0, len(runs), CHARS):
        total = [_sum_up([*total, np.unique(_keys(runs, first, first + CHARS), return_counts=True)])]
    return total[0]


def _ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The keys by descending count, equal counts by ascending key, at most ``size``."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        keys, counts = keys[some], counts[some]
    return keys[np.lexsort((keys, -counts))][:size]


def _sum_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, counts).astype(np.int64)


def _counts_of(lang: str, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, gram, n).  What a task holds is bounded: keys beyond FLUSH in all go out, those
    of the language that holds most first."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    pending: dict[str, list[str]] = {}
    waiting = 0

    def count() -> None:
        nonlocal waiting
        for lang, texts in pending.items():
            # A letter run never crosses the space between two texts.
            made = gram_counts(" ".join(texts))
            held[lang] = _sum_up([held[lang], made]) if lang in held else made
        pending.clear()
        waiting = 0

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            text = text.as_py()
            pending.setdefault(lang, []).append(text)
            waiting += len(text)
            if waiting > CHARS:
                count()
                while sum(len(k) for k, _ in held.values()) > FLUSH:
                    most = max(held, key=lambda x: len(held[x][0]))
                    yield _counts_of(most, *held.pop(most))
    count()
    for lang, counts in held.items():
        yield _counts_of(lang, *counts)


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles by language from the rows of ``docs`` (text, lang) whose two columns aren't null.

    What comes to the driver is at most ``size`` keys for each distinct language; more than LANGUAGES of
    those are an error, since that column then holds something else.
    """
    d = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = d.mapInArrow(_count_task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    top = cut(top.select("lang", "rank", "gram"), "profiles")
    if top.where("rank = 1").limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    found: dict[str, list] = {}
    for row in top.select("lang", "rank", "gram").collect():
        found.setdefault(row["lang"], []).append((row["rank"], row["gram"]))
    return {lang: np.array([g for _, g in sorted(rows)], np.int64) for lang, rows in sorted(found.items())}


class Matcher:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = list(profiles), size
        self.keys = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.int64)]))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.keys, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = gram_counts(text) if text else (np.empty(0, np.int64),) * 2
        if not len(keys) or not self.langs:
            return "und", 0.0
        mine = _ranked(keys, counts, self.size)
        at = np.searchsorted(self.keys, mine)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != mine)] = len(self.keys)
        theirs = self.ranks[at]
        apart = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(mine))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (self.size * len(mine)))


def _predict_task(profiles):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(profiles.value)
        for batch in batches:
            found = [matcher.predict(t.as_py()) for t in batch.column(1)]
            langs, scores = pa.array([lang for lang, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), langs, scores], ["doc_id", "lang_pred", "score"])

    return predict


def identify_language(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text).

    ``training`` has text and lang.  ``und`` with score 0 stands for a text that is null or has no
    letter, and for every text if there is nothing to learn from.  Score is 1 minus the distance's
    share of the largest possible one.  Equal distances go to the language first by name.  Rows
    with a null or repeated doc_id give a row each; other columns aren't looked at.
    """
    ship(docs.sparkSession)
    profiles = docs.sparkSession.sparkContext.broadcast(learn_profiles(training))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_predict_task(profiles), "doc_id long, lang_pred string, score double")
