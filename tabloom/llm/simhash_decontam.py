"""Benchmark decontamination by SimHash windows and a multi-index of Hamming blocks.

Texts and benchmark items are lower-cased word sequences.  For an item of L words, every window of
L words of a document is compared by the 64-bit SimHash of its weighted 5-word shingles.
Fingerprints within RADIUS bits are found by a multi-index: the 64 bits fall into 4 blocks, and two
fingerprints at most 23 bits apart are at most 5 bits apart in at least one block, so a table of each
block's values guarantees every one of them.  Candidates are then confirmed by the exact weighted
Jaccard similarity of the full shingle multisets (a shingle weighs its letters).

A shingle counts in the fingerprint by the square root of its weight, so that the angle between two
windows follows their similarity: at 0.8 it is at most 27 degrees, 9.7 bits of 64 on average with a
deviation of 2.9, and RADIUS lies 4.6 deviations off.

A window without any shingle of an item has similarity 0 with it.  So windows are fingerprinted
only where they hold at least one of the benchmark's shingles; this loses nothing.

The benchmark is gone through in chunks of at most CHUNK_ITEMS items and CHUNK_WORDS words (a
longer item is a chunk of its own), each broadcast for one pass over the documents, so what is
broadcast is bounded whatever the benchmark's size.
"""

from __future__ import annotations

import re
import weakref
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import ship

WIDTH = 5
RADIUS = 23
BLOCKS = 4
CHUNK_ITEMS = 5_000
CHUNK_WORDS = 400_000
SLAB = 8_192
_WORD = re.compile(r"\w+")
_BITS = np.arange(64, dtype=np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WIDTH)], np.uint64)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingle_list(parts: list[str], width: int = WIDTH) -> list[str]:
    """All shingles in order; a shorter sequence is one shingle."""
    return [" ".join(parts[k : k + width]) for k in range(max(1, len(parts) - width + 1))] if parts else []


def weighted_similarity(a: list[str], b: list[str]) -> float:
    """Weighted Jaccard similarity of two shingle multisets; a shingle weighs its characters."""
    x, y = Counter(a), Counter(b)
    both = sum(min(n, y[s]) * len(s) for s, n in x.items())
    whole = sum(max(x[s], y[s]) * len(s) for s in x.keys() | y.keys())
    return both / whole if whole else 0.0


def _signs(shingles: list[str]) -> np.ndarray:
    """A row of 64 weights, positive or negative, for each shingle."""
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), np.uint64, len(shingles))
    weight = np.sqrt(np.fromiter(map(len, shingles), np.float64, len(shingles)))
    # Whole numbers, so that running sums are exact wherever they begin.
    weight = np.round(1024 * weight).astype(np.int64)
    return np.where((hashed[:, None] >> _BITS) & np.uint64(1), weight[:, None], -weight[:, None])


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


class HammingIndex:
    """Finds every stored fingerprint within RADIUS bits of a query.

    A table for each block lists its distinct values with the fingerprints that have them; a query looks up
    the values within RADIUS // BLOCKS bits of its own block.
    """

    def __init__(self, fingerprints: np.ndarray):
        self.fingerprints, self.tables = fingerprints, []
        for b in range(BLOCKS):
            block = ((fingerprints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)
            values, where = np.unique(block, return_inverse=True)
            order = np.argsort(where, kind="stable")
            self.tables.append((values, np.searchsorted(where[order], np.arange(len(values) + 1)), order))

    def within(self, query: int) -> dict[int, int]:
        """Item number to distance."""
        able = np.zeros(len(self.fingerprints), bool)
        for b, (values, starts, items) in enumerate(self.tables):
            for k in np.flatnonzero(np.bitwise_count(values ^ np.uint16(query >> 16 * b & 0xFFFF)) <= RADIUS // BLOCKS):
                able[items[starts[k] : starts[k + 1]]] = True
        items = np.flatnonzero(able)
        distance = np.bitwise_count(self.fingerprints[items] ^ np.uint64(query))
        near = distance <= RADIUS
        return dict(zip(items[near].tolist(), distance[near].tolist()))


class Detector:
    """A chunk of the benchmark, ready for lookups."""

    def __init__(self, items: list[tuple[int, str]], least: float):
        self.least, self.ids, self.items = least, [], []
        for item_id, text in items:
            if parts := words(text):
                self.ids.append(item_id)
                self.items.append(parts)
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for parts in self.items for w in parts}))}
        self.shingles = [shingle_list(parts) for parts in self.items]
        sums = [_signs(s).sum(axis=0) for s in self.shingles]
        # An index for each length of items: a window is compared with those of its own length only.
        self.index: dict[int, tuple[HammingIndex, list[int]]] = {}
        for length in sorted({len(parts) for parts in self.items}):
            mine = [k for k, parts in enumerate(self.items) if len(parts) == length]
            self.index[length] = HammingIndex(_fingerprints(np.array([sums[k] for k in mine]))), mine
        # Shingle keys by their width (shorter items are one shorter shingle), and the items' lengths.
        lengths: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for parts in self.items:
            codes = np.array([self.vocabulary[w] for w in parts], np.uint64)
            width = min(WIDTH, len(parts))
            for key in self._keys(codes, width).tolist():
                lengths[width][key].add(len(parts))
        self.lengths = {w: dict(x) for w, x in lengths.items()}
        self.keys = {w: np.array(sorted(x), np.uint64) for w, x in self.lengths.items()}

    @staticmethod
    def _keys(codes: np.ndarray, width: int) -> np.ndarray:
        n = len(codes) - width + 1
        return sum((codes[k : k + n] * _POWERS[k] for k in range(width)), np.zeros(n, np.uint64))

    def _windows(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """By item length, runs (first start, last start) of the windows that hold a shingle of such an item."""
        marks: dict[int, list[tuple[int, int]]] = defaultdict(list)
        known = codes > 0
        for width, keys in self.keys.items():
            n = len(codes) - width + 1
            if n < 1:
                continue
            whole = known[:n].copy()
            for k in range(1, width):
                whole &= known[k : k + n]
            places = np.flatnonzero(whole)
            if not len(places):
                continue
            mixed = sum((codes[places + k] * _POWERS[k] for k in range(width)), np.zeros(len(places), np.uint64))
            at = np.searchsorted(keys, mixed)
            hit = keys[np.minimum(at, len(keys) - 1)] == mixed
            for place, key in zip(places[hit].tolist(), mixed[hit].tolist()):
                for length in self.lengths[width][key]:
                    last = max(0, len(codes) - length)
                    run = min(max(0, place + width - length), last), min(place, last)
                    held = marks[length]
                    if held and held[-1][0] <= run[0] <= held[-1][1] + 1:
                        held[-1] = held[-1][0], max(held[-1][1], run[1])
                    else:
                        held.append(run)
        return {length: _merged(runs) for length, runs in marks.items()}

    def leaks(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """(item_id, similarity, first word, words, bits apart) of each item found, at its best window."""
        parts = words(text)
        if not parts or not self.index:
            return []
        get = self.vocabulary.get
        codes = np.fromiter([get(w, 0) for w in parts], np.uint64, len(parts))
        best: dict[int, tuple[float, int, int, int]] = {}
        for length, runs in self._windows(codes).items():
            for first, last in runs:
                for start in range(first, last + 1, SLAB):
                    self._look(parts, length, start, min(last, start + SLAB - 1), best)
        return [(self.ids[k], *v) for k, v in sorted(best.items(), key=lambda x: (self.ids[x[0]], x[0]))]

    def _look(self, parts: list[str], length: int, first: int, last: int, best: dict) -> None:
        """Looks at the windows that start at first..last."""
        size = min(length, len(parts))
        per = max(1, size - WIDTH + 1)
        stretch = shingle_list(parts[first : last + size], min(WIDTH, size))
        sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(_signs(stretch), axis=0)])
        count = last - first + 1
        prints = _fingerprints(sums[per : per + count] - sums[:count])
        index, mine = self.index[length]
        for start, fingerprint in enumerate(prints.tolist()):
            for at, apart in index.within(fingerprint).items():
                k = mine[at]
                share = weighted_similarity(self.shingles[k], stretch[start : start + per])
                if share >= self.least and (k not in best or share > best[k][0]):
                    best[k] = (share, first + start, size, apart)


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def benchmark_chunks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Bounded lists of (item_id, text), streamed from the table; null texts are left out."""
    chunk, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"),
        F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").toLocalIterator():
        n = len(words(row["text"]))
        if chunk and (len(chunk) >= CHUNK_ITEMS or size + n > CHUNK_WORDS):
            yield chunk
            chunk, size = [], 0
        chunk.append((row["item_id"], row["text"]))
        size += n
    if chunk:
        yield chunk


_built: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _detector(shared, least: float) -> Detector:
    """The chunk's detector, built once in each worker process."""
    made = _built.setdefault(shared, {})
    if least not in made:
        made[least] = Detector(shared.value, least)
    return made[least]


_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()),
    ("n_words", pa.int64()), ("bits_apart", pa.int32())])


def _leak_task(shared, least: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = _detector(shared, least)
        for batch in batches:
            ids = batch.column(0).to_pylist()  # plain numbers: nothing is rounded beside a null
            rows = [(doc, *leak) for doc, text in zip(ids, batch.column(1)) for leak in detector.leaks(text.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LEAKS)], schema=_LEAKS)

    return find


def _clean_task(shared, least: float, place: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = _detector(shared, least)
        for batch in batches:
            texts = batch.column(place)
            yield batch.filter(pa.array([not detector.leaks(t.as_py()) for t in texts], pa.bool_()))

    return clean


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words, bits_apart, contaminated) per leak.

    One row for each document and each benchmark item of which some item-sized window of the
    document has weighted similarity of at least ``least``: its best window, the first among equal
    ones.  ``contaminated`` is true in every row; clean documents have none.  A document shorter
    than the item is one window.  Null and empty texts, and items without a word, take no part;
    null item ids are left out.  Rows that share a doc_id are looked at one by one; an item that is
    there twice gives two rows.  Other columns aren't looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long, bits_apart int"
    out = None
    for chunk in benchmark_chunks(benchmark):
        found = d.mapInArrow(_leak_task(spark.sparkContext.broadcast(chunk), least), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumn("contaminated", F.lit(True))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns as they are.

    Rows with a null or empty text stay, as do all of them if the benchmark is empty.
    """
    spark = docs.sparkSession
    ship(spark)
    place = [c.lower() for c in docs.columns].index("text")
    for chunk in benchmark_chunks(benchmark):
        docs = docs.mapInArrow(_clean_task(spark.sparkContext.broadcast(chunk), least, place), docs.schema)
    return docs
