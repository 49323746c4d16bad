"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are whole numbers.  Shards are cells of space: a bounded sample is split at medians of the widest
dimension, and every vector goes to the cell that it lies in; a cell with too many (such as copies of
one vector) is several shards, dealt by a hash.  A shard's own tree splits at medians likewise and keeps a
tight bounding box at every node.  For a query q, no vector in a box scores above
sum(max(q * low, q * high)); nodes are visited best bound first, and a search ends when the best bound
left is below the k-th score.

The k-th score is propagated: a query first searches the sample, a tree that every task has, and takes its
k-th score along.  It goes only to the cells whose bound isn't below that, and there every node (the root
first) whose bound is below it is cut off at once.

A vector is in one shard and a shard in one task, which builds its tree once and lets the queries stream
by; no task holds more than one shard, one batch, and the bounds of BLOCK_ROWS queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, ship

SHARD_ROWS = 65_536
LEAST_ROWS = 2_048
SAMPLE_ROWS = 8_192
BLOCK_ROWS = 1_024
CELL_SAMPLE = 8
LEAF_ROWS = 64
LEAVES = 32
FULLER = 1.25


class Tree:
    """A KD-tree over the rows of a matrix of whole numbers; a leaf's rows stand together, by id."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.low, self.high, self.children, self.rows = [], [], [], []
        self.leaf, order = max(LEAF_ROWS, len(ids) // LEAVES), np.argsort(ids, kind="stable")
        self.order: list[np.ndarray] = []
        if len(ids):
            self._build(vectors, order, 0)
        order = np.concatenate([*self.order, np.empty(0, np.int64)])
        self.vectors, self.ids = vectors[order], ids[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, vectors: np.ndarray, rows: np.ndarray, at: int) -> int:
        node, part = len(self.rows), vectors[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        for held, value in ((self.low, low), (self.high, high), (self.children, None), (self.rows, (at, at + len(rows)))):
            held.append(value)
        widest = int((high - low).argmax())
        if len(rows) <= self.leaf or high[widest] == low[widest]:
            self.order.append(rows)
            return node
        half = len(rows) // 2
        upper = np.zeros(len(rows), bool)
        upper[np.argpartition(part[:, widest], half)[half:]] = True
        self.children[node] = self._build(vectors, rows[~upper], at), self._build(vectors, rows[upper], at + half)
        return node

    @property
    def leaves(self) -> int:
        return len(self.order)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return best_scores(queries, self.low, self.high)

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, floor: float) -> list[tuple[float, int]]:
        """At most k (score, id) of the shard with scores of at least ``floor``, best first."""
        if not len(self.ids):
            return []
        best: list[tuple[float, int]] = []  # (score, -id), the worst on top
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= floor:
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= floor:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            first, last = self.rows[node]
            scores = self.vectors[first:last] @ query
            able = np.flatnonzero(scores >= floor)
            if len(able) > k:  # rows stand by id, so equal scores keep the smaller ids
                able = able[self.ids[first:last][able] != own]
                able = able[np.argsort(-scores[able], kind="stable")[:k]]
            for score, mine in zip(scores[able].tolist(), self.ids[first:last][able].tolist()):
                if mine == own:
                    continue
                entry = (score, -mine)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def best_scores(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The best score that each box could hold for each query."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class Cells:
    """Space split at medians of a sample into about ``count`` cells."""

    def __init__(self, sample: np.ndarray, count: int):
        self.count = 0
        self.root = self._split(sample, count)

    def _split(self, part: np.ndarray, count: int):
        if count > 1 and len(part):
            spread = part.max(axis=0) - part.min(axis=0)
            widest, left = int(spread.argmax()), count // 2
            border = float(np.sort(part[:, widest])[len(part) * left // count])
            lower = part[:, widest] < border
            if not lower.any():  # many are the least: they go left, if any are above
                border = float(np.nextafter(border, np.inf))
                lower = part[:, widest] < border
            if lower.any() and not lower.all():
                return widest, border, self._split(part[lower], left), self._split(part[~lower], count - left)
        self.count += 1
        return self.count - 1

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        out, todo = np.zeros(len(vectors), np.int32), [(self.root, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
                continue
            lower = vectors[rows, node[0]] < node[1]
            todo += [(node[2], rows[lower]), (node[3], rows[~lower])]
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _cell_task(cells, width: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = pa.array(cells.value.of(_matrix(batch.column(1), width)), pa.int32())
            yield pa.RecordBatch.from_arrays([where, *batch.columns], ["cell", "id", "v"])

    return place


def _box_task(width: int):
    """(cell, n, low, high) of a task's vectors; what it holds is a box a cell."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            where, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            for cell in np.unique(where).tolist():
                mine = vectors[where == cell]
                box = held.setdefault(cell, [0, mine[0], mine[0]])
                box[:] = box[0] + len(mine), np.minimum(box[1], mine.min(axis=0)), np.maximum(box[2], mine.max(axis=0))
        cells = sorted(held)
        lows, highs = ([held[c][k].astype("<f8").tobytes() for c in cells] for k in (1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([held[c][0] for c in cells], pa.int64()), pa.array(lows, pa.binary()),
            pa.array(highs, pa.binary())], ["cell", "n", "low", "high"])

    return measure


def _one_box(frame: pd.DataFrame) -> pd.DataFrame:
    low = np.min([np.frombuffer(x, "<f8") for x in frame["low"]], axis=0)
    high = np.max([np.frombuffer(x, "<f8") for x in frame["high"]], axis=0)
    return pd.DataFrame({"cell": [frame["cell"].iloc[0]], "n": [frame["n"].sum()], "low": [low.astype("<f8").tobytes()], "high": [high.astype("<f8").tobytes()]})


def _ask_task(known, k: int, width: int, rows: int):
    """For each query, its k-th score in the sample and the shards that may hold better ones."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, low, high, shards = known.value
        tree = Tree(vectors, ids)
        for batch in (b.slice(at, rows) for b in batches for at in range(0, len(b), rows)):
            asked, own = _matrix(batch.column(1), width), batch.column(0).to_pylist()
            bounds, boxes = tree.bounds(asked), best_scores(asked, low, high)
            floors, where = [], []
            for n, query_id in enumerate(own):
                found = tree.search(asked[n], bounds[n], query_id, k, -np.inf)
                floors.append(found[-1][0] if len(found) == k else -np.inf)
                where.append([s for cell in np.flatnonzero(boxes[n] >= floors[-1]) for s in shards[cell]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.float64()), pa.array(where, pa.list_(pa.int32()))], ["id", "v", "floor", "shards"])

    return ask


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search_task(k: int, width: int, most: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, its vectors first, then its queries."""
        shard, held, tree = None, [], None
        for batch in (b.slice(at, most) for b in batches for at in range(0, len(b), most)):
            key = batch.column("shard").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            borders = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for first, last in zip(borders, borders[1:]):
                if first == last:
                    continue
                part, (here, kind) = batch.slice(first, last - first), divmod(int(key[first]), 2)
                if here != shard:
                    shard, held, tree = here, [], None
                ids, rows = part.column("id").to_numpy(), _matrix(part.column("v"), width)
                if kind == 0:
                    held.append((ids, rows))
                    continue
                if tree is None:
                    tree = Tree(np.concatenate([r for _, r in held]), np.concatenate([i for i, _ in held])) if held else Tree(rows[:0], ids[:0])
                    held = []
                bounds = tree.bounds(rows) if len(tree.ids) else None
                out = []
                for n, (query_id, floor) in enumerate(zip(ids.tolist(), part.column("floor").to_pylist())):
                    out += [(query_id, i, int(s)) for s, i in tree.search(rows[n], bounds[n] if bounds is not None else None, query_id, k, floor)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND)

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best vectors by inner product, but its own.

    Both tables have id (long) and v (array of whole numbers).  Rows with a null id or an empty
    vector, or with a null or non-finite component, take no part.  All others have the same length,
    or else a ValueError is raised.  Ties go to the smaller id.  Rows that share an id with the query are its
    own and are left out.  Every row counts: a candidate that is there twice takes two ranks, and a query
    that is there twice is ranked once, with two of each candidate.  Fewer than k others give fewer rows, an
    empty table none.  Other columns aren't looked at.
    """
    spark = vectors.sparkSession
    ship(spark)
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    plain = [F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")]
    vectors = cut(vectors.where(good).select(*plain), "vectors")
    queries = cut(queries.where(good).select(*plain), "queries")
    seen, waits = (d.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first() for d in (vectors, queries))
    if not seen["n"] or not waits["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lengths = {r[c] for r in (seen, waits) for c in ("least", "most")}
    if len(lengths) > 1:
        raise ValueError(f"the vectors are of mixed lengths, from {min(lengths)} to {max(lengths)} components")
    width = lengths.pop()

    # The bounded sample: the rows of the smallest id hashes.
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow()
    sample_ids, sample_rows = sample.column("id").to_numpy(), _matrix(sample.column("v").combine_chunks(), width)
    wanted = max(-(-seen["n"] // SHARD_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-seen["n"] // LEAST_ROWS)))
    cells = Cells(sample_rows, min(wanted, max(1, len(sample_ids) // CELL_SAMPLE)))
    placed = cut(vectors.mapInArrow(_cell_task(spark.sparkContext.broadcast(cells), width), "cell int, id long, v array<double>"), "placed")
    parts = placed.select("cell", "v").mapInArrow(_box_task(width), "cell int, n long, low binary, high binary")
    boxes = parts.groupBy("cell").applyInPandas(_one_box, "cell int, n long, low binary, high binary").orderBy("cell").collect()

    # No shard has much more than its share of the rows.
    most, shards, ranges = max(LEAST_ROWS, int(FULLER * seen["n"] / wanted) + 1), 0, []
    for box in boxes:
        n = -(-box["n"] // most)
        ranges.append((box["cell"], shards, n))
        shards += n
    low, high = (np.array([np.frombuffer(bytes(b[c]), "<f8") for b in boxes]) for c in ("low", "high"))
    known = spark.sparkContext.broadcast((sample_ids, sample_rows, low, high, [list(range(s, s + n)) for _, s, n in ranges]))
    of_cell = F.broadcast(spark.createDataFrame(ranges, "cell int, first int, n int"))
    at = (F.col("first") + F.pmod(F.xxhash64(F.lit(1), "id"), F.col("n"))).cast("int").alias("shard")
    held = placed.join(of_cell, "cell").select(at, F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("double").alias("floor"))
    asks = queries.mapInArrow(_ask_task(known, k, width, BLOCK_ROWS), "id long, v array<double>, floor double, shards array<int>")
    asks = asks.select(F.explode("shards").alias("shard"), F.lit(1).alias("kind"), "id", "v", "floor")
    met = held.unionByName(asks).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "id")
    found = met.mapInArrow(_search_task(k, width, BLOCK_ROWS), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
