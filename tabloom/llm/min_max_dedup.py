"""MinHash near-dedup by min-max hashing.

A document's set is its distinct shingles of ``width`` words.  Each of 64 permutations is
evaluated once per shingle and gives two signature values, its minimum and its maximum, so
128 values cost 64 evaluations.  Four values make a band (16 bands of minima, 16 of maxima):
two sets of similarity 0.8 share no band with probability (1 - 0.8**4)**32, below 5e-8.

Hot groups are never paired off among themselves.  Equal sets collapse to one vertex first.  In
a bucket every member is confirmed against the bucket's hub only: the member that shares most
buckets' rows over all its bands, so the text that the others are edits of.  Links within a
component need no comparison, since the result is the components.  What can still be missing are
links of members outside their hub's component; those meet all members of that hub's buckets in
blocks of bounded size (rows and shingles), where pairs of different components whose signatures agree
in at least AGREE of 128 values (fewer have a chance of 2e-7 at similarity 0.8; ``agree=0`` compares
all of them) are confirmed on the full sets, unless links found in the block connect them already.

Sets, buckets and vertices that hold very many rows are joined apart from the others (``join_hot``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, discard, join_hot

PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
VALUES = 2 * PERMUTATIONS
AGREE = 78
BLOCK_ROWS = 1_024
BLOCK_SHINGLES = 1_000_000
BLOOM_BITS = 1 << 23

_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]
_MIX = (_rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1))[None, :]
_BAND = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def _finish(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: what ASCII bytes' split() and lower() do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a shorter text is one shingle, an empty one none."""
    parts = words(text)
    if not parts:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(parts) - width + 1)
    mixed = np.full(n, min(len(parts), width), np.uint64)
    for k in range(min(width, len(parts))):
        mixed = _finish(mixed * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n])
    return np.unique(mixed)


def signature(items: np.ndarray) -> np.ndarray:
    """The 128 minima and maxima of a set that isn't empty."""
    low = (items >> np.uint64(32)).astype(np.uint32)
    hashed = low[None, :] * _A + _B
    return np.concatenate([hashed.min(axis=1), hashed.max(axis=1)])


def band_keys(values: np.ndarray) -> np.ndarray:
    """The 32 band keys of a signature."""
    rows = values.astype(np.uint64).reshape(BANDS, ROWS)
    return _finish((rows * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND).view(np.int64)


_SIGNED = pa.schema([("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("mark", pa.binary())])


def _signer(width: int):
    def sign(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                items = shingles(text.as_py(), width)
                if len(items):
                    values = signature(items)
                    rows.append((len(items), xxhash.xxh3_128_digest(items.tobytes()), band_keys(values), values.astype(np.uint8).tobytes()))
                else:
                    rows.append((0, None, None, None))
            made = [pa.array(c, f.type) for c, f in zip(zip(*rows), _SIGNED)] if rows else [pa.nulls(0, f.type) for f in _SIGNED]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *_SIGNED.names])

    return sign


def _lister(width: int):
    def full_sets(batches):
        for batch in batches:
            sets = [shingles(t.as_py(), width).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "items"])

    return full_sets


def _comparer(share: int, agree: int):
    def compare(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Links (a, b) that connect the components of two blocks; each confirmed on the full sets."""
        found, root = [], {}

        def find(x):
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        if len(left) and len(right):
            marks = np.frombuffer(b"".join(right["mark"]), np.uint8).reshape(len(right), -1)
            ids, labels, sizes, sets = (right[c].to_numpy() for c in ("id", "label", "n", "items"))
            for one in left.itertuples(index=False):
                able = (labels != one.label) & (np.minimum(sizes, one.n) * 100 >= np.maximum(sizes, one.n) * share)
                able &= (marks == np.frombuffer(one.mark, np.uint8)).sum(axis=1) >= agree
                for k in np.flatnonzero(able):
                    x, y = find(one.label), find(labels[k])
                    if x == y:
                        continue
                    common = len(np.intersect1d(one.items, sets[k], assume_unique=True))
                    if common * 100 >= (len(one.items) + len(sets[k]) - common) * share:
                        root[max(x, y)] = min(x, y)
                        found.append((one.id, ids[k]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return compare


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of the component, for every id on an edge (a, b).

    Alternating large-star and small-star steps; each step's edges are written to the shared
    folder.  Stops when a whole step changes nothing.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if before is not None and (seen["n"], seen["h"]) == before or not seen["n"]:
            break
        before = (seen["n"], seen["h"])
        # Large star: every larger neighbour of a vertex moves to the smallest neighbour.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c")), "least", 2 * seen["n"])
        large = join_hot(both, least, "u", "c").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large", seen["n"])
        discard(now, least)
        # Small star: the smaller neighbours of a vertex, and itself, move to the smallest of them.
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")), "least", seen["n"])
        small = join_hot(large, least, "u", "c").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct(), "small", seen["n"])
        discard(large, least)
    return now.select(F.col("u").alias("id"), F.col("v").alias("label"))


def _bloom(ids: DataFrame) -> DataFrame:
    """A bit set of a fixed 2**23 bits, as at most 131,072 rows (word, bits): small enough to broadcast."""
    bit = F.pmod(F.xxhash64("id"), F.lit(BLOOM_BITS))
    return ids.select(F.floor(bit / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"),
        (bit % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _in_bloom(docs: DataFrame, bloom: DataFrame) -> DataFrame:
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BLOOM_BITS))
    docs = docs.withColumn("word", F.floor(bit / 64)).withColumn("bit", F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")))
    return docs.join(F.broadcast(bloom), "word").where(F.col("bit").bitwiseAND(F.col("bits")) != 0).drop("word", "bit", "bits")


def _fits(a: str, b: str, share: int) -> F.Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * share


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, na, nb) for pairs of ids, by the intersection of the full sets."""
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    joined = pairs.select("a", "b").join(right, "b").join(left, "a")
    return joined.select("a", "b", F.size(F.array_intersect("items_a", "items_b")).alias("common"), F.size("items_a").alias("na"), F.size("items_b").alias("nb"))


def near_duplicates(docs: DataFrame, width: int = 5, share: int = 80, agree: int = AGREE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of documents linked by similarity.

    Two documents are linked when ``100 * |A & B| >= share * |A | B|`` for their sets of distinct
    ``width``-word shingles.  ``component_id`` is the smallest doc_id reachable, ``kept`` tells
    whether that is the document itself.

    Null or blank texts have an empty set and are linked with nothing.  Rows that share a doc_id
    are one vertex and each gives a row.  A null doc_id is no vertex: its component_id is null
    and the row is kept.  Other columns of ``docs`` aren't looked at, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(docs.mapInArrow(_signer(width), "doc_id long, n_shingles long, set_key binary, bands array<long>, mark binary"), "signed")
    vertices = signed.where("doc_id is not null and set_key is not null")

    # Equal sets: one vertex, the smallest id; partial aggregation takes care of huge classes.
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "bands", "mark")]
    classes = cut(vertices.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("c"), *firsts).withColumnRenamed("n_shingles", "n"), "classes")
    same = join_hot(vertices.select("doc_id", "set_key"), classes.select("set_key", "id", "c"), "set_key",
        "c").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))

    # Buckets of two or more.  A vertex may stand for two sets if rows share a doc_id.
    every = classes.select("id", "n", F.posexplode("bands").alias("band", "bucket"))
    counts = cut(every.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    every = cut(join_hot(every, counts, "bucket", "c"), "member")
    discard(counts)
    central = cut(every.groupBy("id").agg(F.sum("c").alias("weight")), "central")
    weighed = every.join(central, "id").select("bucket", F.struct("weight", (-F.col("id")).alias("less"), "n").alias("h"))
    top = weighed.groupBy("bucket").agg(F.max("h").alias("h"), F.count("*").alias("members"))
    hubs = cut(top.select("bucket", (-F.col("h.less")).alias("hub"), F.col("h.n").alias("hub_n"), "members"), "hubs")
    member = cut(join_hot(every, hubs, "bucket", "members").drop("members"), "hubbed")
    discard(every, central, hubs)
    star = member.where((F.col("id") != F.col("hub")) & _fits("n", "hub_n", share)).select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b"))
    star = cut(star.distinct(), "star")

    needed = member.select("id").distinct()
    bloom = _bloom(needed)
    texts = _in_bloom(docs.where("doc_id is not null"), bloom).join(needed.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    sets = cut(texts.select("doc_id", "text").mapInArrow(_lister(width), "id long, items array<long>").where(F.size("items") > 0), "sets")

    linked = F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * share
    labels = components(_confirm(star, sets).where(linked).select("a", "b"))
    discard(star)
    edges = labels.select(F.col("id").alias("a"), F.col("label").alias("b"))

    # Hubs with three or more members in a bucket, some of them outside the hub's component.
    shared = cut(member.where("c > 2").select("hub", "id", "n").distinct(), "shared")
    rows, used = shared.count(), [classes, member, sets, shared]
    if rows:
        of_hub = labels.select(F.col("id").alias("hub"), F.col("label").alias("hub_label"))
        tagged = shared.join(labels, "id", "left").join(of_hub, "hub", "left")
        tagged = tagged.select("hub", "id", "n", F.coalesce("label", "id").alias("label"), F.coalesce("hub_label", "hub").alias("hub_label"))
        tagged = cut(tagged.withColumn("outside", F.col("label") != F.col("hub_label")), "tagged", rows)
        out_n = F.when(F.col("outside"), F.col("n")).otherwise(0)
        mixed = tagged.groupBy("hub").agg(F.count("*").alias("c"), F.count_if("outside").alias("out"), F.sum("n").alias("items"),
            F.sum(out_n).alias("out_items")).where("out > 0 and c > 2")
        parts = lambda c, n: F.ceil(F.greatest(F.col(c) / BLOCK_ROWS, F.col(n) / BLOCK_SHINGLES)).cast("int")
        mixed = cut(mixed.select("hub", "c", parts("c", "items").alias("blocks"), parts("out", "out_items").alias("groups")), "mixed", rows)
        left = join_hot(tagged, mixed, "hub", "c").withColumn("place", F.xxhash64("id"))
        block, group = F.pmod("place", "blocks").cast("int"), F.pmod("place", "groups").cast("int")
        asks = left.where("outside").select("hub", "id", "n", "label", group.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
        others = left.select("hub", "id", "n", "label", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("i"), block.alias("j"))
        full = sets.join(classes.select("id", "mark"), "id")
        asks, others = (d.join(full, "id") for d in (asks, others))
        keys = ["hub", "i", "j"]
        asks, others = (d.toDF(*[f"{c}_{t}" if c in keys else c for c in d.columns]).select(*[F.col(f"{c}_{t}") for c in keys],
            *[F.col(c).alias(c) for c in ("id", "n", "label", "mark", "items")]) for d, t in ((asks, "x"), (others, "y")))
        found = asks.groupBy("hub_x", "i_x", "j_x").cogroup(others.groupBy("hub_y", "i_y", "j_y")).applyInPandas(_comparer(share, agree), "a long, b long")
        found = cut(found, "found", rows)
        edges = edges.unionByName(found)
        used += [tagged, mixed, found]

    labels = components(edges.unionByName(same))
    discard(*used)
    out = signed.select("doc_id", "n_shingles").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("label", "doc_id")
    return out.select("doc_id", F.col("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id, with all its columns.

    Rows that share a doc_id are one document, of which the row with the smallest text hash stays.
    Rows with a null doc_id all stay.  Only rows that a fixed-size bit set of the ids concerned lets
    through are shuffled; all others pass straight on.
    """
    found = near_duplicates(docs, width, share).groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("copies"))
    found = cut(found.where("doc_id is not null and (not kept or copies > 1)"), "found")
    bloom = _bloom(found.select(F.col("doc_id").alias("id")))
    names = docs.columns
    bit = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(BLOOM_BITS))
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    d = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.floor(bit / 64).alias("word"), mask.alias("mask"), F.xxhash64("text").alias("h"))
    d = d.join(F.broadcast(bloom), "word", "left").withColumn("touched",
        F.col("id").isNotNull() & (F.coalesce(F.col("mask").bitwiseAND(F.col("bits")), F.lit(0)) != 0))
    straight = d.where(~F.col("touched")).select("row")
    looked = d.where("touched").select("row", "id", "h").join(found.withColumnRenamed("doc_id", "id"), "id", "left").where(F.coalesce("kept", F.lit(True)))
    single = looked.where("coalesce(copies, 1) = 1").select("row")
    first = looked.where("copies > 1").groupBy("id").agg(F.min_by("row", "h").alias("row")).select("row")
    return straight.unionByName(single).unionByName(first).select(*[F.col(f"row.`{c}`").alias(c) for c in names])
