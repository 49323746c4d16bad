"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Every source has a weight schedule, a piecewise linear curve over training time 0..1.  Its
integral is the source's weight in the mix; after the caps have been shared out, the curve
divided by its integral tells how the source's token demand runs over time.  A source's documents
stand in a fixed pseudo-random order, one pass after another; a copy whose words lie in the middle
of the cumulative demand ``d`` trains at the time at which the integral reaches ``d``.

No source is sorted in one task: documents fall into hash buckets per source (of 256 rows, or
sqrt(rows) of them for large sources),
sums over buckets give each bucket's offset, and windows run within a bucket only.  What is gathered
of a source is the count of its documents of each size.  Sources are numbered and added up by ranges, so
they may be many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DateType, DayTimeIntervalType, NumericType, TimestampNTZType, TimestampType

from .common import cut, join_hot, running_sums

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 20_000
BUCKET_ROWS = 256
_NARROW = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType, DayTimeIntervalType)
#: Weight schedules that sources take in turn: (time, weight) knots.  Their integrals are 5, 2 and 1.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)), ((0.0, 0.5), (1.0, 1.5)))


def integral(knots: Sequence[tuple[float, float]]) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def check_schedule(knots: Sequence[tuple[float, float]]) -> None:
    times = [t for t, _ in knots]
    if len(knots) < 2 or times[0] != 0 or times[-1] != 1 or times != sorted(set(times)):
        raise ValueError("a schedule has increasing times from 0 to 1")
    if any(w < 0 for _, w in knots) or integral(knots) <= 0:
        raise ValueError("a schedule's weights are not negative, and not all 0")


def invert(knots: Sequence[tuple[float, float]], share: Column) -> Column:
    """The time at which the schedule's integral has reached ``share`` (0..1) of its whole."""
    whole, done, out = integral(knots), 0.0, F.lit(1.0)
    pieces = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        rest = F.greatest(share * whole - done, F.lit(0.0))
        if slope:
            step = (F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))) - w0) / slope
        else:
            step = rest / w0 if w0 else F.lit(0.0)
        done += area
        pieces.append((done / whole, F.least(t0 + step, F.lit(float(t1)))))
    for upto, value in reversed(pieces):
        out = F.when(share <= upto, value).otherwise(out)
    return out


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, schedules: Sequence, total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The columns of ``sizes`` with turn and target, by water-filling.

    ``sizes`` has one row per source: source, rows, source_size.  With caps c = most * size and
    weights w, the targets are min(c, w * x) for the x at which they sum to the total: sources
    ordered by c / w are full up to some place, and x follows from the sums on either side of it.
    """
    weights = F.array(*[F.lit(integral(k)) for k in schedules])
    by_name = F.col("source").asc_nulls_last()
    d = running_sums(sizes, [by_name], {}, "place").withColumn("turn", (F.col("place") % len(schedules)).cast("int"))
    d = d.withColumn("w", F.element_at(weights, F.col("turn") + 1)).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    d = running_sums(d, [F.col("cap") / F.col("w"), by_name], {"cap": "full_before", "w": "w_before"}, "place")
    whole = d.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    total, weight = (whole["size"] or 0) * float(total_share), whole["w"] or 0.0
    # Were all before this one full, the rest would be shared at this level; later ones come out lower.
    x = (F.lit(total) - F.col("full_before")) / (F.lit(weight) - F.col("w_before"))
    level = d.withColumn("x", x).where(F.col("x") * F.col("w") <= F.col("cap")).agg(F.max("x")).first()[0]
    target = F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("w"))
    return d.select(*sizes.columns, "turn", target.alias("target"))


def _fill(rest: Column, done: Column, spares: Column) -> Column:
    """(size, n, start) of the spare documents that fill a source's rest: as many of each size as
    fit, from the longest downwards.  ``start`` is where the first of them lies in the rest."""
    none = F.struct(done.cast("long").alias("done"), F.array().cast("array<struct<size:bigint,n:bigint,start:bigint>>").alias("picks"))

    def step(made: Column, spare: Column) -> Column:
        n = F.least(spare["n"], F.floor((rest - made["done"]) / spare["size"]))
        one = F.struct(spare["size"].alias("size"), n.cast("long").alias("n"), made["done"].alias("start"))
        return F.when(n > 0, F.struct((made["done"] + n * spare["size"]).cast("long").alias("done"),
            F.concat(made["picks"], F.array(one)).alias("picks"))).otherwise(made)

    return F.aggregate(F.reverse(F.array_sort(spares)), none, step, lambda made: made["picks"])


def curriculum_mix(docs: DataFrame, schedules: Sequence = SCHEDULES, total_share: float = 1.5, most: float = 2.0, seed: int = 42,
    carry: Sequence[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with a new column, the struct ``mix``: its part in the mixture.  A column of
    that name is replaced.  Columns not in ``carry``, if that is given, stay behind.

    ``docs`` has doc_id, source and text, and any other columns, which stay as they are.
    ``mix`` holds size (words; 0 for a null text), source_size, target, copies, taken (words,
    repeats counted) and positions (training times of the copies, ascending, in 0..1).

    Sources are ordered by code point, null last (a null source is a source of its own), and take
    the schedules in turn.  All together they get ``total_share`` of all words; none gets more
    than ``most`` (a whole number) times its size, the excess goes to the others by weight.
    Whole documents are taken: each ``floor(target / size)`` times, and once more in hash order
    until the rest of the target is met; those longer than the rest are passed over.  What is left
    then is filled with other documents of the source, the longest that fit first, so a source
    misses its target by less than the shortest document not taken once more.  No row is taken more than ``most`` times.  Rows of no words are never taken unless a
    whole pass is, which takes nothing from them.  Order depends on values alone, never on
    partitions: reruns agree.  An empty table gives an empty one.
    """
    for knots in schedules:
        check_schedule(knots)
    if most != int(most) or total_share > most:
        raise ValueError("most is a whole number, and at least the total share")
    names = list(carry or docs.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    source = F.col("source").cast("string")
    key = F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("src")  # never null, so that joins are plain
    d = docs.select(row, key, source.alias("source"), word_count().alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")).alias("h"),
        F.xxhash64(F.lit(seed), "text").alias("h2"))
    # The sums below take no second look at the texts; nor does the last step, if the columns to carry are narrow.
    if all(isinstance(f.dataType, _NARROW) for f in d.schema["row"].dataType.fields):
        d = cut(d, "sizes")
        bare = d.drop("row")
    else:
        bare = cut(d.drop("row"), "sizes")

    sizes = cut(bare.groupBy("src", "source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size")), "sources")
    targets = source_targets(sizes, schedules, total_share, most)
    # Few sources are broadcast, after a check; more of them are joined by a shuffle, the largest apart.
    few = sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    known = targets.drop("source").withColumn("buckets", F.least(F.ceil(F.sqrt("rows")), F.ceil(F.col("rows") / BUCKET_ROWS))).withColumn("full",
        F.floor(F.col("target") / F.greatest("source_size", F.lit(1)) + 1e-12))
    known = cut(known.withColumn("rest", F.when(F.col("full") < most, F.greatest(F.col("target") - F.col("full") * F.col("source_size"),
        F.lit(0.0))).otherwise(0.0)), "targets")

    def of_source(rows: DataFrame, by: DataFrame, count: str) -> DataFrame:
        return rows.join(F.broadcast(by), "src") if few else join_hot(rows, by, "src", count)

    def in_buckets(rows: DataFrame) -> DataFrame:
        return of_source(rows, known, "rows").withColumn("bucket", F.pmod(F.col("h"), F.col("buckets"))).withColumn("able",
            (F.col("size") > 0) & (F.col("size") <= F.col("rest")))

    able_size = F.when(F.col("able"), F.col("size")).otherwise(0)
    along = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = in_buckets(bare).groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size"), F.sum(able_size).alias("able_size"))
    sums = cut(sums.select("src", "bucket", *[F.coalesce(F.sum(c).over(along), F.lit(0)).alias(to) for c, to in (("bucket_size", "bucket_start"),
        ("able_size", "able_start"))]), "sums")

    def in_order(rows: DataFrame, sums: DataFrame) -> DataFrame:
        """Where a row starts among all of its source, and whether it is in time for the rest."""
        rows = rows.join(sums, ["src", "bucket"])
        within = Window.partitionBy("src", "bucket").orderBy("h", "h2").rowsBetween(Window.unboundedPreceding, -1)
        for size, start in ((F.col("size"), "bucket_start"), (able_size, "able_start")):
            rows = rows.withColumn(start, F.col(start) + F.coalesce(F.sum(size).over(within), F.lit(0)))
        return rows.withColumn("early", F.col("able") & (F.col("able_start") + F.col("size") <= F.col("rest")))

    # What is left then is filled from the longest size that fits downwards, over all of a source.
    spare = F.col("able") & ~F.col("early")
    ran = in_order(in_buckets(bare), sums)
    left = ran.groupBy("src", "size").agg(F.first("rest").alias("rest"), F.sum(F.when(F.col("early"), F.col("size")).otherwise(0)).alias("done"),
        F.count(F.when(spare, 1)).alias("n"))
    left = left.groupBy("src").agg(F.max("rest").alias("rest"), F.sum("done").alias("done"), F.sum("n").alias("spare_rows"),
        F.collect_list(F.when(F.col("n") > 0, F.struct("size", "n"))).alias("spares"))
    fill = cut(left.select("src", "spare_rows", _fill(F.col("rest"), F.col("done"), F.col("spares")).alias("picks")).where(F.size("picks") > 0), "fill")
    pick = F.get(F.filter("picks", lambda p: p["size"] == F.col("size")), F.lit(0))
    asked = of_source(ran.where(spare), fill, "spare_rows").withColumn("pick", pick).where(F.col("pick").isNotNull())
    asked = asked.groupBy("src", "size", "bucket").agg(F.count("*").alias("n"), F.first("pick").alias("pick"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = asked.withColumn("before", before).withColumn("n", F.least(F.col("n"), F.col("pick.n") - F.col("before"))).where("n > 0")
    picks = F.collect_list(F.struct("size", "n", (F.col("pick.start") + F.col("before") * F.col("size")).alias("start")))
    asked = asked.groupBy("src", "bucket").agg(picks.alias("picks"))
    sums = cut(sums.join(asked, ["src", "bucket"], "left"), "filled")

    d = in_order(in_buckets(d), sums)
    again = F.row_number().over(Window.partitionBy("src", "bucket", "size", "early").orderBy("h", "h2")) - 1
    d = d.withColumn("pick", pick).withColumn("again", again)
    late = spare & F.coalesce(F.col("again") < F.col("pick.n"), F.lit(False))
    d = d.withColumn("extra", F.col("early") | late).withColumn("copies", (F.col("full") + F.col("extra").cast("int")).cast("int"))

    middle = F.col("size") / 2
    place = F.col("bucket_start") + middle
    extra_place = F.when(F.col("early"), F.col("able_start")).otherwise(F.col("pick.start") + F.col("again") * F.col("size")) + middle
    place_of = lambda k: k * F.col("source_size") + F.when(k < F.col("full"), place).otherwise(extra_place)

    def time_of(k: Column) -> Column:
        share = F.least(place_of(k) / F.greatest(F.col("target"), F.lit(1e-9)), F.lit(1.0))
        out = F.lit(None).cast("double")
        for turn, knots in enumerate(schedules):
            out = F.when(F.col("turn") == turn, invert(knots, share)).otherwise(out)
        return out

    positions = F.transform(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>")), time_of)
    mix = F.struct("size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), positions.alias("positions"))
    d = d.select("row", mix.alias("mix"))  # on its own: the next step's names may be those used above
    return d.select(*[F.col(f"row.`{c}`").alias(c) for c in names if c != "mix"], "mix")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The training sequence: a row per copy with its columns, range-sorted by training position."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    mixed = curriculum_mix(docs.select("doc_id", "source", "text", row), carry=["doc_id", "row"], **options)
    mixed = mixed.select("row", "doc_id", F.explode("mix.positions").alias("position"))
    return mixed.orderBy("position", F.xxhash64(F.col("doc_id").cast("string"))).select(*[F.col(f"row.`{c}`").alias(c) for c in names])
