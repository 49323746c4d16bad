"""Shared pieces of the corpus operators: tables, the shared folder, lineage cuts and byte files."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..cluster import ship as ship_sources

_RUN = uuid.uuid4().hex[:12]
_MADE: list[tuple[SparkSession, str]] = []


BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """The package for the workers, and smaller Arrow batches: rows hold whole texts.  A batch size that the
    session has been given stays."""
    ship_sources(spark)
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read through Spark so that any store it knows will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    Only a local session may go without that setting: there driver and executors are one
    process, so a temporary folder is shared by all of them.
    """
    ship(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tabloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/tabloom-{_RUN}/{uuid.uuid4().hex[:12]}"
    if not _MADE:
        atexit.register(_cleanup)
    _MADE.append((spark, path))
    return path


ROWS_A_FILE = 100_000


def cut(df: DataFrame, name: str = "cut", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage that outlives executors.

    ``rows`` is about how many rows there are, if that is known: no more tasks than they need.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // ROWS_A_FILE + 1))
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.files__ = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of frames made by ``cut`` from which everything has been computed that will be."""
    for df in frames:
        _delete(df.sparkSession, df.files__)


def release(spark: SparkSession) -> None:
    """Lets frames that nobody refers to any more go, and the shuffle files of their jobs with them."""
    gc.collect()
    spark._jvm.System.gc()


def _cleanup() -> None:
    for spark, path in _MADE:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended: nothing is left to clean with
            return


def arrow_filesystem(uri: str):
    """The pyarrow file system of a path or URI, and the path within it."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def put_file(uri: str, chunks) -> int:
    """Write byte chunks under a temporary name, then move them to ``uri``: a rerun task replaces it."""
    store, path = arrow_filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    temporary, size = f"{path}.{uuid.uuid4().hex[:8]}.tmp", 0
    with store.open_output_stream(temporary) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    store.move(temporary, path)
    return size


class TwoGenerations(dict):
    """A memo bounded by bytes: when the young generation is full it becomes the old one.

    ``compute(key)`` makes a missing value.  Frequent keys move back to the young generation
    as they are met, so only rare ones are computed again.  Keys longer than LONGEST aren't kept.
    """

    ENTRY = 220  # bytes of two objects, a dictionary's slot and the memory manager's rounding, at most
    LONGEST = 200

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.used, self.old = compute, limit // 2, 0, {}

    def forget(self) -> None:
        """Lets all values go: workers go on to other operators' tasks."""
        self.clear()
        self.old, self.used = {}, 0

    def known(self, key):
        """The value, if it has been made and kept; else None."""
        value = self.get(key)
        return self.old.get(key) if value is None else value

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.LONGEST:
                return value
        if self.used >= self.limit:
            self.old, self.used = dict(self), 0
            self.clear()
        self.used += len(key) + len(value) + self.ENTRY
        self[key] = value
        return value


def file_order(docs: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[Column] | None]:
    """``columns`` of ``docs``, and by which columns its rows come in the order of the files it is read from.

    That order is None if it isn't read straight from Parquet files.  Part files are named in the order of
    their partitions, so a sorted frame that was written and read again has its order back by this.
    """
    names = [F.col(f"`{c}`") for c in columns]
    try:
        placed = docs.select(*names, F.col("_metadata.file_name").alias("file__"), F.col("_metadata.row_index").alias("row__"))
    except AnalysisException:  # no such hidden columns
        return docs.select(*names), None
    return placed, [F.length("file__"), F.col("file__"), F.col("row__")]


HOT_SHARE = 10_000


def join_hot(rows: DataFrame, groups: DataFrame, key: str | list[str], count: str, least: int = 10_000) -> DataFrame:
    """``rows`` joined with ``groups`` (one row a key, and how many rows it has) on ``key``, hot keys apart.

    A key is hot with more than ``least`` rows and more than a HOT_SHARE-th of all of them, so there are
    fewer than HOT_SHARE hot keys: those are broadcast, and their rows stay where they are.
    """
    seen = groups.agg(F.sum(count).alias("total"), F.max(count).alias("most")).first()
    border = max(least, (seen["total"] or 0) // HOT_SHARE)
    if (seen["most"] or 0) <= border:
        return rows.join(groups, key)
    keys, hot = [key] if isinstance(key, str) else key, groups.where(F.col(count) > border)
    apart = rows.join(F.broadcast(hot.select(*keys)), key, "left_anti").join(groups.where(F.col(count) <= border), key)
    return apart.unionByName(rows.join(F.broadcast(hot), key))


def running_sums(rows: DataFrame, order: Sequence[Column], sums: dict[str, str], number: str) -> DataFrame:
    """Each row's number from 0 in ``order``, and for each column of ``sums`` its sum over all rows before,
    under the name told.  Rows are range-partitioned; only a row a partition meets in one task.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part__", F.spark_partition_id())
    placed = cut(placed, "placed")  # a partition's number must be the same in its rows and in its sums
    totals = placed.groupBy("part__").agg(F.count("*").alias("number__"), *[F.sum(c).alias(f"{to}__") for c, to in sums.items()])
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    offsets = totals.select("part__", *[so_far(f"{c}__", before).alias(f"{c}__") for c in ("number", *sums.values())])
    inner = Window.partitionBy("part__").orderBy(*order)
    within = inner.rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(offsets), "part__").withColumn(number, F.col("number__") + F.row_number().over(inner) - 1)
    for column, to in sums.items():
        out = out.withColumn(to, F.col(f"{to}__") + so_far(column, within))
    return out.drop("part__", "number__", *[f"{to}__" for to in sums.values()])
