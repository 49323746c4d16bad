"""Token-ID output: documents to range-coded shard files in order, and back.

1. Texts are encoded once; ids and a histogram per task go to the shared folder.
2. The histograms are added up (as many numbers as the vocabulary has) and quantised to one table,
   which is written beside the shards.
3. Ids are range-sorted by doc_id, or another order.  A partition writes shards of about SHARD_IDS ids, one
   after another, so what a task holds is bounded by ids, however long or alike the documents are.  Files are
   written under a temporary name and moved: a task that is run again replaces them.
4. A manifest (Parquet) lists spans of SPAN_IDS ids; each is decoded from its checkpoint alone, so several
   tasks can read one shard.  The folder is all that a reader needs.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .bpe_ids import encoder, grouped
from .common import arrow_filesystem, cut, discard, put_file, shared_dir
from .rans import Table, quantise, read_documents, read_table, shard_bytes, table_bytes

SHARD_IDS = 4_000_000
SPAN_IDS = 2_000_000
SHARDS_A_PARTITION = 4
SPANS_A_TASK = 4
TABLE, MANIFEST = "frequencies.rtab", "manifest"
_SPANS = "part int, shard int, file string, first long, last long, documents long, tokens long, bytes long"


def _encode_task(path: str, pattern: str, end_id: int, vocabulary: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, counts, schema = encoder(path, pattern), np.zeros(vocabulary, np.int64), None
        last, row = np.array([end_id], coder.dtype).tobytes(), TaskContext.get().partitionId() << 40
        for batch in grouped(batches):
            ids = pc.binary_join_element_wise(coder.encode_all(batch.column("text")), last, b"")
            flat = np.frombuffer(ids.buffers()[2], coder.dtype, sum(n := [k // coder.dtype.itemsize for k in pc.binary_length(ids).to_pylist()]))
            counts += np.bincount(flat, minlength=vocabulary)
            rows = pa.array(range(row, row + len(ids)), pa.int64())
            row += len(ids)
            kept = batch.drop_columns(["text"])
            made = {"row": rows, "ids": ids, "n": pa.array(n, pa.int64()), "histogram": pa.nulls(len(ids), pa.binary())}
            out = pa.RecordBatch.from_arrays([*kept.columns, *made.values()], [*kept.schema.names, *made])
            schema = out.schema
            yield out
        coder.forget()
        if schema is not None:
            used = np.flatnonzero(counts)
            packed = used.astype("<u4").tobytes() + counts[used].astype("<u8").tobytes()
            yield pa.RecordBatch.from_pylist([{"histogram": packed}], schema)

    return encode


def _histogram(packed: list[bytes], vocabulary: int) -> np.ndarray:
    total = np.zeros(vocabulary, np.int64)
    for p in packed:
        n = len(p) // 12
        total[np.frombuffer(p, "<u4", n)] += np.frombuffer(p, "<u8", n, 4 * n).astype(np.int64)
    return total


def _add_histograms(vocabulary: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _histogram([p.as_py() for b in batches for p in b.column(0)], vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"histogram": pa.array([used.astype("<u4").tobytes() + total[used].astype("<u8").tobytes()], pa.binary())})

    return add


@functools.lru_cache(4)
def load_table(folder: str) -> Table:
    """The folder's frequency table, read once in each process."""
    store, path = arrow_filesystem(folder)
    with store.open_input_file(f"{path}/{TABLE}") as f:
        return read_table(f.read())


def _write_task(folder: str, dtype: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        names, lengths, parts, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal names, lengths, parts, size, shard
            flat = np.frombuffer(b"".join(parts), dtype).astype(np.uint32)
            parts = []
            file = f"shard-{part:06d}-{shard:06d}.rtok"
            n_bytes = put_file(f"{folder}/{file}", shard_bytes(lengths, flat, load_table(folder), names))
            spans, first, held = [], 0, 0
            for k, n in enumerate(lengths):
                held += n
                if held >= SPAN_IDS or k + 1 == len(lengths):
                    spans.append({"part": part, "shard": shard, "file": file, "first": first, "last": k + 1, "documents": k + 1 - first,
                        "tokens": held, "bytes": n_bytes})
                    first, held = k + 1, 0
            names, lengths, size, shard = [], [], 0, shard + 1
            types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
            return pa.RecordBatch.from_pylist(spans, pa.schema([(f.split()[0], types[f.split()[1]]) for f in _SPANS.split(", ")]))

        for batch in batches:
            for name, n, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids")):
                names.append(name)
                lengths.append(n)
                parts.append(ids.as_py())
                size += n
                if size >= SHARD_IDS:
                    yield close()
        if names:
            yield close()

    return write


def read_shard(folder: str, file: str, first: int = 0, last: int | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a shard's documents first..last, in their order."""
    store, path = arrow_filesystem(folder)
    with store.open_input_file(f"{path}/{file}") as f:
        yield from read_documents(f, load_table(folder), first, last)


def _read_task(folder: str, digests: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for span in (s for b in batches for s in b.to_pylist()):
            docs, starts, sizes, values, at, held = [], [], [], [], span["start"], 0
            for doc, ids in read_shard(folder, span["file"], span["first"], span["last"]):
                docs.append(doc)
                starts.append(at)
                sizes.append(len(ids))
                values.append(zlib.crc32(ids.astype("<u4").tobytes()) if digests else ids.astype(np.int64))
                at, held = at + len(ids), held + len(ids)
                if not digests and held > SPAN_IDS // 4:
                    yield _rows(docs, starts, sizes, values, digests, span["file"])
                    docs, starts, sizes, values, held = [], [], [], [], 0
            if docs:
                yield _rows(docs, starts, sizes, values, digests, span["file"])

    return read


def _rows(docs: list, starts: list, sizes: list, values: list, digests: bool, file: str) -> pa.RecordBatch:
    last = pa.array(values, pa.int64() if digests else pa.list_(pa.int64()))
    columns = [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), last, pa.array([file] * len(docs))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids", "shard"])


def write_token_files(docs: DataFrame, path: str, pattern: str, end_id: int = 2, folder: str | None = None, order: Sequence[Column] | None = None) -> str:
    """Write ``docs`` (doc_id, text) as shards with their table and manifest; returns the folder.

    Documents stand in the order of the columns ``order`` of ``docs``, ascending and nulls first; that of
    doc_id, if none are told.  Rows that are equal in them all stay, ordered by a hash of their ids.  A null
    text is empty: its document is the end id alone.  No documents: no shards.  Other columns aren't looked
    at.  Without ``folder`` the files lie in the run's shared folder, which goes when the session's process ends.
    """
    spark = docs.sparkSession
    coder = encoder(path, pattern)
    vocabulary = max(coder.whole.get_vocab_size(), end_id + 1)
    folder = folder or f"{shared_dir(spark)}/tokens"
    keys = [c.alias(f"o{k}") for k, c in enumerate([F.col("doc_id").cast("long")] if order is None else order)]
    d = docs.select(*keys, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    coded = cut(d.mapInArrow(_encode_task(path, pattern, end_id, vocabulary), f"{kept}, row long, ids binary, n long, histogram binary"), "coded")
    rows = coded.where("histogram is null").drop("histogram")

    # Sums of histograms: a few at a time, so that what the driver gets doesn't grow with the tasks.
    parts = coded.where("histogram is not null").select("histogram").repartition(4).mapInArrow(_add_histograms(vocabulary), "histogram binary")
    total = _histogram([bytes(r["histogram"]) for r in parts.collect()], vocabulary)
    put_file(f"{folder}/{TABLE}", [table_bytes(quantise(total))])

    # The last key is a row's number in the written table, so that even rows that are all alike can be split.
    count = max(int(total.sum()) // (SHARDS_A_PARTITION * SHARD_IDS) + 1, spark.sparkContext.defaultParallelism)
    by = [*[F.col(f"o{k}").asc_nulls_first() for k in range(len(keys))], F.xxhash64("ids"), F.col("row")]
    placed = rows.repartitionByRange(count, *by).sortWithinPartitions(*by)
    spans = cut(placed.select("doc_id", "n", "ids").mapInArrow(_write_task(folder, coder.dtype.str), _SPANS), "spans")
    # A row for each partition of SHARDS_A_PARTITION shards: few enough for one task to add up.
    before = lambda over: F.coalesce(F.sum("tokens").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = spans.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", before(Window.orderBy("part")).alias("offset"))
    within = before(Window.partitionBy("part").orderBy("shard", "first"))
    spans.withColumn("start", within).join(offsets, "part").withColumn("start",
        F.col("start") + F.col("offset")).drop("offset").write.parquet(f"{folder}/{MANIFEST}")
    discard(coded, spans)
    return folder


def _spread(spark: SparkSession, folder: str) -> DataFrame:
    spans = spark.read.schema("file string, first long, last long, start long").parquet(f"{folder}/{MANIFEST}")
    # A few spans a task, but enough tasks for all cores and for a lost one to cost little.
    count = spans.count()
    return spans.repartition(max(1, min(count, 100_000, max(2 * spark.sparkContext.defaultParallelism, count // SPANS_A_TASK))), "file", "first")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids, shard) per document, from what the folder holds; ``start`` gives the order."""
    return _spread(spark, folder).mapInArrow(_read_task(folder, False), "doc_id long, start long, n_tokens long, ids array<long>, shard string")


def token_digests(docs: DataFrame, path: str, pattern: str, end_id: int = 2, folder: str | None = None, order: Sequence[Column] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) per document, read back from the files that ``docs`` is
    written to (see write_token_files)."""
    folder = write_token_files(docs, path, pattern, end_id, folder, order)
    return _spread(docs.sparkSession, folder).mapInArrow(_read_task(folder, True), "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")
