"""Workbooks by path or by their bytes: writing frames to sheets, what a folder of them holds, and round trips."""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType, TimestampNTZType

from ..cluster import shared_folder, ship
from ..errors import SheetError
from ..functions.cells import MAX_ROWS, format_ref
from ..sources.container import Container, Limits
from ..sources.datasource import CELLS, XlsxReader, bind, chosen_sheets, filesystem, inferred_schema, limits_of, look, open_source, register, sized_files, split_files, told_epoch
from ..sources.grid import Grid
from ..sources.workbook import Workbook
from ..sources.writer import Options, Sheet, WorkbookWriter

FORMAT = "tabloom.xlsx"


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    register(spark)
    path = shared_folder(spark, "books")
    store, inner = filesystem(path)
    store.create_dir(inner, recursive=True)
    return inner if type(store).__name__ == "LocalFileSystem" else path


def as_cells(schema: StructType) -> StructType:
    """The schema that a frame has after a workbook: timestamps are wall clock times."""
    return StructType([StructField(f.name, TimestampNTZType() if f.dataType.typeName() in ("timestamp", "timestamp_ntz",
        "date") else f.dataType) for f in schema.fields])


def write_workbook(path: str, sheets: dict[str, DataFrame], options: Options | None = None, looks: dict[str, Sheet] | None = None) -> dict:
    """Several frames as the sheets of one workbook, streamed through the driver a partition at a time.

    One large frame is better written with ``df.write.format("tabloom.xlsx")``, in parallel.
    """
    store, inner = filesystem(path)
    temporary = f"{inner}.{uuid.uuid4().hex[:8]}.tmp"
    try:
        with store.open_output_stream(temporary) as out:
            book = WorkbookWriter(out.write, options)
            for name, frame in sheets.items():
                rows = ([*frame.columns] if k is None else tuple(k) for k in _with_header(frame))
                book.add((looks or {}).get(name) or Sheet(name), rows)
            done = book.close()
        store.move(temporary, inner)
        return done
    except BaseException:
        if store.get_file_info(temporary).type.name == "File":
            store.delete_file(temporary)
        raise


def _with_header(frame: DataFrame):
    yield None
    yield from frame.toLocalIterator()


def workbook_bytes(sheets: dict[str, list[list]], options: Options | None = None, most: int = 1 << 30) -> bytes:
    """A small workbook of plain rows, in memory."""
    out = io.BytesIO()

    def put(data: bytes) -> None:
        if out.tell() + len(data) > most:
            raise SheetError("LIMIT_EXCEEDED", f"the workbook takes more than {most} bytes", limit="bytes")
        out.write(data)

    book = WorkbookWriter(put, options)
    for name, rows in sheets.items():
        book.add(name, rows)
    book.close()
    return out.getvalue()


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def each_file(spark: SparkSession, path: str, schema: str, work, shared: bool = False, options: dict | None = None) -> DataFrame:
    """What ``work(path, share, shares)`` yields for every workbook at a path, in tasks; only names are listed here.

    With ``shared``, a large file is worked on by several tasks, a share each.
    """
    register(spark)
    ship(spark)
    found, o = sized_files(path), _spread(spark, options or {})
    places = {f: n for n, (f, _) in enumerate(found)}
    parts = [(places[f], f, k, n) for f, k, n in (split_files(found, o) if shared else [(f, 0, 1) for f, _ in found])]
    tasks = max(1, min(len(parts), 10_000))
    files = spark.createDataFrame([(at % tasks, *p) for at, p in enumerate(parts)], "task int, n int, path string, share int, shares int").repartitionById(tasks, "task")
    arrow = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                rows = [*work(f)]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], arrow)

    return files.mapInArrow(run, schema)


def sheet_catalogue(spark: SparkSession, path: str, limits: Limits | None = None) -> DataFrame:
    """(path, index, name, kind, state, hidden) of every sheet; files are looked into on the executors."""
    def work(f):
        with open_source(f["path"]) as source:
            yield from [(f["path"], s.index, s.name, s.kind, s.state, s.hidden) for s in Workbook(source, limits).sheets]

    return each_file(spark, path, "path string, index int, name string, kind string, state string, hidden boolean", work)


def scan_errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, code, message) of the files that can't be opened as workbooks."""
    def work(f):
        try:
            with open_source(f["path"]) as source:
                Workbook(source)
        except SheetError as e:
            yield f["path"], e.code, e.message

    return each_file(spark, path, "path string, code string, message string", work)


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, method, crc, packed, size, offset) of every entry of every archive."""
    def work(f):
        with open_source(f["path"]) as source:
            yield from [(f["path"], e.name, e.method, e.crc, e.packed, e.size, e.offset) for e in Container(source).entries.values()]

    return each_file(spark, path, "path string, name string, method int, crc long, packed long, size long, offset long", work)


def package_parts(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """(path, names, one column of text for each of a few parts); null for a part that isn't there."""
    def work(f):
        with open_source(f["path"]) as source:
            box = Container(source)
            found = [box.find(p) for p in parts]
            yield f["path"], [*box.entries], *[None if p is None else box.read(p).decode("utf-8", "replace") for p in found]

    columns = "".join(f", part{k} string" for k in range(len(parts)))
    return each_file(spark, path, f"path string, names array<string>{columns}", work)


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content) of the files in a tar archive (packed or not), read as a stream in one task."""
    def run(batches):
        for archive in (a for b in batches for a in b.column(0).to_pylist()):
            with open_source(archive) as source, tarfile.open(fileobj=source, mode="r|*") as members:
                for m in members:
                    if m.isfile():
                        yield pa.RecordBatch.from_pydict({"archive": [archive], "name": [m.name], "content": pa.array([members.extractfile(m).read()], pa.binary())})

    ship(spark)
    return spark.createDataFrame([(path,)], "archive string").mapInArrow(run, "archive string, name string, content binary")


def fetch_ranges(ranges: DataFrame) -> DataFrame:
    """The rows of ``ranges`` (path, offset, length) with ``content``, the bytes there."""
    schema = StructType([*ranges.schema.fields, *spark_fields("content binary")])

    def run(batches):
        for batch in batches:
            out = []
            for path, offset, length in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "offset", "length"))):
                with open_source(path) as source:
                    source.seek(offset)
                    out.append(source.read(length))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "content"])

    ship(ranges.sparkSession)
    return ranges.mapInArrow(run, schema)


def spark_fields(ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


def _spread(spark: SparkSession, options: dict) -> dict:
    """The options with the number of tasks that keep all cores busy."""
    return {"spread": str(2 * spark.sparkContext.defaultParallelism)} | options


_WARNINGS = "path string, sheet string, code string, row int, col int, cells long, columns array<int>"


def read_warnings(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, sheet, code, ref, cells, columns): what a reader should know of the workbooks at a path, once for each
    sheet and code, with the first place and how many cells and which columns it is about.

    SHARED_STRINGS_MISSING, SST_INDEX_OUT_OF_RANGE, CELL_FORMATS_IGNORED, and DATA_BEYOND_HEADER: values right of the
    last header, which records leave out.
    """
    o = {k.lower(): str(v) for k, v in options.items()}

    def work(f):
        with open_source(f["path"]) as source:
            book = Workbook(source, limits_of(o), told_epoch(o))
            for info in chosen_sheets(book, o):
                bound = bind(book, info, o)
                end, first, count, columns = max(bound.columns, default=-1) + 1, None, 0, set()
                for rows in book.blocks(info, share=(f["share"], f["shares"])):
                    if isinstance(rows, Grid):
                        over = rows.where((rows.column >= end) & (rows.numbers[rows.row] >= bound.first_row))
                        places = zip(over.numbers[over.row].tolist(), over.column.tolist())
                    else:
                        places = ((n, c) for n, cells in rows if n >= bound.first_row for c, _, _ in cells if c >= end)
                    for place in places:
                        first, count = first or place, count + 1
                        columns.add(place[1])
                if count:
                    yield f["path"], info.name, "DATA_BEYOND_HEADER", *first, count, sorted(columns)
                if getattr(book, "formats_ignored", False):
                    yield f["path"], info.name, "CELL_FORMATS_IGNORED", None, None, 0, []
                for w in book.warnings:
                    if w["sheet"] in (None, info.name):
                        from ..functions.cells import parse_ref

                        at = parse_ref(w["ref"]) if w["ref"] else None
                        yield f["path"], info.name, w["code"], *(at or (None, None)), 0, []

    found = each_file(spark, path, _WARNINGS, work, shared=True, options=o)
    once = found.groupBy("path", "sheet", "code").agg(F.min(F.struct("row", "col")).alias("at"), F.sum("cells").alias("cells"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("columns")))).alias("columns"))
    from ..functions.columns import format_ref as ref

    return once.select("path", "sheet", "code", ref(F.col("at.row"), F.col("at.col")).alias("ref"), "cells", "columns")


FEW_FILES = 100


def infer_schema(spark: SparkSession, path: str, **options) -> StructType:
    """The schema of the records at a path: all files' columns in order of first sight, typed by all their cells.

    Files are looked through in tasks, large ones by several; what comes back is a row a column name.
    """
    o = {k.lower(): str(v) for k, v in options.items()} | {"path": path}
    plain = _flag_of(o, "samplerows") or _flag_of(o, "maxrows")

    def work(f):
        kinds: dict[str, set] = {}
        look(f["path"], o, kinds, (f["share"], f["shares"]))
        yield from [(f["n"], k, name, sorted(held)) for k, (name, held) in enumerate(kinds.items())]

    found = each_file(spark, path, "n int, place int, name string, kinds array<string>", work, shared=not plain, options=o)
    if not (files := sized_files(path)):
        raise SheetError("IO_ERROR", f"{path}: no workbooks")
    if len(files) > FEW_FILES:  # else a row a share and column is little enough
        found = found.groupBy("name").agg(F.min(F.struct("n", "place")).alias("at"),
            F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds")).select("at.n", "at.place", "name", "kinds")
    kinds: dict[str, set] = {}
    for r in sorted(found.collect(), key=lambda r: (r["n"], r["place"])):
        kinds.setdefault(r["name"], set()).update(r["kinds"])
    return inferred_schema(kinds, o)


def _flag_of(options: dict, name: str) -> bool:
    return options.get(name) is not None


def cells_of_bytes(books: DataFrame, path: str = "path", content: str = "content", **options) -> DataFrame:
    """The cells (as ``mode=cells`` gives them) of workbooks whose bytes are a column, as ``binaryFile`` reads them."""
    o = {k.lower(): str(v) for k, v in options.items()} | {"mode": "cells", "path": ""}

    def run(batches):
        reader = XlsxReader(o, CELLS)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                with open_source(data.as_py()) as source:
                    book = Workbook(source, reader.limits, told_epoch(o))
                    for info in chosen_sheets(book, o):
                        yield from reader.sheet_batches(book, info, name)

    ship(books.sparkSession)
    return books.select(F.col(path).cast("string"), F.col(content)).mapInArrow(run, CELLS)


class XlsxCells:
    """The table function ``xlsx_cells(content[, options])``: the cells of a workbook's bytes."""

    def eval(self, content: bytes, options: dict | None = None):
        o = {k.lower(): v for k, v in (options or {}).items()} | {"mode": "cells", "path": ""}
        reader = XlsxReader(o, CELLS)
        with open_source(bytes(content)) as source:
            book = Workbook(source, reader.limits, told_epoch(o))
            for info in chosen_sheets(book, o):
                for number, cells in book.rows(info, formulas=True, max_rows=int(o["maxrows"]) if "maxrows" in o else None):
                    for c, cell, xf in cells:
                        v = cell.value
                        yield info.index, info.name, number, c, format_ref(number, c), cell.kind, *(v if cell.kind == k else None for k in "snbde"), cell.formula, xf


def register_table_functions(spark: SparkSession) -> None:
    """Makes ``xlsx_cells`` known to SQL."""
    ship(spark)
    kinds = "sheet_index int, sheet string, row_index int, col_index int, ref string, kind string, s string, n double, b boolean, ts timestamp_ntz, err string, formula string, xf int"
    spark.udtf.register("xlsx_cells", F.udtf(XlsxCells, returnType=kinds))


MOST_RECORD_CELLS = 100_000_000


@dataclass
class RecordSet:
    """Records with what a caller wants to know besides."""

    frame: DataFrame
    headers: list[str]
    truncated: bool
    rows: int


def records(spark: SparkSession, path: str, most_cells: int = MOST_RECORD_CELLS, **options) -> RecordSet:
    """The records at a path with their headers, and whether ``maxRows`` cut any off.

    More than ``most_cells`` fields in all are a LIMIT_EXCEEDED: such a sheet is better read by ``load``.
    """
    most = next((int(v) for k, v in options.items() if k.lower() == "maxrows"), None)
    frame = load(spark, path, **options)
    rows, truncated = frame.count(), False
    if most is not None:  # one row past the limit proves that there is more
        past = {k: v for k, v in options.items() if k.lower() != "maxrows"} | {"maxRows": str(most + 1)}
        truncated = load(spark, path, frame.schema, **past).count() > rows
    if rows * len(frame.columns) > most_cells:
        raise SheetError("LIMIT_EXCEEDED", f"{rows} records of {len(frame.columns)} fields", limit="cells")
    return RecordSet(frame, frame.columns, truncated, rows)


def save(frame: DataFrame, path: str, **options) -> dict:
    """Writes a frame as a workbook, or a folder of them; returns (rows, columns, files, truncated)."""
    register(frame.sparkSession)
    report = f"{shared_folder(frame.sparkSession, 'report')}.json"
    writer = frame.write.format(FORMAT).mode("overwrite").option("reportPath", report)
    for name, value in options.items():
        writer = writer.option(name, value)
    writer.save(path)
    store, inner = filesystem(report)
    with store.open_input_stream(inner) as f:
        done = json.loads(f.read())
    store.delete_file(inner)
    return done


def save_rows(frame: DataFrame, folder: str, header: list[str], cells: Callable[..., list]) -> None:
    """Workbooks of each partition's rows in a folder, written in tasks: ``cells`` makes a sheet's row of a row's values.

    Unlike ``save``, a column's cells may be of several kinds.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, (store, inner) = TaskContext.get(), filesystem(folder)
        rows = (cells(*r) for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        first, files = next(rows, None), 0
        while first is not None or files == context.partitionId() == 0:
            name = f"part-{context.partitionId():05d}-{files}.xlsx"
            ready = f"{inner}/.{name}.{context.taskAttemptId()}.tmp"  # a second attempt replaces the first one's
            with store.open_output_stream(ready) as out:
                book = WorkbookWriter(out.write)
                book.add("Sheet1", chain([header], [first] if first is not None else [], islice(rows, MAX_ROWS - 2)))
                book.close()
            store.move(ready, f"{inner}/{name}")
            first, files = next(rows, None), files + 1
            yield pa.RecordBatch.from_pydict({"name": [name]})

    ship(frame.sparkSession)
    frame.mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def load(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """The workbooks at a path; without a schema, records are typed by a look at all of them, in tasks."""
    register(spark)
    reader = spark.read.format(FORMAT)
    told = {k.lower(): v for k, v in options.items()}
    options = options if "spread" in told else options | _spread(spark, {})
    if schema is None and str(told.get("mode", "object")) == "object":
        schema, options = infer_schema(spark, path, **options), options | {"inferred": str(told.get("inferschema", "true")).lower()}
    for name, value in options.items():
        reader = reader.option(name, value)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def round_trip(frame: DataFrame, read: dict | None = None, **options) -> DataFrame:
    """The frame as it comes back from workbooks, one or more a partition: a sheet ends at 1,048,576 rows."""
    path = f"{scratch(frame.sparkSession)}/books"
    save(frame, path, **{"layout": "folder"} | options)
    return load(frame.sparkSession, path, as_cells(frame.schema), **(read or {}))
