"""``spark.read.format("tabloom.xlsx")`` and ``df.write.format("tabloom.xlsx")``.

Reading: files are split into shares while there are fewer tasks than ``spread``, so that one large sheet is read by
several tasks; no file is opened before a task does.  Rows go out as Arrow batches of bounded size.  Options of a read:

- ``sheet``: a name or an index (0 is the first); ``allSheets`` for every worksheet
- ``mode``: ``object`` (columns named by the header row), ``array`` (row_index, cells) or ``cells``
- ``headerRow``, ``headers`` (JSON list of names), ``headerNaming`` (``unique`` or ``index``), ``dropEmptyHeaders``
- ``inferSchema`` (default true) or else strings.  Inference looks at all rows of all sheets that are
  read, once more than the read itself (``plans.workbooks.load`` does so in tasks); ``sampleRows`` bounds it to
  the first rows of each, and a value that doesn't fit the type inferred from them is an error
  (``TYPE_MISMATCH``), never null
- ``startRow``, ``maxRows``, ``maxColumns``, ``columns`` (JSON list), ``defval``, ``blankRows``
- ``misfits``: ``null`` (the default) or ``error``, for values that a schema that is given has no room for
- ``namesBefore``: name the columns left of the header row's first one too (``__EMPTY``, ``__EMPTY_1``, ...)
- ``errors``: ``text``, ``null`` or ``object``; ``formulas``: ``value`` or ``text``
- ``dates``: ``local`` (the default; wall clock times), ``utc`` (instants, as if cells were in UTC) or ``serial``
- ``pathColumn``: adds ``_path`` and ``_sheet``; ``date1904``: true or false, in place of the workbook's word
- ``maxInflatedBytes``, ``maxTextLength``, ``maxRowChars``, ``maxSharedStringChars``, ``maxEntries``, ``maxXmlDepth``
- ``splitBytes``: the least bytes of a file for each of its tasks; ``spread``: about how many tasks are enough

Writing (overwrite only), ``layout`` ``file`` (the default): every partition packs its rows into a
segment of the one sheet; the commit joins the segments in partition order, so sort the frame
first if order matters.  ``layout`` ``folder``: every partition writes workbooks of its own, of at most
a sheet's rows and about half a GiB of their XML each, into a folder; they are read back in parallel.  Other options: ``sheet``, ``header``
(default true), ``date1904``, ``compressionLevel``, ``overlong``, ``suffix``, ``freezeHeader``, ``autoFilter``,
``zip64``.  Paths may be URIs of any store that pyarrow knows; what is replaced goes when its successor is there.
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import json
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
    InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from ..errors import SheetError
from ..functions.cells import MAX_COLUMNS, MAX_ROWS, column_letters, format_ref, general_text, iso_text, number_text
from .cellxml import rows_xml
from .container import Limits, Packed, PartPacker
from .grid import BOOLEAN, DATE, ERROR, KINDS, NUMBER, TEXT, Grid
from .workbook import Cell, Workbook
from .writer import ZIP64_CELLS, CellWriter, Options, Sheet, Shared, Styles, WorkbookWriter

BATCH_ROWS = 10_000
SPLIT_BYTES, SPREAD, MOST_SHARES = 8 << 20, 64, 16
#: Bytes of a sheet's rows from which on it is written with ZIP64 records, with room for what else a workbook holds.
ZIP64_BYTES = (4 << 30) - (16 << 20)
#: Bytes of a sheet's rows at which a workbook of a folder ends; readers take a GiB of a part unless told otherwise.
FOLDER_BYTES = 1 << 29
CELL = StructType([StructField("kind", StringType()), StructField("s", StringType()), StructField("n", DoubleType()), StructField("b", BooleanType()),
    StructField("ts", TimestampNTZType()), StructField("err", StringType()), StructField("formula", StringType())])
CELLS = StructType([StructField("path", StringType()), StructField("sheet_index", IntegerType()), StructField("sheet", StringType()),
    StructField("row_index", IntegerType()), StructField("col_index", IntegerType()), StructField("ref", StringType()), *CELL.fields,
    StructField("xf", IntegerType())])


def _flag(options: dict, name: str, default: bool = False) -> bool:
    return str(options.get(name, default)).lower() in ("true", "1")


def _number(options: dict, name: str, default: int | None) -> int | None:
    value = options.get(name)
    return default if value is None else int(value)


def filesystem(path: str):
    """The pyarrow file system of a path or URI, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def find_files(path: str) -> list[str]:
    """Workbooks at a path: a file, a folder's files, or a pattern's; other stores by their URI."""
    return [f for f, _ in sized_files(path)]


def sized_files(path: str) -> list[tuple[str, int]]:
    """The same with their sizes; -1 for what isn't there."""
    from pyarrow import fs

    store, inner = filesystem(path)
    scheme = f"{path.partition('://')[0]}://" if "://" in path and not path.startswith("file:") else ""
    info = store.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        hidden = lambda f: any(p.startswith((".", "_", "~")) for p in f.path[len(info.path.rstrip("/")) :].split("/"))
        wanted = lambda f: f.base_name.lower().endswith((".xlsx", ".xlsm")) and not hidden(f)
        return sorted((scheme + f.path, f.size) for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and wanted(f))
    if not scheme and info.type == fs.FileType.NotFound and (found := sorted(glob.glob(inner))):
        return [(f, os.path.getsize(f)) for f in found]
    return [(path if scheme else inner, info.size if info.type == fs.FileType.File else -1)]


class _Guarded:
    """A file whose failures to read are IO_ERRORs."""

    def __init__(self, path: str, file):
        self.path, self.file = path, file

    def _do(self, act, *a):
        try:
            return act(*a)
        except ValueError as e:
            if getattr(self.file, "closed", False):
                raise SheetError("ABORTED", f"{self.path} is closed") from e
            raise
        except OSError as e:
            raise SheetError("IO_ERROR", f"{self.path}: {e}") from e

    def read(self, *a):
        return self._do(self.file.read, *a)

    def seek(self, *a):
        return self._do(self.file.seek, *a)

    def tell(self):
        return self._do(self.file.tell)

    def close(self):
        self.file.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def open_source(path: str | bytes):
    """A seekable binary file of a path, or of a workbook's bytes; what can't be opened or read is an IO_ERROR."""
    if isinstance(path, bytes | bytearray | memoryview):
        import io

        return _Guarded("the bytes", io.BytesIO(path))
    try:
        if "://" in path and not path.startswith("file:"):
            store, inner = filesystem(path)
            return _Guarded(path, store.open_input_file(inner))
        return _Guarded(path, open(path if not path.startswith("file:") else "/" + path[5:].lstrip("/"), "rb"))
    except OSError as e:
        raise SheetError("IO_ERROR", f"{path}: {e}") from e


def limits_of(options: dict) -> Limits:
    base = Limits()
    pick = {"inflated_bytes": "maxInflatedBytes", "shared_chars": "maxSharedStringChars", "entries": "maxEntries", "depth": "maxXmlDepth",
        "text": "maxTextLength", "row_chars": "maxRowChars", "columns": "maxColumns"}
    return Limits(**{k: _number(options, name.lower(), getattr(base, k)) for k, name in pick.items()})


def cell_text(cell: Cell) -> str:
    """A cell as text, the way a header or a string column shows it."""
    if cell.kind == "n":
        return number_text(cell.value)
    if cell.kind == "b":
        return "TRUE" if cell.value else "FALSE"
    return iso_text(cell.value) if cell.kind == "d" else "" if cell.value is None else str(cell.value)


def unique_names(raw: Sequence[str | None], naming: str = "unique") -> list[str]:
    """Header texts made unique: ``_1``, ``_2`` behind repeated ones, ``__EMPTY`` for missing ones."""
    if naming == "index":
        return [str(k) for k in range(len(raw))]
    out: list[str] = []
    taken, tried = set(), {}
    for text in raw:
        base = text if text else "__EMPTY"
        name, k = base, tried.get(base, 0)
        while name in taken:
            k += 1
            name = f"{base}_{k}"
        tried[base] = k
        taken.add(name)
        out.append(name)
    return out


@dataclass
class Bound:
    """A sheet's columns, and where its records begin."""

    names: list[str]
    columns: list[int]
    first_row: int


def header_text(cell: Cell | None) -> str | None:
    if cell is None:
        return None
    return general_text(cell.value) if cell.kind == "n" else cell_text(cell)


def bind(book: Workbook, info, options: dict) -> Bound:
    """Column names by the options or the header row: the first row with a value, if none is told."""
    naming, start = options.get("headernaming", "unique"), _number(options, "startrow", 1)
    told, row = options.get("headers"), _number(options, "headerrow", None)
    most = _number(options, "maxcolumns", MAX_COLUMNS)
    if told:
        names = json.loads(told)
        last = {n: k for k, n in enumerate(names)}  # a repeated name keeps the later column
        kept = [(n, k) for k, n in enumerate(names) if last[n] == k]
        return Bound([n for n, _ in kept], [k for _, k in kept], max(start, (row or 0) + 1))
    for number, cells in book.rows(info, start_row=row or start, max_rows=1, max_columns=most):
        if row and number != row:
            break
        by = {c: cell for c, cell, _ in cells}
        first = min(book.first_column(info), min(by))
        columns = list(range(first, max(by) + 1))
        raw = [header_text(by.get(c)) for c in columns]
        names = [str(c) for c in columns] if naming == "index" else unique_names(raw, naming)
        if _flag(options, "namesbefore") and first:  # named after the others, and in front of them
            more = [str(c) for c in range(first)] if naming == "index" else unique_names([*names, *[None] * first])[len(names) :]
            names, columns, raw = [*more, *names], [*range(first), *columns], [*[None] * first, *raw]
        if _flag(options, "dropemptyheaders"):
            kept = [k for k, r in enumerate(raw) if r]
            names, columns = [names[k] for k in kept], [columns[k] for k in kept]
        return Bound(names, columns, max(start, number + 1))
    return Bound([], [], max(start, (row or 0) + 1))


_TYPES = {"n": DoubleType(), "b": BooleanType(), "d": TimestampNTZType(), "s": StringType(), "e": StringType()}


def infer(book: Workbook, info, bound: Bound, options: dict, kinds: dict[str, set], share: tuple[int, int] = (0, 1)) -> None:
    """Adds to ``kinds`` the kinds of cells in each column, by its name: of all rows that are read, or a sample."""
    names = dict(zip(bound.columns, bound.names))
    for name in bound.names:
        kinds.setdefault(name, set())
    no_errors, common = options.get("errors") == "null", _reading(options)

    def add(column: int, kind: str) -> None:
        if column in names and not (kind == "e" and no_errors):
            kinds[names[column]].add(kind)

    bounds = [n for n in (_number(options, "samplerows", None), _number(options, "maxrows", None)) if n is not None]
    if bounds:
        for _, cells in book.rows(info, start_row=bound.first_row, max_rows=min(bounds), **common):
            for c, cell, _ in cells:
                add(c, "s" if cell.formula is not None else cell.kind)
        return
    for rows in book.blocks(info, share=share, kinds_only=True, **common):
        if isinstance(rows, Grid):
            late = rows.numbers[rows.row] >= bound.first_row
            for key in np.unique(rows.column[late] * 8 + rows.kind[late]).tolist():
                add(key // 8, KINDS[key % 8])
        else:
            for c, kind in {(c, "s" if cell.formula is not None else cell.kind) for number, cells in rows if number >= bound.first_row for c, cell, _ in cells}:
                add(c, kind)


def _reading(options: dict) -> dict:
    """How cells are read, as ``Workbook.rows`` and ``blocks`` are told."""
    return {"formulas": options.get("formulas") == "text" or options.get("mode") == "cells", "serials": options.get("dates") == "serial",
        "max_columns": _number(options, "maxcolumns", MAX_COLUMNS)}


def agreed(kinds: set, options: dict | None = None) -> DataType:
    """The type that all values of a column agree on, else text."""
    options = options or {}
    if "e" in kinds and options.get("errors") == "object":
        return CELL
    if kinds == {"d"} and options.get("dates") == "utc":
        return TimestampType()
    return _TYPES[next(iter(kinds))] if len(kinds) == 1 else StringType()


def told_epoch(options: dict) -> bool | None:
    return {"true": True, "false": False}.get(str(options.get("date1904")).lower())


def chosen_sheets(book: Workbook, options: dict) -> list:
    """The worksheets that are read; ``cells`` reads all unless told one."""
    if _flag(options, "allsheets") or options.get("mode") == "cells" and options.get("sheet") is None:
        return [s for s in book.sheets if s.kind == "worksheet"]
    return [pick_sheet(book, options)]


def split_files(files: list[tuple[str, int]], options: dict) -> list[tuple[str, int, int]]:
    """(file, share, shares) for each task: files are split while there are fewer than about ``spread`` tasks.

    Every share inflates the sheet up to its end, so more than MOST_SHARES of a file gain nothing.  One task reads a
    file whose rows must be counted from the first on.
    """
    one = _number(options, "maxrows", None) is not None or _flag(options, "blankrows")
    spread, total = _number(options, "spread", SPREAD), sum(max(0, size) for _, size in files)
    least = max(_number(options, "splitbytes", SPLIT_BYTES), total // max(1, spread))
    shares = [(f, 1 if one else max(1, min(MOST_SHARES, -(-size // least)))) for f, size in files]
    return [(f, k, n) for f, n in shares for k in range(n)]


@dataclass
class SheetPartition(InputPartition):
    path: str
    share: int = 0
    shares: int = 1


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType, inferred: bool = False):
        self.options, self.schema = options, schema
        self.inferred = inferred or _flag(options, "inferred")
        self.mode, self.limits = options.get("mode", "object"), limits_of(options)
        self.low, self.high, self.names = 1, None, None

    def pushFilters(self, filters: list[Filter]):
        """Row ranges and sheet names cut off what is read, where columns are those of this module; Spark applies
        the filters once more.  In records, a column of such a name is the workbook's own."""
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") and self.mode in ("cells", "array") else ""
            if column == "row_index" and isinstance(getattr(f, "value", None), int):
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    top = f.value - isinstance(f, LessThan)
                    self.high = top if self.high is None else min(self.high, top)
            elif column == "sheet" and self.mode == "cells" and isinstance(f, EqualTo):
                self.names = {f.value} if self.names is None else self.names & {f.value}
            yield f

    def partitions(self) -> Sequence[SheetPartition]:
        return [SheetPartition(*p) for p in split_files(sized_files(self.options["path"]), self.options)] or [SheetPartition("")]

    def read(self, partition: SheetPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with open_source(partition.path) as source:
            book = Workbook(source, self.limits, told_epoch(self.options))
            for info in chosen_sheets(book, self.options):
                if self.names is None or info.name in self.names:
                    yield from self.sheet_batches(book, info, partition.path, (partition.share, partition.shares))

    def sheet_batches(self, book: Workbook, info, path: str, share: tuple[int, int] = (0, 1)) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        o, arrow = self.options, to_arrow_schema(self.schema)
        one_by_one = _number(o, "maxrows", None) is not None or _flag(o, "blankrows")
        start = max(self.low, _number(o, "startrow", 1))
        if self.mode == "cells":
            of_rows, of_grid, first = self._cells, self._grid_cells, start
        elif self.mode == "array":
            of_rows, of_grid, first = self._arrays, self._grid_arrays, start
        else:
            bound = bind(book, info, o)
            made = Records(self, bound, arrow, path, info)
            of_rows, of_grid, first = made.rows, made.grid, bound.first_row
        if one_by_one:
            rows = book.rows(info, start_row=first, max_rows=_number(o, "maxrows", None), **_reading(o))
            yield from _batches(of_rows(rows, first, path, info), arrow)
            return
        for rows in book.blocks(info, share=share, **_reading(o)):
            if isinstance(rows, Grid):
                if o.get("errors") == "null" and self.mode == "object":
                    rows = rows.where(rows.kind != ERROR)
                if len(rows.row) and rows.numbers.max() >= first:
                    yield from of_grid(rows, first, path, info, arrow)
                if self.high is not None and len(rows.numbers) and rows.numbers.min() > self.high:
                    return
            else:
                yield from _batches(of_rows((r for r in rows if r[0] >= first and r[1]), first, path, info), arrow)

    # Rows one by one.

    def _cells(self, rows, first, path, info) -> Iterator[tuple]:
        for number, cells in rows:
            if self.high is not None and number > self.high:
                continue
            for c, cell, xf in cells:
                yield (path, info.index, info.name, number, c, format_ref(number, c), *_struct(cell), xf)

    def _arrays(self, rows, first, path, info) -> Iterator[tuple]:
        before, blank = first - 1, _flag(self.options, "blankrows")
        for number, cells in rows:
            if self.high is not None and number > self.high:
                continue
            if blank:
                yield from ((k, []) for k in range(before + 1, number))
            before, dense = number, [None] * (cells[-1][0] + 1)
            for c, cell, _ in cells:
                dense[c] = dict(zip(CELL.names, _struct(cell)))
            yield number, dense

    # Grids.

    def _kept(self, grid: Grid, first: int) -> Grid:
        number = grid.numbers[grid.row]
        return grid.where((number >= first) & (number <= (self.high or MAX_ROWS)))

    def _grid_cells(self, grid, first, path, info, arrow) -> Iterator[pa.RecordBatch]:
        grid = self._kept(grid, first)
        n, numbers = len(grid.row), grid.numbers[grid.row]
        if not n:
            return
        refs = pc.binary_join_element_wise(_letters().take(pa.array(grid.column)), pa.array(numbers).cast(pa.string()), "")
        columns = [pa.repeat(path, n), pa.repeat(info.index, n), pa.repeat(info.name, n), pa.array(numbers), pa.array(grid.column), refs,
            *grid_structs(grid), pa.array(grid.style)]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def _grid_arrays(self, grid, first, path, info, arrow) -> Iterator[pa.RecordBatch]:
        grid = self._kept(grid, first)
        if not len(grid.row):
            return
        rows, begins = np.unique(grid.row, return_index=True)
        last = np.append(begins[1:], len(grid.row)) - 1
        ends = np.cumsum(grid.column[last] + 1)
        at = (ends - grid.column[last] - 1)[np.searchsorted(rows, grid.row)] + grid.column
        places = np.full(int(ends[-1]), -1, np.int64)
        places[at] = np.arange(len(at))
        kind = arrow.field("cells").type
        dense = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(grid_structs(grid), kind.value_type)], fields=list(kind.value_type))
        values = dense.take(pa.array(places, mask=places < 0))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values, type=kind)
        yield pa.RecordBatch.from_arrays([pa.array(grid.numbers[rows]).cast(arrow.field("row_index").type), lists], schema=arrow)


@cache
def _letters() -> pa.Array:
    return pa.array([column_letters(k) for k in range(MAX_COLUMNS)])


def grid_structs(grid: Grid) -> list[pa.Array]:
    """The fields of CELL for a grid's cells."""
    is_ = lambda k: grid.kind == k
    text = lambda k: grid.texts.take(pa.array(grid.text_at, mask=~is_(k))) if is_(k).any() else pa.nulls(len(grid.row), pa.string())
    return [
        pa.array(KINDS).take(pa.array(grid.kind)), text(TEXT), pa.array(grid.number, mask=~is_(NUMBER)), pa.array(grid.number != 0, mask=~is_(BOOLEAN)),
        pa.array(grid.micros, pa.timestamp("us"), mask=~is_(DATE)), text(ERROR), pa.nulls(len(grid.row), pa.string()),
    ]


class Records:
    """A sheet's rows as records of a schema."""

    def __init__(self, reader: XlsxReader, bound: Bound, arrow: pa.Schema, path: str, info):
        o, fields = reader.options, reader.schema.fields
        self.extra = (path, info.name) if _flag(o, "pathcolumn") else ()
        width, place = len(fields) - len(self.extra), dict(zip(bound.names, bound.columns))
        self.wanted = [(place.get(f.name), f.dataType) for f in fields[:width]]
        default = o.get("defval")
        self.empty = [None if default is None else _typed(Cell("s", default), t) for _, t in self.wanted]
        self.inferred, self.arrow, self.where = reader.inferred, arrow, f"{path}: {info.name}"
        self.strict = reader.inferred or o.get("misfits") == "error"
        self.no_errors, self.blank = o.get("errors") == "null", _flag(o, "blankrows")

    def misfit(self, number: int, column: int, kind: DataType) -> SheetError:
        how = "the inferred" if self.inferred else "a column of type"
        return SheetError("TYPE_MISMATCH",
            f"{self.where}!{format_ref(number, column)} doesn't fit {how} {kind.typeName()}; give another schema, a larger sampleRows or inferSchema=false")

    def rows(self, rows, first, path, info) -> Iterator[tuple]:
        spots = {c: (k, t, _PLAIN.get(t.typeName())) for k, (c, t) in enumerate(self.wanted) if c is not None}
        before = first - 1
        for number, cells in rows:
            if self.no_errors:
                cells = [c for c in cells if c[1].kind != "e"]
                if not cells:
                    continue
            if self.blank:
                yield from ((*self.empty, *self.extra) for _ in range(before + 1, number))
            before, out = number, list(self.empty)
            for c, cell, _ in cells:
                if (spot := spots.get(c)) is not None:
                    k, kind, plain = spot
                    if cell.kind == plain and cell.formula is None:
                        out[k] = cell.value
                    elif self.inferred and plain not in (None, "s"):
                        raise self.misfit(number, c, kind)
                    else:
                        out[k] = _typed(cell, kind)
                        if out[k] is None and self.strict:
                            raise self.misfit(number, c, kind)
            yield (*out, *self.extra)

    def grid(self, grid: Grid, first, path, info, arrow) -> Iterator[pa.RecordBatch]:
        grid = grid.where(grid.numbers[grid.row] >= first)
        kept = np.zeros(len(grid.numbers), bool)
        kept[grid.row] = True
        n = int(kept.sum())
        if not n:
            return
        row = (np.cumsum(kept) - 1)[grid.row]
        order = np.argsort(grid.column, kind="stable")
        sorted_ = grid.column[order]
        columns = []
        for (c, kind), field, empty in zip(self.wanted, arrow, self.empty):
            if c is None:
                columns.append(pa.nulls(n, field.type) if empty is None else pa.repeat(pa.scalar(empty, field.type), n))
                continue
            cells = order[np.searchsorted(sorted_, c) : np.searchsorted(sorted_, c, "right")]
            made = self._column(grid, cells, row[cells], n, kind, field.type)
            columns.append(made if empty is None or not made.null_count else made.fill_null(pa.scalar(empty, field.type)))
        columns += [pa.repeat(v, n) for v in self.extra]
        yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    def _column(self, grid: Grid, cells: np.ndarray, rows: np.ndarray, n: int, kind: DataType, field: pa.DataType) -> pa.Array:
        name, kinds = kind.typeName(), grid.kind[cells]
        plain = {"string": TEXT, "double": NUMBER, "boolean": BOOLEAN, "timestamp_ntz": DATE, "timestamp": DATE, "long": NUMBER, "integer": NUMBER}.get(name)
        fits = kinds == plain
        if self.inferred and name in _PLAIN and name != "string" and not fits.all():
            k = cells[np.flatnonzero(~fits)[0]]
            raise self.misfit(int(grid.numbers[grid.row[k]]), int(grid.column[k]), kind)
        if name in ("long", "integer"):
            x = grid.number[cells]
            fits &= (x == np.floor(x)) & (np.abs(x) < 2.0 ** (31 if name == "integer" else 53))
        have, at = np.zeros(n, bool), rows[fits]
        have[at] = True
        if plain == TEXT:
            places = np.zeros(n, np.int64)
            places[at] = grid.text_at[cells[fits]]
            out = grid.texts.take(pa.array(places, mask=~have)) if have.any() else pa.nulls(n, pa.string())
        else:
            source = grid.micros if plain == DATE else grid.number
            values = np.zeros(n, source.dtype)
            values[at] = source[cells[fits]]
            if plain == BOOLEAN:
                values = values != 0
            elif name in ("long", "integer"):
                values = values.astype(np.int64)
            out = pa.array(values, mask=~have) if plain else pa.nulls(n, field)
        if plain == DATE:
            out = out.cast(pa.timestamp("us")).cast(field) if field.tz is None else pc.assume_timezone(out.cast(pa.timestamp("us")), "UTC").cast(field)
        out = out.cast(field)
        if fits.all():
            return out
        rest, values = cells[~fits], out.to_pylist()
        for at, cell, k in zip(rest.tolist(), grid_cells(grid, rest), rows[~fits].tolist()):
            values[k] = _typed(cell, kind)
            if values[k] is None and self.strict:
                raise self.misfit(int(grid.numbers[grid.row[at]]), int(grid.column[at]), kind)
        return pa.array(values, field)


def grid_cells(grid: Grid, which: np.ndarray) -> list[Cell]:
    """Some of a grid's cells, one by one."""
    out = []
    for k in which.tolist():
        kind = grid.kind[k]
        if kind == NUMBER:
            value = float(grid.number[k])
        elif kind == BOOLEAN:
            value = bool(grid.number[k])
        elif kind == DATE:
            value = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(grid.micros[k]))
        else:
            value = grid.texts[int(grid.text_at[k])].as_py()
        out.append(Cell(KINDS[kind], value))
    return out


def pick_sheet(book: Workbook, options: dict):
    which = options.get("sheet", "0")
    try:
        return book.sheet(which)
    except SheetError:
        if which.isdigit():
            return book.sheet(int(which))
        raise


#: The kind of cell whose value a column of the type takes as it is.
_PLAIN = {"string": "s", "double": "n", "boolean": "b", "timestamp_ntz": "d"}
_WHOLE = {"byte": 2**7, "short": 2**15, "integer": 2**31, "long": 2**63}


def _struct(cell: Cell) -> tuple:
    k, v = cell.kind, cell.value
    return k, v if k == "s" else None, v if k == "n" else None, v if k == "b" else None, v if k == "d" else None, v if k == "e" else None, cell.formula


def _typed(cell: Cell, kind):
    """A cell's value as a column's type; null where it has none."""
    if cell.formula is not None:
        cell = Cell("s", "=" + cell.formula)
    v, name = cell.value, kind.typeName()
    if isinstance(kind, StringType):
        return cell_text(cell)
    if isinstance(kind, TimestampNTZType):
        return v if cell.kind == "d" else None
    if isinstance(kind, TimestampType):
        return v.replace(tzinfo=dt.UTC) if cell.kind == "d" else None
    if name == "date":
        return v.date() if cell.kind == "d" else None
    if isinstance(kind, BooleanType):
        return v if cell.kind == "b" else None
    if isinstance(kind, StructType):
        return dict(zip(CELL.names, _struct(cell)))
    if isinstance(kind, DecimalType):
        return _decimal(cell, kind)
    if cell.kind not in ("n", "b"):
        try:
            v = float(v) if cell.kind == "s" else None
        except ValueError:
            v = None
    if v is None:
        return None
    if name in _WHOLE:
        return int(v) if float(v).is_integer() and -_WHOLE[name] <= v < _WHOLE[name] else None
    return float(v) if name in ("float", "double") else None


def _decimal(cell: Cell, kind: DecimalType) -> decimal.Decimal | None:
    """A number or a number's text as a decimal, rounded to the column's places; null if it is too large."""
    if cell.kind not in ("n", "s"):
        return None
    try:
        d = decimal.Decimal(repr(cell.value) if cell.kind == "n" else cell.value.strip())
        d = d.quantize(decimal.Decimal(1).scaleb(-kind.scale), decimal.ROUND_HALF_UP, decimal.Context(prec=kind.precision))
    except decimal.InvalidOperation:
        return None
    return d if d.is_finite() else None


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH_ROWS:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), schema)], schema=schema)


@dataclass
class Segment(WriterCommitMessage):
    partition: int
    path: str
    packed: int
    size: int
    crc: int
    rows: int
    truncated: int


class XlsxWriter(DataSourceArrowWriter):
    """Partitions write packed row segments beside the target; the commit joins them into one file."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        store, self.path = filesystem(options["path"])
        for f in schema.fields:
            if isinstance(f.dataType, ArrayType | StructType) or f.dataType.typeName() in ("map", "binary", "variant"):
                raise SheetError("WRITER_STATE", f"a cell can't hold the {f.dataType.typeName()} of {f.name}")
        if len(schema.fields) > MAX_COLUMNS:
            raise SheetError("ROW_OUT_OF_RANGE", f"a row of {len(schema.fields)} cells")
        folder, _, name = self.path.rstrip("/").rpartition("/")
        self.path = self.path.rstrip("/")
        self.folder = f"{folder or '.'}/.{name}-{uuid.uuid4().hex[:8]}"
        store.create_dir(self.folder, recursive=True)

    def _store(self):
        return filesystem(self.options["path"])[0]

    def _options(self) -> Options:
        o = self.options
        return Options(d1904=_flag(o, "date1904"), level=_number(o, "compressionlevel", 1), overlong=o.get("overlong", "truncate"),
            suffix=o.get("suffix", ""), zip64=_flag(o, "zip64"))

    def _sheet(self) -> Sheet:
        o = self.options
        return Sheet(o.get("sheet", "Sheet1"), freeze=(1, 0) if _flag(o, "freezeheader") else None, auto_filter=_flag(o, "autofilter"))

    def _header(self, made: Options) -> list[tuple[bytes, int]]:
        return [(CellWriter(made).row(self.schema.names, None).encode(), 1)] if _flag(self.options, "header", True) else []

    def _folder_part(self, batches: Iterator[pa.RecordBatch]) -> Segment:
        """Whole workbooks of this partition's rows, under names that a second attempt doesn't share."""
        from pyspark import TaskContext

        context, made, store = TaskContext.get(), self._options(), self._store()
        header = self._header(made)
        room = _number(self.options, "maxrows", MAX_ROWS) - len(header)
        files, total, truncated, size = 0, 0, 0, 0
        stem = f"{self.folder}/{context.partitionId()}-{context.taskAttemptId()}"
        rest = (b for b in batches if b.num_rows)
        held = next(rest, None)

        def up_to(most: int) -> Iterator[pa.RecordBatch]:
            nonlocal held
            while held is not None and most and size < FOLDER_BYTES:
                part = held.slice(0, most)
                most -= part.num_rows
                held = held.slice(part.num_rows) if part.num_rows < held.num_rows else next(rest, None)
                yield part

        def counted(pieces: Iterator[tuple[bytes, int]]) -> Iterator[tuple[bytes, int]]:
            nonlocal size
            for text, rows in pieces:
                size += len(text)
                yield text, rows

        while held is not None or files == 0 and context.partitionId() == 0:
            with store.open_output_stream(f"{stem}-{files}") as out:
                book = WorkbookWriter(out.write, made)
                style = _date_style(book.styles, made)
                size = 0
                done = book.add_xml(self._sheet(), (p for some in (header, counted(rows_xml(up_to(room), book.cells, style))) for p in some), len(self.schema))
                total += done["rows"] - len(header)
                truncated += book.close()["truncated"]
            files += 1
        return Segment(context.partitionId(), stem, files, 0, 0, total, truncated)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Segment:
        from pyspark import TaskContext

        if self.options.get("layout") == "folder":
            return self._folder_part(iterator)
        made, n, styles = self._options(), 0, Styles()
        style = _date_style(styles, made)
        cells = CellWriter(made, styles, Shared("inline"))
        context = TaskContext.get()
        part, path = context.partitionId(), f"{self.folder}/{context.partitionId()}-{context.taskAttemptId()}"
        with self._store().open_output_stream(path) as out:
            packer = PartPacker(out.write, made.level)
            for text, rows in rows_xml(iterator, cells, style):
                packer.add(text)
                n += rows
            done = packer.flush(False)
        return Segment(part, path, done.packed, done.size, done.crc, n, cells.truncated)

    def _replace(self, ready: str) -> None:
        """Puts what is ready in the target's place; what was there goes afterwards, and comes back if that fails."""
        from pyarrow import fs

        store = self._store()
        old, new = store.get_file_info([self.path, ready])
        if old.type == new.type == fs.FileType.File or old.type == fs.FileType.NotFound:
            store.move(ready, self.path)
            return
        aside = f"{self.folder}-old"
        store.move(self.path, aside)
        try:
            store.move(ready, self.path)
        except OSError:
            store.move(aside, self.path)
            raise
        (store.delete_dir if old.type == fs.FileType.Directory else store.delete_file)(aside)

    def commit(self, messages: list[Segment]) -> None:
        parts, made, store = sorted((m for m in messages if m is not None), key=lambda m: m.partition), self._options(), self._store()
        header = self._header(made)
        if self.options.get("layout") == "folder":
            ready = f"{self.folder}/ready"
            store.create_dir(ready)
            for m in parts:
                for k in range(m.packed):
                    store.move(f"{m.path}-{k}", f"{ready}/part-{m.partition:05d}-{k}.xlsx")
        else:
            ready = f"{self.folder}/workbook"
            title: list[bytes] = []
            packer = PartPacker(title.append, made.level)
            for text, _ in header:
                packer.add(text)
            first = packer.flush(False)
            if self.options.get("zip64") is None:
                made.zip64 = _needs_zip64([first, *parts], len(self.schema))
            with store.open_output_stream(ready) as out:
                book = WorkbookWriter(out.write, made)
                _date_style(book.styles, made)
                segments = [(first, title), *((Packed(m.crc, m.packed, m.size), _chunks(store, m.path)) for m in parts)]
                book.add_segments(self._sheet(), segments, sum(m.rows for m in parts) + len(header), len(self.schema))
                book.close()
        self._replace(ready)
        store.delete_dir(self.folder)
        if self.options.get("reportpath"):
            store, report = filesystem(self.options["reportpath"])
            files = sum(m.packed for m in parts) if self.options.get("layout") == "folder" else 1
            with store.open_output_stream(report) as out:
                out.write(json.dumps({"rows": sum(m.rows for m in parts), "columns": len(self.schema), "files": files,
                    "truncated": sum(m.truncated for m in parts)}).encode())

    def abort(self, messages: list[Segment]) -> None:
        from pyarrow import fs

        store = self._store()
        if store.get_file_info(self.folder).type == fs.FileType.Directory:
            store.delete_dir(self.folder)


def _needs_zip64(segments: Sequence[Packed | Segment], width: int) -> bool:
    """Whether a sheet of these segments has many cells, or comes near the 4 GiB that end a plain archive."""
    size, packed = sum(m.size for m in segments), sum(m.packed for m in segments)
    return sum(getattr(m, "rows", 0) for m in segments) * width > ZIP64_CELLS or max(size, packed) > ZIP64_BYTES


def _date_style(styles: Styles, options: Options) -> int:
    """The one style that segments use stands first in every writer's table."""
    from .writer import Style

    return styles.id(Style(format=options.date_format))


def _chunks(store, path: str) -> Iterator[bytes]:
    with store.open_input_stream(path) as f:
        while chunk := f.read(1 << 20):
            yield chunk


LOG = ".tabloom-seen"


class XlsxStreamReader(DataSourceStreamReader):
    """Follows a folder: every workbook that appears in it is read once, whatever its time or name.

    A log numbers the files in the order in which they were seen: a JSON list for each time that new ones were
    found.  An offset is the number of lists.  The log lies in the folder, or where ``logPath`` says.
    """

    def __init__(self, options: dict, schema: StructType, inferred: bool = False):
        self.options, self.schema, self.inferred = options, schema, inferred
        self.held: list[list[str]] = []  # lists that have been read; they never change

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": []}  # tasks have no use for them

    def _log(self):
        store, inner = filesystem(self.options.get("logpath") or f"{self.options['path'].rstrip('/')}/{LOG}")
        store.create_dir(inner, recursive=True)
        return store, inner

    def _lists(self) -> list[list[str]]:
        from pyarrow import fs

        store, inner = self._log()
        names = sorted(f.path for f in store.get_file_info(fs.FileSelector(inner)) if f.base_name.endswith(".json"))
        for name in names[len(self.held) :]:
            with store.open_input_stream(name) as f:
                self.held.append(json.loads(f.read()))
        return self.held

    def initialOffset(self) -> dict:
        return {"lists": 0}

    def latestOffset(self) -> dict:
        lists = self._lists()
        new = sorted({f for f, size in sized_files(self.options["path"]) if size >= 0}.difference(*lists))
        if new:
            store, inner = self._log()
            name = f"{inner}/{len(lists):09d}.json"
            temporary = f"{name}.{uuid.uuid4().hex[:8]}.tmp"
            with store.open_output_stream(temporary) as f:
                f.write(json.dumps(new).encode())
            store.move(temporary, name)
        return {"lists": len(lists) + bool(new)}

    def partitions(self, start: dict, end: dict) -> Sequence[SheetPartition]:
        files = {f for some in self._lists()[start["lists"] : end["lists"]] for f in some}
        sizes = dict(sized_files(self.options["path"]))
        return [SheetPartition(*p) for p in split_files([(f, sizes.get(f, 0)) for f in sorted(files)], self.options)]

    def read(self, partition: SheetPartition) -> Iterator[pa.RecordBatch]:
        return XlsxReader(self.options, self.schema, self.inferred).read(partition)


def look(path: str, options: dict, kinds: dict[str, set], share: tuple[int, int] = (0, 1)) -> None:
    """Adds the columns of a workbook's sheets that are read, and the kinds of their cells, to ``kinds``."""
    with open_source(path) as source:
        book = Workbook(source, limits_of(options), told_epoch(options))
        for info in chosen_sheets(book, options):
            bound = bind(book, info, options)
            if _flag(options, "inferschema", True):
                infer(book, info, bound, options, kinds, share)
            else:
                for name in bound.names:
                    kinds.setdefault(name, set())


def inferred_schema(kinds: dict[str, set], options: dict) -> StructType:
    """The columns in order of first sight, typed by what they hold."""
    typed = _flag(options, "inferschema", True)
    text = CELL if not typed and options.get("cellmode") == "struct" else StringType()
    out = StructType([StructField(n, agreed(k, options) if typed else text) for n, k in kinds.items()])
    if options.get("columns"):
        out = StructType([out[c] for c in json.loads(options["columns"])])
    extra = [StructField("_path", StringType()), StructField("_sheet", StringType())] if _flag(options, "pathcolumn") else []
    return StructType([*out.fields, *extra])


class XlsxDataSource(DataSource):
    inferred = False  # Spark asks for the schema, if none is given, before it asks for a reader

    @classmethod
    def name(cls) -> str:
        return "tabloom.xlsx"

    def _options(self) -> dict:
        options = {k.lower(): v for k, v in self.options.items()}
        if "path" not in options:
            raise SheetError("IO_ERROR", "no path is given")
        return options

    def schema(self) -> StructType:
        o = self._options()
        mode = o.get("mode", "object")
        if mode == "cells":
            return CELLS
        if mode == "array":
            return StructType([StructField("row_index", IntegerType()), StructField("cells", ArrayType(CELL))])
        self.inferred = _flag(o, "inferschema", True)
        kinds: dict[str, set] = {}
        if not (files := find_files(o["path"])):
            raise SheetError("IO_ERROR", f"{o['path']}: no workbooks")
        for path in files:
            look(path, o, kinds)
        return inferred_schema(kinds, o)

    def reader(self, schema: StructType) -> XlsxReader:
        return XlsxReader(self._options(), schema, self.inferred)

    def writer(self, schema: StructType, overwrite: bool) -> XlsxWriter:
        o = self._options()
        store, inner = filesystem(o["path"])
        if not overwrite and store.get_file_info(inner).type.name != "NotFound":
            raise SheetError("WRITER_STATE", "a workbook is replaced as a whole: use mode('overwrite')")
        return XlsxWriter(o, schema)

    def streamReader(self, schema: StructType) -> XlsxStreamReader:
        return XlsxStreamReader(self._options(), schema, self.inferred)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and the package to its workers."""
    from ..cluster import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # row ranges reach the reader
    spark.dataSource.register(XlsxDataSource)
