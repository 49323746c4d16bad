"""Arrow columns to the XML of cells, by array operations; only texts with something to escape go one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..errors import SheetError
from ..functions.cells import DAY_MS, LAST_SERIAL_1900, MAX_CELL_CHARS, OFFSET_1904, encode_text, iso_text, limit_text, number_text, units
from .grid import EPOCH_DAYS
from .writer import BIG, CellWriter

PIECE = 32 << 20
_BLANK = "<c/>"
_ESCAPES = r"[&<>\x00-\x08\x0b-\x1f]|\x{FFFE}|\x{FFFF}|_x[0-9A-Fa-f]{4}_"


def _wrapped(before: str, text: pa.Array, after: str) -> pa.Array:
    return pc.binary_join_element_wise(before, text, after, "")


def number_texts(x: np.ndarray) -> pa.Array:
    """``cells.number_text`` of finite numbers."""
    whole = (x == np.floor(x)) & (np.abs(x) < BIG)
    if whole.all():
        return pa.array(x.astype(np.int64)).cast(pa.string())
    out = np.empty(len(x), object)
    out[whole] = pa.array(x[whole].astype(np.int64)).cast(pa.string()).to_pylist()
    rest = x[~whole].tolist()
    out[~whole] = [number_text(v) if "e" in t or t.endswith(".0") else t for v, t in zip(rest, map(repr, rest))]
    return pa.array(out, pa.string())


def _numbers(column: pa.Array) -> pa.Array:
    x = column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    finite = np.isfinite(x)
    out = _wrapped("<c><v>", number_texts(np.where(finite, x, 0.0)), "</v></c>")
    return out if finite.all() else pc.if_else(pa.array(finite), out, '<c t="e"><v>#NUM!</v></c>')


def _moments(column: pa.Array, cells: CellWriter, style: int) -> pa.Array:
    if pa.types.is_timestamp(column.type) and column.type.tz:
        column = pc.local_timestamp(column)
    column = column.cast(pa.timestamp("us"))
    micros = column.cast(pa.int64()).fill_null(0).to_numpy()
    ms = (micros + 500) // 1000 + EPOCH_DAYS * DAY_MS
    clock = (ms >= 0) & (ms < DAY_MS)  # a time alone
    if cells.options.d1904:
        days = ms - OFFSET_1904 * DAY_MS
        fine = (days >= 0) & (ms < LAST_SERIAL_1900 * DAY_MS)
    else:
        days = np.where(ms < 61 * DAY_MS, ms - DAY_MS, ms)
        fine = (days >= DAY_MS) & (days < LAST_SERIAL_1900 * DAY_MS)
    serial = np.where(clock, ms, days) / DAY_MS
    out = _wrapped(f'<c s="{style}"><v>', number_texts(np.where(fine | clock, serial, 0.0)), "</v></c>")
    if (fine | clock).all():
        return out
    others = np.flatnonzero(~(fine | clock))
    texts = np.array(out.to_pylist(), object)
    for k, t in zip(others.tolist(), column.take(pa.array(others)).to_pylist()):
        texts[k] = _BLANK if t is None else cells.cell(iso_text(t), "")
    return pa.array(texts, pa.string())


def _texts(column: pa.Array, cells: CellWriter) -> pa.Array:
    column = column.cast(pa.string()).fill_null("")
    long = np.flatnonzero(pc.greater(pc.utf8_length(column), MAX_CELL_CHARS // 2).to_numpy(zero_copy_only=False))
    if len(long):
        values = column.to_pylist()
        for k in long.tolist():
            if units(values[k]) > MAX_CELL_CHARS:
                if cells.options.overlong == "error":
                    raise SheetError("CELL_TOO_LONG", f"a text of {units(values[k])} characters")
                values[k], cells.truncated = limit_text(values[k], MAX_CELL_CHARS, cells.options.suffix), cells.truncated + 1
        column = pa.array(values, pa.string())
    space = pc.or_(pc.or_(pc.starts_with(column, " "), pc.ends_with(column, " ")), pc.match_substring_regex(column, r"[\t\n\r]"))
    odd = np.flatnonzero(pc.match_substring_regex(column, _ESCAPES).to_numpy(zero_copy_only=False))
    if len(odd):
        values = column.to_pylist()
        for k in odd.tolist():
            values[k] = encode_text(values[k])
        column = pa.array(values, pa.string())
    out = _wrapped('<c t="inlineStr"><is><t>', column, "</t></is></c>")
    if pc.any(space).as_py():
        out = pc.if_else(space, _wrapped('<c t="inlineStr"><is><t xml:space="preserve">', column, "</t></is></c>"), out)
    return out


def column_xml(column: pa.Array, cells: CellWriter, style: int) -> pa.Array:
    """The cells of a column, without references; ``style`` is that of dates."""
    kind = column.type
    if pa.types.is_null(kind):
        return pa.array([_BLANK] * len(column))
    if pa.types.is_boolean(kind):
        out = pc.if_else(column, '<c t="b"><v>1</v></c>', '<c t="b"><v>0</v></c>')
    elif pa.types.is_integer(kind):
        text = column.cast(pa.string())
        out = _wrapped("<c><v>", text, "</v></c>")
        x = column.cast(pa.int64()).fill_null(0).to_numpy()
        if ((x > BIG) | (x < -BIG)).any():
            out = pc.if_else(pa.array((x > BIG) | (x < -BIG)), _wrapped('<c t="inlineStr"><is><t>', text, "</t></is></c>"), out)
    elif pa.types.is_floating(kind):
        out = _numbers(column)
    elif pa.types.is_timestamp(kind) or pa.types.is_date(kind):
        out = _moments(column, cells, style)
    elif pa.types.is_string(kind) or pa.types.is_large_string(kind):
        out = _texts(column, cells)
    else:
        return pa.array([cells.cell(v, "") for v in column.to_pylist()], pa.string())
    return pc.if_else(column.is_valid(), out, _BLANK) if column.null_count else out


def rows_xml(batches: Iterator[pa.RecordBatch], cells: CellWriter, style: int, most: int | None = None) -> Iterator[tuple[memoryview, int]]:
    """The XML of the batches' rows, in pieces of bounded size, and how many rows each has; ``most`` rows a piece."""
    for batch in batches:
        step = max(1, min(most or batch.num_rows or 1, PIECE * max(1, batch.num_rows) // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            rows = pc.binary_join_element_wise("<row>", *[column_xml(c, cells, style) for c in part.columns], "</row>", "")
            yield string_bytes(rows), part.num_rows


def string_bytes(texts: pa.Array) -> memoryview:
    """All texts of an array, one after another."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return memoryview(texts.buffers()[2])[int(offsets[0]) : int(offsets[-1])]
