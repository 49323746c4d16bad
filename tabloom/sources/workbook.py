"""Workbooks: the package's parts, its sheet catalogue, shared strings, formats, and rows of cells."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from ..errors import SheetError
from ..functions.cells import DATE_FORMAT_IDS, MAX_COLUMNS, column_index, decode_text, from_iso, from_serial, is_date_format, parse_number, units
from .container import Container, Limits
from .grid import BOOLEAN, DATE, KINDS, NUMBER, Grid, count_rows, resolve, scan
from .sniff import SNIFF_BYTES, reject, sniff
from .xmlparts import Feeder, Handler, decoded, parse


class Cell(NamedTuple):
    """kind: s text, n number, b boolean, d date, e error; value None for a blank one."""

    kind: str
    value: object
    formula: str | None = None


@dataclass
class SheetInfo:
    name: str
    index: int
    kind: str
    state: str
    part: str | None

    @property
    def hidden(self) -> bool:
        return self.state != "visible"


class _Collect(Handler):
    """Attribute dictionaries of the elements of some names, within a bound."""

    def __init__(self, names: set[str], most: int):
        self.names, self.most, self.found, self.path = names, most, [], []

    def start(self, name, attributes):
        self.path.append(name)
        if name in self.names:
            if len(self.found) >= self.most:
                raise SheetError("LIMIT_EXCEEDED", f"more than {self.most} {name} elements", limit="entries")
            self.found.append((name, attributes, self.path[-2] if len(self.path) > 1 else ""))

    def end(self, name):
        self.path.pop()


class _Formats(Handler):
    """Which cell formats show dates."""

    def __init__(self, most: int):
        self.most, self.custom, self.ids, self.ignored, self.inside = most, {}, [], False, []

    def start(self, name, attributes):
        if name == "numFmt" and "numFmts" in self.inside:
            try:
                self.custom[int(attributes.get("numFmtId", ""))] = attributes.get("formatCode", "")
            except ValueError:
                pass
        elif name == "xf" and "cellXfs" in self.inside:
            if len(self.ids) < self.most:
                text = attributes.get("numFmtId", "0")
                self.ids.append(int(text) if text.isdigit() else 0)
            else:
                self.ignored = True
        self.inside.append(name)

    def end(self, name):
        self.inside.pop()

    def dates(self) -> list[bool]:
        return [is_date_format(self.custom[k]) if k in self.custom else k in DATE_FORMAT_IDS for k in self.ids]


class _Strings(Handler):
    """The shared strings: runs joined, phonetic text left out."""

    def __init__(self, limits: Limits):
        self.limits, self.items, self.size = limits, [], 0
        self.parts, self.inside, self.phonetic = None, False, 0

    def start(self, name, attributes):
        if name == "si":
            self.parts = []
        elif name == "rPh":
            self.phonetic += 1
        elif name == "t":
            self.inside = self.parts is not None and not self.phonetic

    def text(self, data):
        if self.inside:
            self.parts.append(data)
            if sum(map(len, self.parts)) > self.limits.text:
                raise SheetError("LIMIT_EXCEEDED", "a shared string is too long", limit="text")

    def end(self, name):
        if name == "t":
            self.inside = False
        elif name == "rPh":
            self.phonetic -= 1
        elif name == "si" and self.parts is not None:
            item = decode_text("".join(self.parts))
            self.size += len(item) + 16
            if self.size > self.limits.shared_chars:
                raise SheetError("LIMIT_EXCEEDED", "the shared strings are too many", limit="shared_chars")
            self.items.append(item)
            self.parts = None


def _target(base: str, target: str) -> str:
    target = target.replace("\\", "/")
    return posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(posixpath.dirname(base), target))


MAIN_TYPES = re.compile(r"(?:spreadsheetml|ms-excel)\.(?:sheet|template|addin)(?:\.macroEnabled)?\.main\+xml", re.IGNORECASE)


class Workbook:
    """An open workbook on a seekable binary file."""

    def __init__(self, source, limits: Limits | None = None, d1904: bool | None = None):
        self.limits = limits or Limits()
        source.seek(0)
        reject(sniff(source.read(SNIFF_BYTES)))
        self.container = Container(source, self.limits)
        self.warnings: list[dict] = []
        if (mime := self.container.find("mimetype")) and self.container.read(mime).startswith(b"application/vnd.oasis.opendocument"):
            raise SheetError("ODS", "this is an OpenDocument file")
        self.overrides, self.defaults = self._types()
        main = self._main()
        kind = self.type_of(main)
        if "wordprocessingml" in kind or "presentationml" in kind:
            raise SheetError("NOT_XLSX", "this is another kind of document", format="docx" if "word" in kind else "pptx")
        if "sheet.binary" in kind:
            raise SheetError("XLSB", "binary workbooks are not read")
        rels = self._rels(main)
        found = self._collect(main, {"sheet", "workbookPr"})
        flag = next((a.get("date1904", "") for n, a, _ in found if n == "workbookPr"), "")
        self.d1904 = flag.lower() in ("1", "true") if d1904 is None else d1904
        self.sheets: list[SheetInfo] = []
        for _, a, parent in found:
            if parent != "sheets":
                continue
            relation = rels.get(a.get("id", ""))
            part = relation[1] if relation else _target(main, f"worksheets/sheet{a.get('sheetId', '')}.xml")
            kind = "chartsheet" if relation and relation[0].endswith("/chartsheet") else "worksheet"
            state = a.get("state", "visible")
            self.sheets.append(SheetInfo(a.get("name", ""), len(self.sheets), kind, state if state in ("hidden", "veryHidden") else "visible", part))
        by_type = {t.rpartition("/")[2]: p for t, p in reversed(rels.values())}
        self.strings_part, styles = by_type.get("sharedStrings"), by_type.get("styles")
        self._strings: list[str] | None = None
        self._string_array: pa.Array | None = None
        self.dates: list[bool] = []
        if styles and self.container.find(styles):
            formats = _Formats(self.limits.cell_formats)
            parse(self.container.stream(styles), formats, self.limits)
            self.dates, self.formats_ignored = formats.dates(), formats.ignored

    def _collect(self, part: str, names: set[str]) -> list:
        handler = _Collect(names, self.limits.entries)
        parse([self.container.read(part)], handler, self.limits)
        return handler.found

    def _types(self) -> tuple[dict, dict]:
        overrides, defaults = {}, {}
        if self.container.find("[Content_Types].xml") is None:
            raise SheetError("NOT_XLSX", "this archive is no workbook", format="zip")
        for name, a, _ in self._collect("[Content_Types].xml", {"Override", "Default"}):
            if name == "Override":
                overrides[a.get("PartName", "").lstrip("/").lower()] = a.get("ContentType", "")
            else:
                defaults[a.get("Extension", "").lower()] = a.get("ContentType", "")
        return overrides, defaults

    def type_of(self, part: str) -> str:
        return self.overrides.get(part.lower()) or self.defaults.get(part.rpartition(".")[2].lower(), "")

    def _rels(self, part: str) -> dict[str, tuple[str, str]]:
        folder, _, name = part.rpartition("/")
        at = f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"
        if self.container.find(at) is None:
            return {}
        return {a.get("Id", ""): (a.get("Type", ""), a.get("Target", "") if a.get("TargetMode") == "External" else _target(part, a.get("Target",
            ""))) for _, a, _ in self._collect(at, {"Relationship"})}

    def _main(self) -> str:
        told = [p for t, p in self._rels("").values() if t.endswith("/officeDocument")] if self.container.find("_rels/.rels") else []
        typed = [self.container.find(p) or p for p, t in self.overrides.items() if MAIN_TYPES.search(t)]
        for part in [*told, *typed, "xl/workbook.xml"]:
            if self.container.find(part):
                return part
        raise SheetError("NOT_XLSX", "the archive has no workbook part", format="zip")

    def sheet(self, which: int | str = 0) -> SheetInfo:
        """By index, by name, or by name in another case."""
        if isinstance(which, int):
            if 0 <= which < len(self.sheets):
                return self.sheets[which]
        else:
            for same in (lambda s: s.name == which, lambda s: s.name.lower() == which.lower()):
                if found := next(filter(same, self.sheets), None):
                    return found
        raise SheetError("SHEET_NOT_FOUND", f"no sheet {which!r}; there are {[s.name for s in self.sheets]}", sheets=[s.name for s in self.sheets])

    def strings(self) -> list[str]:
        """The shared strings, read when the first cell asks for one."""
        if self._strings is None:
            handler = _Strings(self.limits)
            if self.strings_part and self.container.find(self.strings_part):
                parse(self.container.stream(self.strings_part), handler, self.limits)
            else:
                self.warn("SHARED_STRINGS_MISSING", None, None)
            self._strings = handler.items
        return self._strings

    def string_array(self) -> pa.Array:
        """The same as an array, for many lookups at once."""
        if self._string_array is None:
            self._string_array = pa.array(self.strings(), pa.string())
        return self._string_array

    def warn(self, code: str, sheet: str | None, ref: str | None, **detail) -> None:
        """Once for each sheet and code."""
        if not any(w["code"] == code and w["sheet"] == sheet for w in self.warnings):
            self.warnings.append({"code": code, "sheet": sheet, "ref": ref} | detail)

    def rows(self, info: SheetInfo, formulas: bool = False, serials: bool = False, start_row: int = 1, max_rows: int | None = None,
        max_columns: int = MAX_COLUMNS) -> Iterator[tuple[int, list[tuple[int, Cell, int]]]]:
        """(row number, [(column, cell, format)]) of every row that holds a cell with a value."""
        given = 0
        for rows in self.blocks(info, formulas, serials, max_columns):
            for number, cells in cells_of(rows) if isinstance(rows, Grid) else rows:
                if number < start_row or not cells:
                    continue
                if max_rows is not None and given >= max_rows:
                    return
                given += 1
                yield number, cells

    def blocks(self, info: SheetInfo, formulas: bool = False, serials: bool = False, max_columns: int = MAX_COLUMNS, share: tuple[int, int] = (0, 1),
        kinds_only: bool = False) -> Iterator[Grid | list]:
        """The sheet's rows in blocks: a Grid where they are plain, else a list of (row number, cells).
        ``kinds_only`` leaves the texts out of grids.

        ``share`` (i, k) gives those rows only that end in the i-th of k equal parts of the sheet's bytes; the
        shares of all i together are the sheet.
        """
        if info.kind != "worksheet" or not info.part:
            return
        part = self.container.find(info.part)
        size, (i, k) = self.container.entries[part].size if part else 0, share
        low, high = size * i // k, size * (i + 1) // k if i + 1 < k else None
        yield from _Rows(self, info, formulas, serials, max_columns, kinds_only).blocks(self.container.stream(info.part), low, high)

    def first_column(self, info: SheetInfo) -> int:
        """The first column that the sheet's dimension declares, or 0."""
        for text in decoded(self.container.stream(info.part)):
            m = re.search(r"<(?:\w+:)?dimension\s[^>]{0,200}?ref=[\"']([A-Z]{1,3})\d+", text[:65_536].partition("sheetData")[0])
            return max(0, column_index(m[1])) if m else 0
        return 0


# What most writers produce: attributes r, s and t in this order, then v or one inline text.
_CELL = re.compile(r'<c(?:\s+r="([A-Z]{1,3})[0-9]{1,7}")?(?:\s+s="([0-9]{1,9})")?(?:\s+t="([a-zA-Z]+)")?\s*(?:/>|>(?:<v>([^<]*)</v>|<is><t(?:\s+xml:space="preserve")?>([^<]*)</t></is>)?</c>)')
_ROW = re.compile(r'\s*<row((?:\s+[\w:]+="[^"<]*")*)\s*>')
_EMPTY_ROW = re.compile(r'\s*<row((?:\s+[\w:]+="[^"<]*")*)\s*/>')
_ATTRIBUTE = re.compile(r'([\w:]+)="([^"]*)"')
_FIRST_BLOCK, _BLOCK = 1 << 16, 1 << 22


def cells_of(grid: Grid) -> Iterator[tuple[int, list[tuple[int, Cell, int]]]]:
    """A grid's rows one by one."""
    texts, moments = grid.texts.to_pylist(), pa.array(grid.micros, pa.timestamp("us")).to_pylist()
    cells = []
    for column, kind, x, at, t, style in zip(grid.column.tolist(), grid.kind.tolist(), grid.number.tolist(), grid.text_at.tolist(), moments, grid.style.tolist()):
        value = x if kind == NUMBER else t if kind == DATE else bool(x) if kind == BOOLEAN else texts[at]
        cells.append((column, Cell(KINDS[kind], value), style))
    borders = np.searchsorted(grid.row, np.arange(len(grid.numbers) + 1)).tolist()
    for number, first, last in zip(grid.numbers.tolist(), borders, borders[1:]):
        yield number, cells[first:last]


def _rows_end(block: bytes, upto: int) -> int:
    """Where the last row ends that ends within the first ``upto`` bytes; 0 if none does."""
    at = block.rfind(b"</row>", 0, upto)
    return at + 6 if at >= 0 else 0


def _odd_place(block: bytes) -> int:
    """Where a comment, a section or another sheetData element begins; -1 if there is none."""
    at = block.find(b"!")  # one byte is looked for far faster than two
    while at >= 0 and block[at - 1 : at] != b"<":
        at = block.find(b"!", at + 1)
    marks = [at - 1] if at > 0 else []
    if b"sheetData" in block:
        marks += [m for m in (block.find(b"<sheetData"), block.find(b"</sheetData>")) if m >= 0]
    return min(marks, default=-1)


def _larger(chunks) -> Iterator[bytes]:
    """The same bytes in pieces that grow to _BLOCK."""
    held, size, wanted = [], 0, _FIRST_BLOCK
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        if size >= wanted:
            yield b"".join(held)
            held, size, wanted = [], 0, min(_BLOCK, 4 * wanted)
    if held:
        yield b"".join(held)


class _Rows(Handler):
    """Rows of a sheet.

    Plain blocks of rows are taken apart as a whole; in other blocks, plain rows are read by one expression
    for a cell, and a row that is not of that form goes to the XML parser alone.  From a place on at which
    rows cannot be told apart that way, the sheet goes to the parser.
    """

    def __init__(self, book: Workbook, info: SheetInfo, formulas: bool, serials: bool, max_columns: int, kinds_only: bool = False):
        self.book, self.info, self.formulas, self.serials, self.max_columns, self.kinds_only = book, info, formulas, serials, max_columns, kinds_only
        self.number, self.out, self.refs, self.given = 0, [], {}, 0
        self.cells, self.in_data, self.in_row = [], 0, False
        self.kind = self.style = None
        self.taking, self.parts, self.v, self.f, self.inline, self.phonetic = "", [], None, None, None, 0
        self.column, self.chars = -1, 0

    def read(self, chunks) -> Iterator[tuple[int, list]]:
        """(row number, cells) of every row."""
        for rows in self.blocks(chunks, 0, None):
            yield from cells_of(rows) if isinstance(rows, Grid) else rows

    def blocks(self, chunks, low: int, high: int | None) -> Iterator[Grid | list]:
        """Blocks of the rows that end behind byte ``low`` of the part, and not behind ``high``.

        Rows are told apart by their end tags alone, up to the first place where that may fail (a comment,
        section or second sheetData element).  Whoever's range that place is in gives all rows behind it.
        """
        held, base, begun, odd = b"", 0, False, None
        stream = _larger(chunks)
        for chunk in stream:
            held += chunk
            if not begun:
                at, mark = held.find(b"<sheetData>"), held.find(b"<!")
                if held[:2] in (b"\xff\xfe", b"\xfe\xff") or 0 <= mark and (at < 0 or mark < at) or at < 0 and len(held) > 1 << 20:
                    odd = 0
                    break
                if at < 0:
                    continue
                begun, base, held = True, at + 11, held[at + 11 :]
            cut = _rows_end(held, len(held))
            end = held.find(b"</sheetData>", cut)
            made = self._block(held[:cut], base, low, high) if cut else []
            if isinstance(made, int):  # rows can't be told apart from there on
                odd = base + made
                made = self._block(held[: _rows_end(held, made)], base, low, high)
            elif end >= 0 and (mark := held.find(b"<!", cut, end)) >= 0:
                odd = base + mark
            yield from made
            if odd is not None or end >= 0:
                held, base = held[max(cut, end) :], base + max(cut, end)
                break
            held, base = held[cut:], base + cut
            if high is not None and base > high:
                return
            if len(held) > self.book.limits.row_chars:
                raise SheetError("LIMIT_EXCEEDED", "a row is too long", limit="row_chars")
        else:  # the sheet's end is missing, or its beginning: the parser says what is wrong
            odd = 0 if not begun else base + len(held)
        if odd is None:
            odd = self._second(stream, held, base, high)
        if odd is not None and (odd > low or not low) and (high is None or odd <= high):
            again = _Rows(self.book, self.info, self.formulas, self.serials, self.max_columns)
            rows = islice(again._parsed(self.book.container.stream(self.info.part)), self.given, None)
            while some := [*islice(rows, 1_000)]:
                yield some

    def _second(self, stream, held: bytes, base: int, high: int | None) -> int | None:
        """Where a second sheetData element begins, behind the first one's end; None if there is none.  Whoever
        reads up to the end of the sheet checks that it is one."""
        while (at := held.find(b"<sheetData")) < 0:
            if high is not None and base + len(held) > high:
                return None
            chunk = next(stream, None)
            if chunk is None:
                if not re.search(rb"</(?:\w+:)?worksheet\s*>\s*$", held[-1000:]):
                    raise SheetError("XML_MALFORMED", "the sheet ends early")
                return None
            base, held = base + max(0, len(held) - 1000), held[-1000:] + chunk
        return base + at

    def _block(self, block: bytes, base: int, low: int, high: int | None) -> list | int:
        """The rows of a block that starts at byte ``base`` and ends with a row, as a list of at most one Grid or list;
        or else the place in it from which on rows can't be told apart by their end tags."""
        number, given, skip = self.number, self.given, _rows_end(block, max(0, low - base))
        if skip:
            if (mark := _odd_place(block[:skip])) >= 0:
                return mark
            count, self.number = count_rows(block[:skip], self.number)
            self.given += count
            block, base = block[skip:], base + skip
        if high is not None and base + len(block) > high:
            block = block[: _rows_end(block, max(0, high - base))]
        if not block:
            return []
        grid = scan(block, self.number, self.book, self.max_columns, self.serials, self.formulas, self.kinds_only)
        if grid is not None:
            self.number = int(grid.numbers[-1])
            self.given += len(grid.numbers)
            return [grid]
        if (mark := _odd_place(block)) >= 0:
            self.number, self.given = number, given
            return skip + mark
        made = [row for text in block.decode("utf-8", "replace").split("</row>")[:-1] for row in self._plain(text)]
        self.given += len(made)
        return [made]

    def _plain(self, row: str) -> Iterator[tuple[int, list]]:
        while m := _EMPTY_ROW.match(row):
            self._begin_row(dict(_ATTRIBUTE.findall(m[1])))
            yield self.number, []
            row = row[m.end() :]
        m = _ROW.match(row)
        if not m:  # what isn't of the plain form, such as other quotes, is the parser's
            yield from self._alone(row + "</row>")
            return
        rest = row[m.end() :]
        found = _CELL.findall(rest)
        if rest.count("<c") != len(found) or "<f" in rest or rest.count("<") != self._tags(rest) or 'tr"' in rest and any(not v and not i and kind in ("inlineStr", "str") for _, _, kind, v, i in found):
            yield from self._alone(row + "</row>")
            return
        self._begin_row(dict(_ATTRIBUTE.findall(m[1])))
        cells, column, known, dates, serials, d1904 = [], -1, self.refs, self.book.dates, self.serials, self.book.d1904
        for letters, style, kind, v, inline in found:
            column = known.get(letters, -1) if letters else column + 1
            if column < 0 or column >= self.max_columns:
                column = known[letters] = self._column(letters, column)
            k = int(style) if style else 0
            if kind == "inlineStr":
                text = resolve(inline)
                self._check(text)
                cells.append((column, Cell("s", decode_text(text) if "_x" in text else text), k))
                continue
            if not v:
                continue
            if not kind or kind == "n":
                x = parse_number(v)
                if x.__class__ is float:
                    if k and k < len(dates) and dates[k] and not serials and (t := from_serial(x, d1904)) is not None:
                        cells.append((column, Cell("d", t), k))
                    else:
                        cells.append((column, Cell("n", x), k))
                elif x is not None:
                    cells.append((column, Cell("s", x), k))
                continue
            v = resolve(v)
            if (cell := self._value(kind, v, style, letters and f"{letters}{self.number}")) is not None:
                cells.append((column, cell, k))
        yield self.number, self._latest(cells)

    @staticmethod
    def _tags(rest: str) -> int:
        """How many tags the cells have: their own, and those of their values."""
        return rest.count("<c") + rest.count("</c>") + 2 * rest.count("<v>") + 2 * rest.count("<is>") + 2 * rest.count("</t>")

    @staticmethod
    def _latest(cells: list) -> list:
        """In column order; the last cell of a column counts."""
        if any(a[0] >= b[0] for a, b in zip(cells, cells[1:])):
            return sorted({c[0]: c for c in cells}.values(), key=lambda c: c[0])
        return cells

    def _alone(self, row: str) -> Iterator[tuple[int, list]]:
        feeder = Feeder(self, self.book.limits)
        feeder.feed(f"<sheetData>{row}</sheetData>", True)
        self.in_data = 0
        out, self.out = self.out, []
        yield from out

    def _parsed(self, chunks) -> Iterator[tuple[int, list]]:
        """Rows from the parser."""
        feeder = Feeder(self, self.book.limits)
        for text in decoded(chunks):
            feeder.feed(text)
            out, self.out = self.out, []
            yield from out
        feeder.feed("", True)
        yield from self.out

    # Positions and values, for both forms.

    def _begin_row(self, attributes: dict) -> None:
        r = attributes.get("r", "")
        self.number = int(r) if r.isdigit() and 0 < int(r) <= 1_048_576 else self.number + 1
        self.chars = 0

    def _column(self, ref: str, before: int) -> int:
        column = column_index(ref.rstrip("0123456789").strip("$"))
        if column < 0:
            if re.fullmatch(r"[A-Z]{3,}\d*", ref):
                raise SheetError("ROW_OUT_OF_RANGE", f"{ref} lies past the last column")
            column = before + 1
        if column >= self.max_columns:
            raise SheetError("LIMIT_EXCEEDED", f"column {column + 1} is past the limit of {self.max_columns}", limit="columns")
        return column

    def _check(self, text: str) -> None:
        if units(text) > self.book.limits.text:
            raise SheetError("LIMIT_EXCEEDED", "a cell's text is too long", limit="text")
        self.chars += len(text)
        if self.chars > self.book.limits.row_chars:
            raise SheetError("LIMIT_EXCEEDED", "a row's text is too long", limit="row_chars")

    def _value(self, kind: str, v: str | None, style: str, ref: str) -> Cell | None:
        """The cell of a typed value; None if it is blank."""
        if v is None:
            return None
        if kind == "s":
            if not v.strip():
                return None
            items = self.book.strings()
            k = int(v) if v.strip().isdigit() else -1
            if 0 <= k < len(items):
                self.chars += len(items[k])
                return Cell("s", items[k])
            self.book.warn("SST_INDEX_OUT_OF_RANGE", self.info.name, ref, index=v)
            return Cell("s", "")
        if kind in ("str", "inlineStr"):
            self._check(v)
            return Cell("s", decode_text(v))
        if kind == "b":
            return Cell("b", v.strip() in ("1", "true")) if v.strip() else None
        if kind == "e":
            return Cell("e", v) if v else None
        if kind == "d":
            t = from_iso(v)
            return Cell("d", t) if t else (Cell("s", v) if v.strip() else None)
        x = parse_number(v)
        if x is None:
            return None
        if isinstance(x, str):
            return Cell("s", x)
        k = int(style) if style.isdigit() else 0
        if k < len(self.book.dates) and self.book.dates[k] and not self.serials and (t := from_serial(x, self.book.d1904)) is not None:
            return Cell("d", t)
        return Cell("n", x)

    # The parser's events.

    def start(self, name, a):
        if name == "sheetData":
            self.in_data += 1
        elif not self.in_data:
            return
        elif name == "row":
            self._begin_row(a)
            self.cells, self.column, self.in_row = [], -1, True
        elif name == "c" and self.in_row:
            self.ref, self.kind, self.style = a.get("r", ""), a.get("t", ""), a.get("s", "")
            self.column = self._column(self.ref, self.column)
            self.v = self.f = self.inline = None
        elif name in ("v", "f", "t"):
            if name == "t" and self.phonetic:
                return
            self.taking, self.parts = name, []
        elif name == "rPh":
            self.phonetic += 1

    def text(self, data):
        if self.taking:
            self.parts.append(data)

    def end(self, name):
        if name == "sheetData":
            self.in_data -= 1
        elif not self.in_data:
            return
        elif name == "rPh":
            self.phonetic -= 1
        elif name == self.taking:
            text, self.taking = "".join(self.parts), ""
            if name == "v":
                self.v = (self.v or "") + text
            elif name == "f":
                self.f = text or None
            else:
                self.inline = (self.inline or "") + text
                self._check(self.inline)
        elif name == "c" and self.in_row:
            value = self.inline if self.kind == "inlineStr" and self.inline is not None else self.v
            if value == "" and self.kind not in ("str", "inlineStr"):
                value = None
            cell = self._value(self.kind or "n", value, self.style, self.ref)
            if self.formulas and self.f is not None:
                cell = Cell(cell.kind, cell.value, self.f) if cell else Cell("blank", None, self.f)
            if cell is not None:
                self.cells.append((self.column, cell, int(self.style) if self.style.isdigit() else 0))
        elif name == "row":
            self.in_row = False
            self.out.append((self.number, self._latest(self.cells)))
