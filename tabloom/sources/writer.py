"""Writes workbooks: cells to XML, parts to a container.

A sheet's rows may come in segments that are packed apart and joined later (``SegmentWriter``); such
rows leave out their numbers, which readers count for themselves.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from ..errors import SheetError
from ..functions.cells import (
    ERROR_TEXTS, MAX_CELL_CHARS, MAX_COLUMNS, MAX_ROWS, builtin_format_id, clean_sheet_name, column_letters, encode_text, escape_attribute,
    escape_text, format_range, iso_text, limit_text, needs_space, number_text, parse_range, preview, quote_sheet_name, to_serial, units,
)
from .container import PartPacker, ZipOut

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
EXTENDED = "http://schemas.openxmlformats.org/officeDocument/2006"
DECLARATION = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
MAX_STYLES = 64_000
MAX_FONT_SIZE, MAX_FONT_NAME, MAX_FORMAT_CODE = 409, 31, 255
# Line styles of borders, and alignments.
BORDER_STYLES = ("thin", "medium", "thick", "dashed", "dotted", "double", "hair", "mediumDashed", "dashDot", "mediumDashDot", "dashDotDot",
    "mediumDashDotDot", "slantDashDot")
ALIGNMENTS = {"horizontal": ("left", "center", "right"), "vertical": ("top", "center", "bottom")}
#: Cells from which on a sheet of a known size is written with ZIP64 records.
ZIP64_CELLS = 40_000_000
SHARED_ITEMS, SHARED_CHARS, SHARED_LENGTH = 65_536, 16 << 20, 256
BIG = 2**53
_FLUSH = 1 << 16


class ErrorValue(str):
    """A cell's error, such as #N/A."""


@dataclass
class Style:
    """A cell's looks; ``format`` is a number format code, the rest are attributes of their elements."""

    format: str | None = None
    font: dict = field(default_factory=dict)
    fill: str | None = None
    border: dict = field(default_factory=dict)
    alignment: dict = field(default_factory=dict)

    def check(self) -> None:
        """Refuses what no spreadsheet accepts, before anything is written."""
        wrong = lambda what, value: SheetError("WRITER_STATE", f"{what} can't be {preview(repr(value))}", field=what)
        clean = lambda t, most: isinstance(t, str) and 0 < units(t) <= most and escape_text(t) == t.replace("&", "&amp;").replace("<",
            "&lt;").replace(">", "&gt;")
        font, edges, where = self.font, self.border, self.alignment
        if not all(isinstance(x, dict) for x in (font, edges, where)):
            raise wrong("a style", (font, edges, where))
        for shade in (font.get("color"), self.fill, edges.get("color")):
            if shade is not None:
                colour(shade)
        size = font.get("size", 11)
        if isinstance(size, bool) or not isinstance(size, int | float) or not 1 <= size <= MAX_FONT_SIZE:
            raise wrong("font.size", size)
        if not clean(font.get("name", "Calibri"), MAX_FONT_NAME):
            raise wrong("font.name", font["name"])
        for edge in ("left", "right", "top", "bottom"):
            if edges.get(edge) is not None and edges[edge] not in BORDER_STYLES:
                raise wrong(f"border.{edge}", edges[edge])
        for axis, values in ALIGNMENTS.items():
            if where.get(axis) is not None and where[axis] not in values:
                raise wrong(f"alignment.{axis}", where[axis])
        if self.format is not None and not clean(self.format, MAX_FORMAT_CODE):
            raise wrong("format", self.format)

    def key(self) -> str:
        return json.dumps([self.format, self.font, self.fill, self.border, self.alignment], sort_keys=True)


def colour(text: str) -> str:
    m = re.fullmatch(r"#?([0-9A-Fa-f]{2})?([0-9A-Fa-f]{6})", text)
    if not m:
        raise SheetError("WRITER_STATE", f"{text!r} is no colour")
    return ((m[1] or "FF") + m[2]).upper()


class Styles:
    """Styles in order of first use, each kept once."""

    def __init__(self):
        self.ids: dict[str, int] = {Style().key(): 0}
        self.made: list[Style] = [Style()]

    def id(self, style: Style | None) -> int:
        if style is None:
            return 0
        known = self.ids.get(key := style.key())
        if known is None:
            style.check()
            if len(self.made) >= MAX_STYLES:
                raise SheetError("WRITER_STATE", f"more than {MAX_STYLES} styles")
            known = self.ids[key] = len(self.made)
            self.made.append(style)
        return known

    def xml(self) -> str:
        formats, fonts, fills, borders, cells = {}, {"<font><sz val=\"11\"/><name val=\"Calibri\"/></font>": 0}, {'<fill><patternFill patternType="none"/></fill>': 0, '<fill><patternFill patternType="gray125"/></fill>': 1}, {"<border><left/><right/><top/><bottom/><diagonal/></border>": 0}, []
        for s in self.made:
            number = builtin_format_id(s.format) if s.format else 0
            if number < 0:
                number = formats.setdefault(s.format, 164 + len(formats))
            font = next(iter(fonts))
            if s.font:
                flags = "".join(f"<{t}/>" for t, k in (("b", "bold"), ("i", "italic"), ("strike", "strike")) if s.font.get(k))
                under = "<u/>" if s.font.get("underline") else ""
                shade = f'<color rgb="{colour(s.font["color"])}"/>' if s.font.get("color") else ""
                font = f'<font>{flags}{under}<sz val="{number_text(s.font.get("size", 11))}"/>{shade}<name val="{escape_attribute(s.font.get("name", "Calibri"))}"/></font>'
            fill = f'<fill><patternFill patternType="solid"><fgColor rgb="{colour(s.fill)}"/></patternFill></fill>' if s.fill else next(iter(fills))
            border = next(iter(borders))
            if s.border:
                edge = lambda e: f'<{e} style="{escape_attribute(s.border[e])}"><color auto="1"/></{e}>' if s.border.get(e) else f"<{e}/>"  # noqa: E731, B023
                border = f"<border>{''.join(map(edge, ('left', 'right', 'top', 'bottom')))}<diagonal/></border>"
            ids = [known.setdefault(x, len(known)) for known, x in ((fonts, font), (fills, fill), (borders, border))]
            flags = "".join(f' {a}="1"' for a, on in (("applyNumberFormat", number), ("applyFont", ids[0]), ("applyFill", ids[1]), ("applyBorder",
                ids[2]), ("applyAlignment", s.alignment)) if on)
            inner = "".join(f' {k}="{escape_attribute(str(int(v) if isinstance(v, bool) else v))}"' for k, v in s.alignment.items())
            cells.append(f'<xf numFmtId="{number}" fontId="{ids[0]}" fillId="{ids[1]}" borderId="{ids[2]}" xfId="0"{flags}' + (f"><alignment{inner}/></xf>" if inner else "/>"))
        codes = "".join(f'<numFmt numFmtId="{k}" formatCode="{escape_attribute(c)}"/>' for c, k in formats.items())
        block = lambda tag, items: f'<{tag} count="{len(items)}">{"".join(items)}</{tag}>'
        return f'{DECLARATION}<styleSheet xmlns="{MAIN}">' + (f'<numFmts count="{len(formats)}">{codes}</numFmts>' if formats else "") + block("fonts", fonts) + block("fills", fills) + block("borders", borders) + '<cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>' + block("cellXfs", cells) + '<cellStyles count="1"><cellStyle name="Normal" xfId="0" builtinId="0"/></cellStyles></styleSheet>'


@dataclass
class Options:
    """How cells are written."""

    d1904: bool = False
    date_format: str = "yyyy-mm-dd hh:mm:ss"
    suffix: str = ""
    overlong: str = "truncate"
    level: int = 6
    strings: str = "inline"
    deterministic: bool = True
    zip64: bool = False


class Shared:
    """Shared strings in first-seen order; beyond its budget no more are taken, for good."""

    def __init__(self, mode: str):
        self.mode, self.ids, self.chars, self.count, self.frozen = mode, {}, 0, 0, mode == "inline"

    def id(self, text: str) -> int | None:
        known = self.ids.get(text)
        if known is None:
            if self.frozen or self.mode == "auto" and len(text) > SHARED_LENGTH:
                return None
            if self.mode == "auto" and (len(self.ids) >= SHARED_ITEMS or self.chars + len(text) > SHARED_CHARS):
                self.frozen = True
                return None
            known = self.ids[text] = len(self.ids)
            self.chars += len(text)
        self.count += 1
        return known

    def xml(self) -> Iterable[str]:
        yield f'{DECLARATION}<sst xmlns="{MAIN}" count="{self.count}" uniqueCount="{len(self.ids)}">'
        for text in self.ids:
            yield f"<si><t{_space(text)}>{encode_text(text)}</t></si>"
        yield "</sst>"


def _space(text: str) -> str:
    return ' xml:space="preserve"' if needs_space(text) else ""


class CellWriter:
    """Values to cell XML."""

    def __init__(self, options: Options, styles: Styles | None = None, shared: Shared | None = None):
        self.options, self.styles, self.shared = options, styles or Styles(), shared or Shared("inline")
        self.truncated = 0

    def cell(self, value, ref: str, style: Style | None = None) -> str:
        """One cell; nothing for a blank one without a style if it has a reference."""
        at = f' r="{ref}"' if ref else ""
        if isinstance(value, dt.datetime | dt.date) and not isinstance(value, ErrorValue):
            moment = value if isinstance(value, dt.datetime) else dt.datetime(value.year, value.month, value.day)
            moment = moment.replace(tzinfo=None)
            x = to_serial(moment, self.options.d1904)
            if x is not None:
                style = Style(**(vars(style) if style else {}) | {"format": (style and style.format) or self.options.date_format})
                return f'<c{at} s="{self.styles.id(style)}"><v>{number_text(x)}</v></c>'
            value = iso_text(moment)
        k = self.styles.id(style)
        s = f' s="{k}"' if k else ""
        if value is None:
            return f"<c{at}{s}/>" if k or not ref else ""
        if isinstance(value, bool):
            return f'<c{at}{s} t="b"><v>{int(value)}</v></c>'
        if isinstance(value, int) and abs(value) > BIG:
            value = str(value)
        elif isinstance(value, decimal.Decimal):
            value = float(value) if value.is_finite() and decimal.Decimal(repr(float(value))) == value else str(value)
        if isinstance(value, int | float):
            if not math.isfinite(value):
                return f'<c{at}{s} t="e"><v>#NUM!</v></c>'
            return f"<c{at}{s}><v>{number_text(value)}</v></c>"
        if isinstance(value, ErrorValue):
            if value in ERROR_TEXTS:
                return f'<c{at}{s} t="e"><v>{value}</v></c>'
            if not value.startswith("#"):
                raise SheetError("WRITER_STATE", f"{value!r} is no cell error")
        if not isinstance(value, str):
            raise SheetError("WRITER_STATE", f"a cell can't hold a {type(value).__name__}")
        if len(value) > MAX_CELL_CHARS // 2 and units(value) > MAX_CELL_CHARS:
            if self.options.overlong == "error":
                raise SheetError("CELL_TOO_LONG", f"a text of {units(value)} characters")
            value, self.truncated = limit_text(value, MAX_CELL_CHARS, self.options.suffix), self.truncated + 1
        if (n := self.shared.id(value)) is not None:
            return f'<c{at}{s} t="s"><v>{n}</v></c>'
        return f'<c{at}{s} t="inlineStr"><is><t{_space(value)}>{encode_text(value)}</t></is></c>'

    def row(self, values: Sequence, number: int | None, styles: Style | Sequence[Style | None] | None = None) -> str:
        """One row; without a number its cells have no references, and holes are written."""
        if len(values) > MAX_COLUMNS:
            raise SheetError("ROW_OUT_OF_RANGE", f"a row of {len(values)} cells")
        look = (lambda k: styles) if styles is None or isinstance(styles, Style) else (lambda k: styles[k] if k < len(styles) else None)
        cells = "".join([self.cell(v, f"{column_letters(k)}{number}" if number else "", look(k)) for k, v in enumerate(values)])
        return f'<row r="{number}">{cells}</row>' if number else f"<row>{cells}</row>"


@dataclass
class Sheet:
    """What a sheet has besides its rows."""

    name: str
    hidden: str = "visible"
    freeze: tuple[int, int] | None = None
    widths: dict[int, float] = field(default_factory=dict)
    merges: list[str] = field(default_factory=list)
    auto_filter: bool = False

    def check(self) -> None:
        """Refuses what can't be written, before anything is."""
        if self.hidden not in ("visible", "hidden", "veryHidden"):
            raise SheetError("WRITER_STATE", f"{self.hidden!r} is no state of a sheet")
        if self.freeze is not None and (min(self.freeze) < 0 or not sum(self.freeze) or self.freeze[0] >= MAX_ROWS or self.freeze[1] >= MAX_COLUMNS):
            raise SheetError("WRITER_STATE", f"{self.freeze} rows and columns can't be frozen")
        for k, w in self.widths.items():
            if not 0 <= k < MAX_COLUMNS or not 0 <= w < float("inf"):
                raise SheetError("WRITER_STATE", f"column {k} can't be {w} wide")
        self.boxes()

    def boxes(self) -> list[tuple[int, int, int, int]]:
        """The merged ranges, which share no cell."""
        boxes = []
        for text in self.merges:
            box = parse_range(text)
            if not box or box[:2] == box[2:]:
                raise SheetError("WRITER_STATE", f"{text!r} is no range to merge")
            boxes.append(box)
        if overlapping(boxes):
            raise SheetError("WRITER_STATE", "merged ranges overlap")
        return boxes

    def head(self, first: bool) -> str:
        view = ' tabSelected="1"' if first else ""
        pane = ""
        if self.freeze:
            rows, columns = self.freeze
            corner = f"{column_letters(columns)}{rows + 1}"
            where = "bottomRight" if rows and columns else "bottomLeft" if rows else "topRight"
            pane = f"<pane{f' xSplit="{columns}"' if columns else ''}{f' ySplit="{rows}"' if rows else ''} topLeftCell=\"{corner}\" activePane=\"{where}\" state=\"frozen\"/>"
        columns = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{number_text(min(255, w))}" customWidth="1"/>' for k, w in sorted(self.widths.items()))
        return f'{DECLARATION}<worksheet xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheetViews><sheetView{view} workbookViewId="0">{pane}</sheetView></sheetViews>' + (f"<cols>{columns}</cols>" if columns else "") + "<sheetData>"

    def tail(self, rows: int, columns: int) -> str:
        boxes = self.boxes()
        out = "</sheetData>"
        if self.auto_filter and rows and columns:
            out += f'<autoFilter ref="{format_range(1, 0, rows, columns - 1)}"/>'
        if boxes:
            out += f'<mergeCells count="{len(boxes)}">' + "".join(f'<mergeCell ref="{format_range(*b)}"/>' for b in boxes) + "</mergeCells>"
        return out + '<pageMargins left="0.7" right="0.7" top="0.75" bottom="0.75" header="0.3" footer="0.3"/></worksheet>'


def overlapping(boxes: list[tuple[int, int, int, int]]) -> bool:
    """Whether two rectangles share a cell: a sweep by top row over those still open."""
    open_: list[tuple[int, int, int, int]] = []
    for box in sorted(boxes):
        open_ = [b for b in open_ if b[2] >= box[0]]
        if any(b[1] <= box[3] and b[3] >= box[1] for b in open_):
            return True
        open_.append(box)
    return False


class WorkbookWriter:
    """One workbook onto a ``write(bytes)`` function; sheets are given one after another."""

    def __init__(self, write, options: Options | None = None):
        self.options = options or Options()
        now = dt.datetime(2026, 1, 1) if self.options.deterministic else dt.datetime.now()
        stamp = (now.hour << 11 | now.minute << 5 | now.second // 2, now.year - 1980 << 9 | now.month << 5 | now.day)
        self.zip, self.stamp = ZipOut(write, self.options.zip64, stamp), now
        self.styles, self.shared = Styles(), Shared(self.options.strings)
        self.cells = CellWriter(self.options, self.styles, self.shared)
        self.sheets: list[tuple[Sheet, int, int]] = []
        self.failed: SheetError | None = None

    def fail(self, error: Exception) -> SheetError:
        """The first failure stays: nothing more is written after it."""
        if self.failed is None:
            self.failed = error if isinstance(error, SheetError) else SheetError("IO_ERROR", str(error))
        return self.failed

    def _open(self, sheet: Sheet) -> tuple[Sheet, bool]:
        if self.failed:
            raise self.failed
        sheet.check()
        taken = tuple(s.name for s, _, _ in self.sheets)
        sheet.name = clean_sheet_name(sheet.name, taken, len(taken) + 1)
        return sheet, sheet.hidden == "visible" and all(s.hidden != "visible" for s, _, _ in self.sheets)

    def add(self, sheet: Sheet | str, rows: Iterable[Sequence], styles=None) -> dict:
        """A sheet from its rows; ``styles`` is one style for all, or a function of the row's index."""
        sheet, first = self._open(Sheet(sheet) if isinstance(sheet, str) else sheet)
        part, held, size, n, width = self.zip.begin(f"xl/worksheets/sheet{len(self.sheets) + 1}.xml", self.options.level), [sheet.head(first)], 0, 0, 0
        for n, row in enumerate(rows, 1):
            try:
                if n > MAX_ROWS:
                    raise SheetError("ROW_OUT_OF_RANGE", "a sheet has no more rows")
                text = self.cells.row(row, n, styles(n - 1) if callable(styles) else styles)
            except SheetError as e:
                raise self.fail(e) from None
            width, size = max(width, len(row)), size + len(text)
            held.append(text)
            if size > _FLUSH:
                part.add("".join(held).encode())
                held, size = [], 0
        held.append(sheet.tail(n, width))
        part.add("".join(held).encode())
        self.zip.end(part.flush(True))
        self.sheets.append((sheet, n, width))
        return {"name": sheet.name, "rows": n, "columns": width}

    def add_xml(self, sheet: Sheet | str, pieces: Iterable[tuple[bytes, int]], width: int) -> dict:
        """A sheet from the XML of its rows, in pieces with their counts of rows."""
        sheet, first = self._open(Sheet(sheet) if isinstance(sheet, str) else sheet)
        part, n = self.zip.begin(f"xl/worksheets/sheet{len(self.sheets) + 1}.xml", self.options.level), 0
        part.add(sheet.head(first).encode())
        for text, rows in pieces:
            n += rows
            if n > MAX_ROWS:
                raise SheetError("ROW_OUT_OF_RANGE", "a sheet has no more rows")
            part.add(text)
        part.add(sheet.tail(n, width).encode())
        self.zip.end(part.flush(True))
        self.sheets.append((sheet, n, width))
        return {"name": sheet.name, "rows": n, "columns": width}

    def add_segments(self, sheet: Sheet | str, segments: Iterable[tuple[object, Iterable[bytes]]], rows: int, width: int) -> dict:
        """A sheet from row segments that are packed already: (Packed, its bytes) each."""
        from .container import combine_crc

        if rows > MAX_ROWS:
            raise SheetError("ROW_OUT_OF_RANGE", "a sheet has no more rows")
        sheet, first = self._open(Sheet(sheet) if isinstance(sheet, str) else sheet)
        part = self.zip.begin(f"xl/worksheets/sheet{len(self.sheets) + 1}.xml", self.options.level)
        part.add(sheet.head(first).encode())
        total = part.flush(False)
        for made, chunks in segments:
            for chunk in chunks:
                self.zip.copy(chunk)
            total.crc = combine_crc(total.crc, made.crc, made.size)
            total.size, total.packed = total.size + made.size, total.packed + made.packed
        last = PartPacker(self.zip.copy, self.options.level)
        last.add(sheet.tail(rows, width).encode())
        made = last.flush(True)
        total.crc = combine_crc(total.crc, made.crc, made.size)
        total.size, total.packed = total.size + made.size, total.packed + made.packed
        self.zip.end(total)
        self.sheets.append((sheet, rows, width))
        return {"name": sheet.name, "rows": rows, "columns": width}

    def close(self) -> dict:
        if self.failed:
            raise self.failed
        if not self.sheets or all(s.hidden != "visible" for s, _, _ in self.sheets):
            raise SheetError("WRITER_STATE", "a workbook needs a visible sheet")
        n, put = len(self.sheets), lambda name, text: self.zip.whole(name, text.encode(), self.options.level)
        base = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        kinds = [("xl/workbook.xml", "sheet.main"), *[(f"xl/worksheets/sheet{k + 1}.xml", "worksheet") for k in range(n)], ("xl/styles.xml", "styles")]
        relations = [("worksheet", f"worksheets/sheet{k + 1}.xml") for k in range(n)] + [("styles", "styles.xml")]
        if self.shared.ids:
            part = self.zip.begin("xl/sharedStrings.xml", self.options.level)
            for text in self.shared.xml():
                part.add(text.encode())
            self.zip.end(part.flush(True))
            kinds.append(("xl/sharedStrings.xml", "sharedStrings"))
            relations.append(("sharedStrings", "sharedStrings.xml"))
        put("xl/styles.xml", self.styles.xml())
        state = lambda s: "" if s.hidden == "visible" else f' state="{s.hidden}"'
        listed = "".join(f'<sheet name="{escape_attribute(s.name)}" sheetId="{k + 1}"{state(s)} r:id="rId{k + 1}"/>' for k, (s, _, _) in enumerate(self.sheets))
        names = "".join(f'<definedName name="_xlnm._FilterDatabase" localSheetId="{k}" hidden="1">{encode_text(quote_sheet_name(s.name))}!$A$1:${column_letters(w - 1)}${r}</definedName>' for k, (s, r, w) in enumerate(self.sheets) if s.auto_filter and r and w)
        active = next(k for k, (s, _, _) in enumerate(self.sheets) if s.hidden == "visible")
        put("xl/workbook.xml",
            f'{DECLARATION}<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><workbookPr{" date1904=\"1\"" if self.options.d1904 else ""}/><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{listed}</sheets>' + (f"<definedNames>{names}</definedNames>" if names else "") + "</workbook>")
        rels = lambda items, kind: f'{DECLARATION}<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{k + 1}" Type="{t if "://" in t else f"{kind}/{t}"}" Target="{p}"/>' for k, (t, p) in enumerate(items)) + "</Relationships>"
        put("xl/_rels/workbook.xml.rels", rels(relations, OFFICE))
        put("docProps/core.xml",
            f'{DECLARATION}<cp:coreProperties xmlns:cp="{PACKAGE}/metadata/core-properties" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><dcterms:created xsi:type="dcterms:W3CDTF">{self.stamp:%Y-%m-%dT%H:%M:%SZ}</dcterms:created></cp:coreProperties>')
        titles = "".join(f"<vt:lpstr>{escape_text(s.name)}</vt:lpstr>" for s, _, _ in self.sheets)
        pairs = f'<HeadingPairs><vt:vector size="2" baseType="variant"><vt:variant><vt:lpstr>Worksheets</vt:lpstr></vt:variant><vt:variant><vt:i4>{n}</vt:i4></vt:variant></vt:vector></HeadingPairs>'
        put("docProps/app.xml",
            f'{DECLARATION}<Properties xmlns="{EXTENDED}/extended-properties" xmlns:vt="{EXTENDED}/docPropsVTypes"><Application>tabloom</Application>{pairs}<TitlesOfParts><vt:vector size="{n}" baseType="lpstr">{titles}</vt:vector></TitlesOfParts></Properties>')
        put("_rels/.rels", rels([("officeDocument", "xl/workbook.xml"), (f"{PACKAGE}/relationships/metadata/core-properties", "docProps/core.xml"),
            ("extended-properties", "docProps/app.xml")], OFFICE))
        over = "".join(f'<Override PartName="/{p}" ContentType="{base}.{k}+xml"/>' for p, k in kinds)
        put("[Content_Types].xml",
            f'{DECLARATION}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{over}<Override PartName="/docProps/app.xml" ContentType="application/vnd.openxmlformats-officedocument.extended-properties+xml"/><Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>')
        size = self.zip.close()
        return {"bytes": size, "sheets": [{"name": s.name, "rows": r, "columns": w} for s, r, w in self.sheets], "truncated": self.cells.truncated,
            "strings": {"count": self.shared.count, "unique": len(self.shared.ids), "frozen": self.shared.frozen and self.options.strings == "auto"}}
