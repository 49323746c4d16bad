"""Reading and writing workbooks: tolerance, refusals, limits and round trips."""

import datetime as dt
import io
import json
import random
import re
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tabloom.errors import SheetError, error_code
from tabloom.operators import relations as R
from tabloom.plans.workbooks import load, round_trip, save, scan_errors, scratch, sheet_catalogue, workbook_bytes, write_workbook
from tabloom.sources.container import Container, Limits, combine_crc
from tabloom.sources.datasource import unique_names
from tabloom.sources.sniff import sniff
from tabloom.sources.workbook import Workbook, _Rows
from tabloom.sources.writer import ErrorValue, Options, Sheet, Style, WorkbookWriter, overlapping

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(sheet: str, extra: dict | None = None, workbook: str | None = None, stored: bool = False, styles: str | None = None, strings: str | None = None, target: str = "worksheets/sheet1.xml") -> io.BytesIO:
    """A workbook of hand-written parts."""
    rels = f'<Relationship Id="rId1" Type="{REL}/worksheet" Target="{target}"/>' + (f'<Relationship Id="rId2" Type="{REL}/styles" Target="styles.xml"/>' if styles else "") + (f'<Relationship Id="rId3" Type="{REL}/sharedStrings" Target="sharedStrings.xml"/>' if strings else "")
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships><Relationship Id="r" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": workbook or f'<workbook {NS} xmlns:r="{REL}"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f"<Relationships>{rels}</Relationships>",
        "xl/worksheets/sheet1.xml": sheet,
    }
    parts |= {"xl/styles.xml": styles} if styles else {}
    parts |= {"xl/sharedStrings.xml": strings} if strings else {}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for name, text in (parts | (extra or {})).items():
            if text is not None:
                z.writestr(name, text)
    return out


def grid(source, **k):
    """{reference: (kind, value)} of the first sheet, by both ways of reading."""
    book = Workbook(source, k.pop("limits", None))
    from tabloom.functions.cells import format_ref

    read = lambda rows: {format_ref(n, c): (cell.kind, cell.value) for n, cells in rows for c, cell, _ in cells}
    plain = read(book.rows(book.sheets[0], **k))
    if not k:
        assert read(_Rows(book, book.sheets[0], False, False, 16384)._parsed(book.container.stream(book.sheets[0].part))) == plain
    return plain


def sheet_xml(rows: str) -> str:
    return f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>"


DATES = f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="dd/mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="41"/></cellXfs></styleSheet>'


def test_cell_kinds():
    rows = '<row r="1"><c r="A1" t="s"><v>1</v></c><c r="B1" t="s"><v>9</v></c><c r="C1" t="str"><v>x&amp;y</v></c><c r="D1" t="b"><v>1</v></c><c r="E1" t="e"><v>#N/A</v></c><c r="F1" s="1"><v>45351.5</v></c><c r="G1" s="3"><v>5</v></c><c r="H1"><v>1E3</v></c><c r="I1" t="d"><v>2024-02-29T10:00:00</v></c><c r="J1" t="inlineStr"><is><t>in</t></is></c><c r="K1"><v> </v></c><c r="L1"/><c r="M1"><v/></c><c r="N1" t="str"><v></v></c><c r="O1" t="inlineStr"/><c r="P1" t="inlineStr"><is><t/></is></c><c r="Q1" t="zz"><v>7</v></c><c r="R1" s="2"><v>60</v></c><c r="S1"><v>0x1F</v></c></row>'
    strings = f"<sst {NS}><si><t>a</t></si><si><r><t>b</t></r><r><t xml:space=\"preserve\"> c</t></r><rPh><t>no</t></rPh></si></sst>"
    got = grid(package(sheet_xml(rows), styles=DATES, strings=strings))
    assert got == {"A1": ("s", "b c"), "B1": ("s", ""), "C1": ("s", "x&y"), "D1": ("b", True), "E1": ("e", "#N/A"), "F1": ("d", dt.datetime(2024, 2, 29, 12)), "G1": ("n", 5.0), "H1": ("n", 1000.0), "I1": ("d", dt.datetime(2024, 2, 29, 10)), "J1": ("s", "in"), "N1": ("s", ""), "P1": ("s", ""), "Q1": ("n", 7.0), "R1": ("d", dt.datetime(1900, 3, 1)), "S1": ("s", "0x1F")}


def test_positions_are_inferred():
    got = grid(package(sheet_xml("<row><c><v>1</v></c><c><v>2</v></c></row><row r=\"5\"><c r=\"C5\"><v>3</v></c><c><v>4</v></c></row><row><c r=\"??\"><v>5</v></c></row>")))
    assert {k: v[1] for k, v in got.items()} == {"A1": 1, "B1": 2, "C5": 3, "D5": 4, "A6": 5}
    with pytest.raises(SheetError, match="ROW_OUT_OF_RANGE"):
        grid(package(sheet_xml('<row r="1"><c r="XFE1"><v>1</v></c></row>')))


def test_odd_markup():
    prefixed = f'<x:worksheet xmlns:x="{NS[7:-1]}"><x:sheetData><x:row r="1"><x:c r="A1"><x:v>1</x:v></x:c></x:row></x:sheetData></x:worksheet>'
    assert grid(package(prefixed)) == {"A1": ("n", 1.0)}
    cdata = sheet_xml('<row r="1"><c r="A1" t="inlineStr"><is><t><![CDATA[a<b&c]]></t></is></c><!-- </row> --><c r="B1" t="inlineStr"><is><r><t>x</t></r><r><t>y &#128515; &foo; &#0;</t></r></is></c></row>')
    assert grid(package(cdata)) == {"A1": ("s", "a<b&c"), "B1": ("s", "xy 😃 &foo; &#0;")}
    assert grid(package(sheet_xml('<row r="1"><c r="A1" t="inlineStr"><is><t>a\r\nb\rc&#13;d</t></is></c></row>'))) == {"A1": ("s", "a\nb\nc\rd")}
    twice = f"<worksheet {NS}><sheetData><row><c><v>1</v></c></row></sheetData><sheetData><row><c><v>2</v></c></row></sheetData></worksheet>"
    assert [v for _, v in grid(package(twice)).values()] == [1, 2]
    assert grid(package(sheet_xml('<row r="1"><c r="A1"><f>B1*2</f><v>3</v></c></row>')), formulas=True) == {"A1": ("n", 3.0)}
    assert grid(package(sheet_xml("<row r='1'/><row r='2'><c r='A2'><v>1</v></c></row>"))) == {"A2": ("n", 1.0)}


def test_package_layouts():
    rows = sheet_xml('<row r="1"><c r="A1"><v>1</v></c></row>')
    for k in ({"stored": True}, {"target": "/xl/worksheets/sheet1.xml"}, {"target": "worksheets\\sheet1.xml"}, {"target": "WORKSHEETS/Sheet1.XML"}):
        assert grid(package(rows, **k)) == {"A1": ("n", 1.0)}
    book = Workbook(package(rows, workbook=f'<workbook {NS} xmlns:r="{REL}"><workbookPr date1904="1"/><sheets><sheet name="Data" sheetId="1" r:id="rId1"/><sheet name="H" sheetId="1" state="veryHidden" r:id="none"/></sheets></workbook>'))
    assert book.d1904 and [(s.name, s.state, s.part) for s in book.sheets] == [("Data", "visible", "xl/worksheets/sheet1.xml"), ("H", "veryHidden", "xl/worksheets/sheet1.xml")]
    assert book.sheet("dATA").index == 0 and book.sheet(1).name == "H"
    with pytest.raises(SheetError, match="SHEET_NOT_FOUND"):
        book.sheet("x")


def test_warnings_once():
    book = Workbook(package(sheet_xml('<row r="1"><c r="A1" t="s"><v>5</v></c><c r="B1" t="s"><v>6</v></c></row>')))
    assert [*book.rows(book.sheets[0])] and [w["code"] for w in book.warnings] == ["SHARED_STRINGS_MISSING", "SST_INDEX_OUT_OF_RANGE"]


@pytest.mark.parametrize("head,kind", [(b"", "empty"), (b"PK\x03\x04", "zip"), (b"PK\x05\x06", "empty-zip"), (bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 99, "xls"), (bytes.fromhex("D0CF11E0A1B11AE1") + "EncryptedPackage".encode("utf-16-le"), "encrypted"), (b"a,b\n1,2\n", "text"), (b"<?xml version='1.0'?><Workbook/>", "xml"), (b"<!DOCTYPE html>", "html"), (b"\xff\xfea\0,\0", "text"), (b"caf\xe9,x", "text"), (b"\0\1\2\3\xff", "unknown")])
def test_sniff(head, kind):
    assert sniff(head) == kind


def refused(source, code, limits=None):
    with pytest.raises(SheetError) as caught:
        book = Workbook(source, limits)
        for s in book.sheets:
            for _ in book.rows(s):
                pass
    assert caught.value.code == code, caught.value
    assert error_code(RuntimeError(str(caught.value))) == code


def test_refusals():
    rows = sheet_xml('<row r="1"><c r="A1"><v>1</v></c></row>')
    good = package(rows).getvalue()
    refused(io.BytesIO(b"a,b\n"), "NOT_XLSX")
    refused(io.BytesIO(bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 600), "LEGACY_XLS")
    refused(io.BytesIO(bytes.fromhex("D0CF11E0A1B11AE1") + "EncryptedPackage".encode("utf-16-le")), "ENCRYPTED")
    refused(io.BytesIO(good[:-10]), "ZIP_TRUNCATED")
    refused(package(rows, extra={"mimetype": "application/vnd.oasis.opendocument.spreadsheet"}), "ODS")
    refused(package(rows, extra={"[Content_Types].xml": None}), "NOT_XLSX")
    refused(package(rows.replace("<sheetData>", "<!DOCTYPE x><sheetData>")), "XML_MALFORMED")
    refused(package('<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]>' + rows), "XML_DOCTYPE")
    refused(package(rows.replace("</worksheet>", "")), "XML_MALFORMED")
    refused(package(f"<worksheet {NS}><sheetData><row><c>" + "<b>" * 300), "LIMIT_EXCEEDED")
    refused(package(sheet_xml('<row r="1"><c r="A1" t="inlineStr"><is><t>' + "x" * 2000 + "</t></is></c></row>")), "LIMIT_EXCEEDED", Limits(text=1000))
    refused(package(sheet_xml('<row r="1"><c r="A1"><v>1</v></c></row>' * 50_000)), "ZIP_BOMB", Limits(inflated_bytes=100_000))
    refused(package(rows, workbook=f"<workbook {NS}><sheets>" + '<sheet name="a" sheetId="1"/>' * 200 + "</sheets></workbook>"), "LIMIT_EXCEEDED", Limits(entries=100))
    refused(package(rows, strings=f"<sst {NS}>" + "<si/>" * 1000 + "</sst>").__class__(package(sheet_xml('<row r="1"><c r="A1" t="s"><v>0</v></c></row>'), strings=f"<sst {NS}>" + "<si/>" * 1000 + "</sst>").getvalue()), "LIMIT_EXCEEDED", Limits(shared_chars=1000))
    out = io.BytesIO()
    with pytest.warns(UserWarning), zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "1")
        z.writestr("a", "2")
    refused(out, "ZIP_DUPLICATE_ENTRY")
    stored = bytearray(package(rows, stored=True).getvalue())
    at = stored.find(b"<v>1</v>")
    stored[at + 3] = ord("2")
    refused(io.BytesIO(bytes(stored)), "ZIP_CRC_MISMATCH")


def test_styles_flood_is_read():
    many = f"<styleSheet {NS}><cellXfs>" + '<xf numFmtId="0"/>' * 70_000 + "</cellXfs></styleSheet>"
    book = Workbook(package(sheet_xml('<row r="1"><c r="A1" s="69999"><v>1</v></c></row>'), styles=many))
    assert book.formats_ignored and len(book.dates) == 65_490 and next(book.rows(book.sheets[0]))[1][0][1].value == 1


@pytest.mark.parametrize("options", [Options(), Options(strings="shared"), Options(strings="auto"), Options(d1904=True), Options(zip64=True), Options(level=0)])
def test_write_and_read(options):
    rows = [["Id", "a  b", "x<&>\"", "_x0041_", "\x01\x00", " lead", "tab\t", "nl\n", "cr\r", "😀"], [1, 2.5, None, True, dt.datetime(2024, 2, 29, 12, 30, 1, 500_000), ErrorValue("#N/A"), "", float("nan"), 10**20, -0.0], [], [None, None, dt.date(2020, 1, 1), 2**53, 0.1 + 0.2, 1e21, ErrorValue("#SPILL!"), float("-inf"), dt.datetime(1800, 1, 1), dt.datetime(1899, 12, 30, 6)]]
    out = io.BytesIO()
    w = WorkbookWriter(out.write, options)
    assert w.add(Sheet("Data", freeze=(1, 1), widths={0: 300}, merges=["A5:B6"], auto_filter=True), rows) == {"name": "Data", "rows": 4, "columns": 10}
    w.add("second", [[1]], styles=Style(format="0.00", font={"bold": True, "color": "#ff0000"}, fill="00FF00", border={"left": "thin"}, alignment={"horizontal": "center"}))
    done = w.close()
    assert done["bytes"] == len(out.getvalue())
    with zipfile.ZipFile(out) as z:
        assert z.testzip() is None
    got = grid(out)
    want = {f"{'ABCDEFGHIJ'[k]}1": ("s", v) for k, v in enumerate(rows[0])}
    clock = ("d", dt.datetime(1904, 1, 1, 6)) if options.d1904 else ("d", dt.datetime(1899, 12, 30, 6))
    want |= {"A2": ("n", 1), "B2": ("n", 2.5), "D2": ("b", True), "E2": ("d", rows[1][4]), "F2": ("e", "#N/A"), "G2": ("s", ""), "H2": ("e", "#NUM!"), "I2": ("s", str(10**20)), "J2": ("n", 0), "C4": ("d", dt.datetime(2020, 1, 1)), "D4": ("n", 2**53), "E4": ("n", 0.1 + 0.2), "F4": ("n", 1e21), "G4": ("s", "#SPILL!"), "H4": ("e", "#NUM!"), "I4": ("s", "1800-01-01T00:00:00"), "J4": clock}
    assert got == want
    assert out.getvalue() == _again(rows, options)


def _again(rows, options):
    out = io.BytesIO()
    w = WorkbookWriter(out.write, options)
    w.add(Sheet("Data", freeze=(1, 1), widths={0: 300}, merges=["A5:B6"], auto_filter=True), rows)
    w.add("second", [[1]], styles=Style(format="0.00", font={"bold": True, "color": "#ff0000"}, fill="00FF00", border={"left": "thin"}, alignment={"horizontal": "center"}))
    w.close()
    return out.getvalue()


def test_writer_refusals():
    with pytest.raises(SheetError, match="visible"):
        WorkbookWriter(io.BytesIO().write).close()
    for rows in ([[object()]], [[[1]]], [[ErrorValue("x")]], [[None] * 16_385]):
        with pytest.raises(SheetError):
            WorkbookWriter(io.BytesIO().write).add("s", rows)
    with pytest.raises(SheetError, match="overlap"):
        WorkbookWriter(io.BytesIO().write).add(Sheet("s", merges=["A1:B2", "B2:C3"]), [])
    with pytest.raises(SheetError, match="CELL_TOO_LONG"):
        WorkbookWriter(io.BytesIO().write, Options(overlong="error")).add("s", [["x" * 40_000]])
    with pytest.raises(SheetError, match="LIMIT_EXCEEDED"):
        workbook_bytes({"s": [[1]]}, most=100)
    assert overlapping([(1, 0, 5, 0), (3, 0, 3, 3)]) and not overlapping([(1, 0, 5, 0), (1, 1, 5, 1), (6, 0, 6, 9)])


def test_auto_strings_freeze():
    out = io.BytesIO()
    w = WorkbookWriter(out.write, Options(strings="auto"))
    w.add("s", [[f"text {k}"] for k in range(66_000)] + [["text 1"], ["y" * 300]])
    assert w.close()["strings"] == {"count": 65_537, "unique": 65_536, "frozen": True}
    assert len(grid(out)) == 66_002


def test_random_sheets_round_trip():
    rnd = random.Random(11)
    make = [lambda: None, lambda: rnd.random() * 10 ** rnd.randint(-12, 12), lambda: rnd.randint(-99, 99), lambda: rnd.random() < 0.5, lambda: "".join(rnd.choice(" _x0aé<&>\"'\n\t\x02😀") for _ in range(rnd.randint(0, 12))), lambda: dt.datetime(1950, 1, 1) + dt.timedelta(milliseconds=rnd.randrange(10**13))]
    rows = [[rnd.choice(make)() for _ in range(rnd.randint(0, 9))] for _ in range(300)]
    got = grid(io.BytesIO(workbook_bytes({"s": rows})))
    from tabloom.functions.cells import format_ref

    want = {format_ref(n, c): v for n, row in enumerate(rows, 1) for c, v in enumerate(row) if v is not None}
    assert {k: v[1] for k, v in got.items()} == want


def test_checksums_combine():
    a, b = b"abc" * 999, b"defg" * 777
    assert combine_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b) and combine_crc(5, 0, 0) == 5


def test_zip64_directory_is_read():
    data = workbook_bytes({"s": [[1]]}, Options(zip64=True))
    assert struct.pack("<I", 0x06064B50) in data and "xl/workbook.xml" in Container(io.BytesIO(data)).entries


def test_header_names():
    assert unique_names(["a", "a", None, "a_1", None, ""]) == ["a", "a_1", "__EMPTY", "a_1_1", "__EMPTY_1", "__EMPTY_2"] and unique_names(["x", "y"], "index") == ["0", "1"]


# Through Spark


@pytest.fixture
def book(spark):
    path = f"{scratch(spark)}/book.xlsx"
    rows = [[None, "title"], ["Name", "Name", None, "When", "Ok", "Mixed"], ["a", 1, 2, dt.datetime(2024, 1, 2), True, 1], [], ["b", None, 3.5, dt.datetime(2024, 1, 3), False, "x"], ["c", ErrorValue("#N/A"), None, None, None, None, "beyond"]]
    with open(path, "wb") as f:
        f.write(workbook_bytes({"Main": rows, "Other": [["k"], [1]]}))
    return path


def test_records(spark, book):
    d = load(spark, book, headerRow="2", errors="null")
    assert d.dtypes == [("Name", "string"), ("Name_1", "double"), ("__EMPTY", "double"), ("When", "timestamp_ntz"), ("Ok", "boolean"), ("Mixed", "string")]
    assert [tuple(r) for r in d.collect()] == [("a", 1.0, 2.0, dt.datetime(2024, 1, 2), True, "1"), ("b", None, 3.5, dt.datetime(2024, 1, 3), False, "x"), ("c", None, None, None, None, None)]
    assert load(spark, book, headerRow="2", defval="-").collect()[2]["Mixed"] == "-"
    assert [r["__EMPTY"] for r in load(spark, book, headerRow="2", maxRows="2").collect()] == [2, 3.5]
    assert load(spark, book, headerRow="2", dropEmptyHeaders="true").columns == ["Name", "Name_1", "When", "Ok", "Mixed"]
    assert load(spark, book, headerRow="2", blankRows="true").count() == 4
    assert load(spark, book, headers=json.dumps(["p", "q", "p"]), startRow="3").columns == ["q", "p"]
    assert load(spark, book, sheet="other").collect()[0]["k"] == 1
    assert load(spark, book, headerRow="2", pathColumn="true").select("_sheet").distinct().collect()[0][0] == "Main"
    assert load(spark, book, headerRow="2", columns=json.dumps(["When"]), dates="serial").dtypes == [("When", "double")]


def test_cells_and_arrays(spark, book):
    cells = load(spark, book, mode="cells")
    assert {r["ref"]: r["kind"] for r in cells.where("sheet = 'Main' AND row_index = 3").collect()} == {"A3": "s", "B3": "n", "C3": "n", "D3": "d", "E3": "b", "F3": "n"}
    rows = load(spark, book, mode="array", blankRows="true").collect()
    assert [r["row_index"] for r in rows] == [1, 2, 3, 4, 5, 6] and rows[3]["cells"] == [] and rows[0]["cells"][0] is None
    heads = R.head_map(cells.where("sheet = 'Main'"), 2).first()["cells"]
    assert heads["B1"]["s"] == "title" and len(heads) == 6
    over = R.beyond_header(cells.where("sheet = 'Main'"), 5, 2).first()
    assert (over["cells"], over["first_ref"]) == (1, "G6")


def test_errors_come_back_with_their_code(spark):
    folder = scratch(spark)
    for name, data in (("a.xlsx", b"a,b\n"), ("b.xlsx", workbook_bytes({"s": [[1]]})), ("c.xlsx", b"")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    assert {(r["path"].rpartition("/")[2], r["code"]) for r in scan_errors(spark, folder).collect()} == {("a.xlsx", "NOT_XLSX"), ("c.xlsx", "NOT_XLSX")}
    with pytest.raises(Exception) as caught:
        load(spark, f"{folder}/a.xlsx").collect()
    assert error_code(caught.value) == "NOT_XLSX"
    with pytest.raises(Exception) as caught:
        load(spark, f"{folder}/b.xlsx", sheet="none").collect()
    assert error_code(caught.value) == "SHEET_NOT_FOUND"


def test_parallel_write_keeps_order(spark):
    d = spark.range(5000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit(" t"), "id")).alias("t"), (F.col("id") % 2 == 0).alias("b")).repartitionByRange(5, "id").sortWithinPartitions("id")
    path = f"{scratch(spark)}/book.xlsx"
    save(d, path, freezeHeader="true", autoFilter="true")
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        assert re.search(r'<autoFilter ref="A1:C5001"/>', z.read("xl/worksheets/sheet1.xml").decode())
    got = load(spark, path).collect()
    assert [r["id"] for r in got] == [*range(5000)] and got[1]["t"] == " t1" and got[7]["t"] is None
    save(d.limit(1), path)
    assert load(spark, path).count() == 1
    with pytest.raises(Exception):
        d.write.format("tabloom.xlsx").mode("append").save(path)
    with pytest.raises(Exception):
        save(d.select(F.array("id").alias("a")), f"{path}.2")


def test_folder_of_workbooks(spark):
    import os

    d = spark.range(1000).select("id", F.concat(F.lit("t"), "id").alias("t")).repartition(3, "id")
    path = f"{scratch(spark)}/books"
    save(d, path, layout="folder")
    assert len(os.listdir(path)) == 3 and sorted(r["id"] for r in load(spark, path, d.schema).collect()) == [*range(1000)]
    save(d.where("id < 0"), path, layout="folder")
    assert load(spark, path, d.schema).count() == 0


def test_empty_frames(spark):
    d = spark.createDataFrame([], "a long, b string")
    assert round_trip(d).count() == 0
    path = f"{scratch(spark)}/book.xlsx"
    write_workbook(path, {"e": d})
    assert load(spark, path).columns == ["a", "b"] and [r["name"] for r in sheet_catalogue(spark, path).collect()] == ["e"]


def test_inference_loses_nothing(spark):
    folder = scratch(spark)
    first = [["id", "v"], *[[k, k] for k in range(1100)], [1100, "late"], [1101, True]]
    second = [["id", "v", "more"], [2000, dt.datetime(2024, 1, 2), 7]]
    for name, rows in (("a.xlsx", first), ("b.xlsx", second)):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(workbook_bytes({"s": rows}))
    d = load(spark, folder)
    assert d.dtypes == [("id", "double"), ("v", "string"), ("more", "double")]
    got = {int(r["id"]): (r["v"], r["more"]) for r in d.collect()}
    assert len(got) == 1103 and all(v is not None for v, _ in got.values())
    assert got[7] == ("7", None) and got[1100] == ("late", None) and got[1101] == ("TRUE", None) and got[2000][1] == 7
    assert load(spark, f"{folder}/a.xlsx", maxRows="1000").dtypes[1] == ("v", "double")
    with pytest.raises(Exception) as caught:
        load(spark, f"{folder}/a.xlsx", sampleRows="1000").collect()
    assert error_code(caught.value) == "TYPE_MISMATCH"


def test_relations(spark):
    d = spark.createDataFrame([("b", 3), ("a", 1), ("b", 2), (None, 4)], "t string, k long")
    assert sorted(tuple(r) for r in R.dictionary(d, "t", "k").select("text", "first", "references", "id").collect()) == [("a", 1, 1, 0), ("b", 2, 2, 1)]
    entries = spark.createDataFrame([(0, "ab"), (1, "cd"), (2, "e")], "id long, text string").withColumn("group", F.lit(1))
    assert [r["frozen"] for r in R.freeze_point(entries, 5, 4).orderBy("id").collect()] == [False, False, True]
    have = spark.createDataFrame([("a", b"x"), ("b", b"yy")], "id string, content binary")
    import hashlib

    told = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest(), 1), ("b", "0", 2), ("c", "0", 1)], "id string, sha256 string, bytes long")
    assert {r["id"]: r["problem"] for r in R.integrity(have, told, "id").collect()} == {"b": "digest", "c": "missing"}


def test_overlaps_of_the_whole_table(spark):
    from tabloom.plans.queries import QUERIES, SQL

    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus").collect()
    boxes = [(k, c % 50, k * 7 % 500, k * 13 % 90, k * 7 % 500 + k % 9, k * 13 % 90 + k % 5) for k, c, _ in orders]
    want = {(a[1], a[0], b[0]) for a in boxes for b in boxes if a[1] == b[1] and a[0] < b[0] and a[2] <= b[4] and a[4] >= b[2] and a[3] <= b[5] and a[5] >= b[3]}
    got = [tuple(r) for r in QUERIES["merge_overlaps"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    open_orders = {k for k, _, status in orders if status != "F"}
    assert any(a in open_orders or b in open_orders for _, a, b in got)
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    assert {tuple(r) for r in connection.execute(SQL["merge_overlaps"]).fetchall()} == want


@pytest.mark.parametrize("name", ["xlsx_roundtrip_nation", "xlsx_head", "excel_ranges", "typed_diff_report", "merge_overlaps", "xlsx_sheet_catalogue", "stratified_sample"])
def test_queries_against_sql(spark, name):
    import duckdb

    from tabloom.plans.queries import QUERIES, SQL

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in "region nation customer part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ran = con.execute(SQL[name])
    names = [d[0] for d in ran.description]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == sorted((tuple(r) for r in ran.fetchall()), key=str)


def test_entry_imports_without_the_corpus_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tabloom", tmp_path / "tabloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'xlsx_head' in q and 'pipeline' not in q; e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert run.returncode == 0, run.stderr


def test_a_sheet_of_more_than_4_gib_is_zip64(tmp_path):
    """Segments that say they inflate to 5 GiB: what is joined of them has a directory that holds such sizes."""
    from pyspark.sql.types import LongType, StructField, StructType

    from tabloom.sources.datasource import Segment, XlsxWriter

    writer = XlsxWriter({"path": f"{tmp_path}/book.xlsx"}, StructType([StructField("k", LongType())]))
    with open(f"{tmp_path}/segment", "wb") as f:
        f.write(b"0" * 100)
    writer.commit([Segment(0, f"{tmp_path}/segment", 100, 5 << 30, 0, 1, 0)])
    with open(f"{tmp_path}/book.xlsx", "rb") as f:
        assert Container(f).entries["xl/worksheets/sheet1.xml"].size > 5 << 30


def test_workbooks_of_a_folder_end_by_bytes(spark, tmp_path):
    """A reader takes a GiB of a sheet; workbooks of a folder stay below that."""
    long = spark.range(36_000).coalesce(1).select("id", F.lit("x" * 32_000).alias("t"))
    assert save(long, f"{tmp_path}/long", layout="folder")["files"] > 1
    assert load(spark, f"{tmp_path}/long", long.schema).agg(F.count("t"), F.sum("id")).first() == (36_000, 35_999 * 18_000)
