"""Sheets as columns: blocks against the parser, shares of a sheet, cells of Arrow columns, and what readers keep."""

import datetime as dt
import decimal
import io
import json
import os
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.errors import SheetError, error_code
from tabloom.plans import workbooks as W
from tabloom.plans.workbooks import load, save, scratch, workbook_bytes
from tabloom.sources import cellxml
from tabloom.sources.datasource import XlsxStreamReader, filesystem, open_source
from tabloom.sources.grid import Grid
from tabloom.sources.workbook import Workbook, _Rows, cells_of
from tabloom.sources.writer import CellWriter, ErrorValue, Options, Sheet, Style, Styles, WorkbookWriter

from test_workbooks import DATES, NS, package, sheet_xml


def parsed(book, **k):
    rows = _Rows(book, book.sheets[0], k.get("formulas", False), k.get("serials", False), 16384)._parsed(book.container.stream(book.sheets[0].part))
    return [r for r in rows if r[1]]


def in_shares(book, n):
    out = []
    for i in range(n):
        for rows in book.blocks(book.sheets[0], share=(i, n)):
            out += cells_of(rows) if isinstance(rows, Grid) else rows
    return [r for r in out if r[1]]


CELLS = [
    '<c r="{r}"><v>{n}</v></c>', '<c r="{r}" s="1"><v>{n}</v></c>', '<c r="{r}" t="n" s="2"><v>4{n}.5</v></c>', '<c r="{r}" t="b"><v>{b}</v></c>', '<c r="{r}" t="e"><v>#N/A</v></c>',
    '<c r="{r}" t="inlineStr"><is><t>a &amp; b {n}</t></is></c>', '<c r="{r}" t="inlineStr"><is><t xml:space="preserve"> x_x0041_&#13;\r\n é😀 </t></is></c>', '<c r="{r}" t="str"><v>t&lt;{n}</v></c>',
    '<c r="{r}" t="s"><v>{b}</v></c>', '<c r="{r}"/>', '<c r="{r}" s="1"/>', '<c r="{r}" t="inlineStr"><is><t/></is></c>', '<c r="{r}" t="d"><v>2024-02-29T10:00:00</v></c>', '<c r="{r}"><f>A1*2</f><v>{n}</v></c>', "<c><v>{n}</v></c>", '<c r="{r}"><v></v></c>',
]
ODD = ['<c r="{r}"><v> {n}</v></c>', '<c r="{r}" t="str"><v>a</v><v>b</v></c>', "<c r='{r}'><v>{n}</v></c>", '<c r="{r}" t="inlineStr"><is><r><t>x</t></r><r><t>y</t></r></is></c>', '<c r="{r}" cm="1"><v>1</v></c>', '<c r="{r}" t="s"><v>77</v></c>', '<c r="{r}"><v>1e999</v></c>', '<c r="{r}" t="zz"><v>3</v></c>']


def random_sheet(rnd, odd):
    rows, number = [], 0
    for _ in range(rnd.randint(1, 60)):
        number += rnd.choice((1, 1, 1, 4))
        cells, column = [], 0
        for _ in range(rnd.randint(0, 12)):
            column += rnd.choice((1, 1, 1, 3))
            form = rnd.choice(ODD) if odd and rnd.random() < odd else rnd.choice(CELLS)
            letters = chr(64 + column) if column <= 26 else "A" + chr(64 + column - 26)
            cells.append(form.format(r=f"{letters}{number}", n=rnd.randint(0, 99999), b=rnd.randint(0, 1)))
        head = rnd.choice([f'<row r="{number}">', f'<row r="{number}" spans="1:9" ht="15">'])
        rows.append(rnd.choice(["", "\n "]) + (head + "".join(cells) + "</row>" if cells or rnd.random() < 0.5 else f'<row r="{number}"/>'))
    return sheet_xml("".join(rows))


@pytest.mark.parametrize("odd", [0, 0.01, 0.3])
def test_blocks_are_what_the_parser_reads(odd):
    rnd = random.Random(int(100 * odd) + 1)
    strings = f"<sst {NS}><si><t>zero</t></si><si><t>one</t></si></sst>"
    grids = 0
    for _ in range(60):
        book = Workbook(package(random_sheet(rnd, odd), styles=DATES, strings=strings))
        grids += any(isinstance(b, Grid) for b in book.blocks(book.sheets[0]))
        want = parsed(book)
        assert [*book.rows(book.sheets[0])] == want
        for n in (2, 3, 9):
            assert in_shares(book, n) == want
        assert [*book.rows(book.sheets[0], formulas=True)] == parsed(book, formulas=True)
        assert [*book.rows(book.sheets[0], serials=True)] == parsed(book, serials=True)
    assert grids > (50 if not odd else 5 if odd < 0.1 else -1)


def test_shares_of_odd_sheets():
    row = lambda k: f'<row r="{k}"><c r="A{k}"><v>{k}</v></c></row>'
    plain = "".join(map(row, range(1, 400)))
    more = "".join(map(row, range(400, 800)))
    for middle in ("<!-- </row> <row> -->", "</sheetData><sheetData>", f'<row r="399"><c r="B399" t="inlineStr"><is><t><![CDATA[</row>]]></t></is></c></row>'):
        book = Workbook(package(sheet_xml(plain + middle + more)))
        want = parsed(book)
        assert len(want) >= 799
        for n in (1, 2, 5, 16):
            assert in_shares(book, n) == want, (middle, n)
    for broken in (f"<worksheet {NS}><sheetData>{plain}", f"<worksheet {NS}><sheetData>{plain}</sheetData>"):
        book = Workbook(package(broken))
        for n in (1, 4):
            with pytest.raises(SheetError, match="XML_MALFORMED"):
                in_shares(book, n)


def test_cells_of_columns_are_those_of_values():
    values = {
        "d": [None, 0.0, -0.0, 1.5, 0.1 + 0.2, 1e21, 1e-7, 1e-300, float("nan"), float("inf"), 2.0**53, 1e15, -123456.789],
        "i": pa.array([None, 0, -5, 2**53, 2**53 + 1, -(2**53) - 1], pa.int64()),
        "b": [None, True, False], "s": [None, "", "a & <b>", " x", "tab\t", "cr\r", "\x01", "_x0041_", "é😀", "x" * 40_000, "😀" * 20_000, "_x004", "￾"],
        "t": pa.array([None, dt.datetime(2024, 2, 29, 12, 30, 0, 1500), dt.datetime(1899, 12, 30, 6), dt.datetime(1900, 1, 1), dt.datetime(1850, 5, 5), dt.datetime(9999, 12, 31), dt.datetime(1904, 1, 2)], pa.timestamp("us")),
        "day": pa.array([None, dt.date(2024, 2, 29), dt.date(1899, 1, 1)], pa.date32()), "dec": [None, decimal.Decimal("1.50"), decimal.Decimal("12345678901234567.25")], "nothing": pa.nulls(2),
    }
    for d1904 in (False, True):
        options = Options(d1904=d1904)
        for name, column in values.items():
            array = column if isinstance(column, pa.Array) else pa.array(column)
            styles = Styles()
            style = styles.id(Style(format=options.date_format))
            one, many = CellWriter(options, styles), CellWriter(options, styles)
            want = [one.cell(v, "") for v in array.to_pylist()]
            assert cellxml.column_xml(array, many, style).to_pylist() == want, name
            assert cellxml.column_xml(array.slice(1), CellWriter(options, styles), style).to_pylist() == want[1:]
            assert many.truncated == one.truncated
    with pytest.raises(SheetError, match="CELL_TOO_LONG"):
        cellxml.column_xml(pa.array(["x" * 40_000]), CellWriter(Options(overlong="error")), 1)


def test_large_sheets_are_read_by_several_tasks(spark):
    folder = scratch(spark)
    d = spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("t"), (F.col("id") % 3 == 0).alias("b")).coalesce(1)
    done = save(d, f"{folder}/one.xlsx")
    assert done == {"rows": 20_000, "columns": 3, "files": 1, "truncated": 0}
    back = load(spark, f"{folder}/one.xlsx", d.schema, splitBytes="50000")
    assert back.rdd.getNumPartitions() > 5 and sorted(map(tuple, back.collect())) == sorted(map(tuple, d.collect()))
    typed = load(spark, f"{folder}/one.xlsx", splitBytes="50000")
    assert [f.dataType.simpleString() for f in typed.schema] == ["double", "string", "boolean"] and typed.count() == 20_000
    cells = load(spark, f"{folder}/one.xlsx", mode="cells", splitBytes="50000")
    assert cells.count() == 60_003 and cells.where("row_index = 15000").count() == 3
    rows = load(spark, f"{folder}/one.xlsx", mode="array", splitBytes="50000").where("row_index > 19999")
    assert sorted(r["cells"][0]["n"] for r in rows.collect()) == [19_998.0, 19_999.0]


def test_filters_on_data_columns(spark):
    folder = scratch(spark)
    d = spark.createDataFrame([("a", "x", 1), ("b", "7", 2)], "sheet string, row_index string, n long")
    save(d, f"{folder}/t.xlsx")
    back = load(spark, f"{folder}/t.xlsx", d.schema)
    assert [r["n"] for r in back.where("sheet = 'b'").collect()] == [2]
    assert [r["n"] for r in back.where("row_index = 'x'").collect()] == [1]


def test_late_columns_and_types(spark):
    folder = scratch(spark)
    for name, rows in (("a", [["k", "v"], *[[i, i] for i in range(1, 1_500)]]), ("b", [["k", "w"], [5, "late"], [6, True]]), ("c", [["v"], ["text"]])):
        with open(f"{folder}/{name}.xlsx", "wb") as f:
            f.write(workbook_bytes({"s": rows}))
    d = load(spark, folder)
    assert [(f.name, f.dataType.simpleString()) for f in d.schema] == [("k", "double"), ("v", "string"), ("w", "string")]
    assert d.count() == 1_502 and {r["w"] for r in d.collect()} == {None, "late", "TRUE"} and d.where("v = 'text'").count() == 1
    with open(f"{folder}/a.xlsx", "rb") as f, open(f"{folder}/d.xlsx", "wb") as g:
        g.write(f.read())
    sampled = load(spark, f"{folder}/a.xlsx", sampleRows="3")
    assert sampled.count() == 1_499


def test_names_before_and_by_index(spark):
    folder = scratch(spark)
    rows = '<row r="1"><c r="C1" t="str"><v>x</v></c><c r="D1" t="str"><v>y</v></c></row><row r="2"><c r="A2"><v>1</v></c><c r="C2"><v>2</v></c></row>'
    with open(f"{folder}/t.xlsx", "wb") as f:
        f.write(package(sheet_xml(rows).replace("<sheetData>", '<dimension ref="C1:D2"/><sheetData>')).getvalue())
    assert load(spark, f"{folder}/t.xlsx").columns == ["x", "y"]
    d = load(spark, f"{folder}/t.xlsx", namesBefore="true")
    assert d.columns == ["__EMPTY", "__EMPTY_1", "x", "y"] and tuple(d.first()) == (1.0, None, 2.0, None)
    assert load(spark, f"{folder}/t.xlsx", headerNaming="index").columns == ["2", "3"]


def test_errors_dates_and_formulas(spark):
    folder = scratch(spark)
    rows = '<row r="1"><c r="A1" t="str"><v>e</v></c><c r="B1" t="str"><v>d</v></c><c r="C1" t="str"><v>f</v></c></row><row r="2"><c r="A2" t="e"><v>#N/A</v></c><c r="B2" s="1"><v>45351.5</v></c><c r="C2"><f>B2*2</f><v>5</v></c></row><row r="3"><c r="A3" t="e"><v>#REF!</v></c></row>'
    with open(f"{folder}/t.xlsx", "wb") as f:
        f.write(package(sheet_xml(rows), styles=DATES).getvalue())
    read = lambda **k: [tuple(r) for r in load(spark, f"{folder}/t.xlsx", **k).collect()]
    noon = dt.datetime(2024, 2, 29, 12)
    assert read() == [("#N/A", noon, 5.0), ("#REF!", None, None)]
    assert read(errors="null") == [(None, noon, 5.0)]
    assert read(dates="serial")[0][1] == 45351.5 and read(formulas="text")[0][2] == "=B2*2"
    assert [(r["e"]["kind"], r["e"]["err"]) for r in load(spark, f"{folder}/t.xlsx", errors="object").collect()] == [("e", "#N/A"), ("e", "#REF!")]
    utc = load(spark, f"{folder}/t.xlsx", dates="utc")
    assert utc.schema["d"].dataType.simpleString() == "timestamp" and utc.select(F.unix_timestamp("d")).first()[0] == 1709208000


def test_bytes_and_the_table_function(spark):
    folder = scratch(spark)
    with open(f"{folder}/t.xlsx", "wb") as f:
        f.write(workbook_bytes({"s": [["a", 1], ["b", True]], "t": [["c"]]}))
    books = spark.read.format("binaryFile").load(f"{folder}/t.xlsx")
    want = [("s", "A1", "a", None), ("s", "A2", "b", None), ("s", "B1", None, 1.0), ("s", "B2", None, None), ("t", "A1", "c", None)]
    assert sorted((r["sheet"], r["ref"], r["s"], r["n"]) for r in W.cells_of_bytes(books).collect()) == want
    W.register_table_functions(spark)
    books.createOrReplaceTempView("books")
    got = spark.sql("select c.sheet, c.ref, c.s, c.n from books, lateral xlsx_cells(content) c")
    assert sorted(tuple(r) for r in got.collect()) == want
    assert spark.sql("select c.ref from books, lateral xlsx_cells(content, map('sheet', 't')) c").count() == 1


def test_records_know_their_headers_and_limits(spark):
    folder = scratch(spark)
    with open(f"{folder}/t.xlsx", "wb") as f:
        f.write(workbook_bytes({"s": [["a", "b"], *[[k, k] for k in range(10)]]}))
    every, some = W.records(spark, f"{folder}/t.xlsx"), W.records(spark, f"{folder}/t.xlsx", maxRows="4")
    assert (every.headers, every.truncated, every.rows) == (["a", "b"], False, 10) and (some.truncated, some.rows, some.frame.count()) == (True, 4, 4)
    assert not W.records(spark, f"{folder}/t.xlsx", maxRows="10").truncated
    with pytest.raises(SheetError, match="LIMIT_EXCEEDED"):
        W.records(spark, f"{folder}/t.xlsx", most_cells=19)


def test_warnings_reach_the_caller(spark):
    folder = scratch(spark)
    rows = '<row r="1"><c r="A1" t="str"><v>a</v></c></row>' + "".join(f'<row r="{k}"><c r="A{k}" t="s"><v>9</v></c><c r="C{k}"><v>1</v></c><c r="E{k}"><v>1</v></c></row>' for k in range(2, 200))
    with open(f"{folder}/t.xlsx", "wb") as f:
        f.write(package(sheet_xml(rows), strings=f"<sst {NS}><si><t>x</t></si></sst>").getvalue())
    got = {r["code"]: (r["sheet"], r["ref"], r["cells"], r["columns"]) for r in W.read_warnings(spark, f"{folder}/t.xlsx", splitBytes="100").collect()}
    assert got == {"DATA_BEYOND_HEADER": ("Data", "C2", 396, [2, 4]), "SST_INDEX_OUT_OF_RANGE": ("Data", "A2", 0, [])}


def test_streams_miss_no_file(tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.xlsx").write_bytes(workbook_bytes({"s": [["x"], [1]]}))
    reader = XlsxStreamReader({"path": str(tmp_path)}, None)
    first = reader.latestOffset()
    assert [os.path.basename(p.path) for p in reader.partitions(reader.initialOffset(), first)] == ["a.xlsx", "b.xlsx"]
    (tmp_path / "0.xlsx").write_bytes(workbook_bytes({"s": [["x"], [1]]}))
    os.utime(tmp_path / "0.xlsx", (1, 1))  # put there later, but older
    second = XlsxStreamReader({"path": f"file://{tmp_path}"}, None).latestOffset()
    assert reader.latestOffset() == second != first
    assert [os.path.basename(p.path) for p in reader.partitions(first, second)] == ["0.xlsx"]


def test_targets_are_replaced_at_last(spark):
    folder = scratch(spark)
    small, target = spark.range(3), f"{folder}/t.xlsx"
    for layout in ("file", "folder", "folder", "file", "file"):
        save(small, target, layout=layout)
        assert load(spark, target).count() == 3
    with pytest.raises(Exception):  # noqa: B017
        save(spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x")), target)
    assert load(spark, target).count() == 3 and [n for n in os.listdir(folder) if n.startswith(".")] == []
    save(small, f"file://{folder}/u.xlsx")
    assert load(spark, f"file://{folder}/u.xlsx").count() == 3


def test_folders_are_cut_at_a_sheets_rows(spark):
    folder = scratch(spark)
    done = save(spark.range(100).coalesce(1), f"{folder}/many", layout="folder", maxRows="31")
    assert done["files"] == 4 and done["rows"] == 100 and load(spark, f"{folder}/many").count() == 100


def test_reads_after_close_and_failures():
    source = open_source(workbook_bytes({"s": [["a"]]}))
    book = Workbook(source)
    source.close()
    with pytest.raises(SheetError, match="ABORTED"):
        [*book.rows(book.sheets[0])]

    class Bad(io.BytesIO):
        def read(self, *a):
            raise OSError("gone")

    from tabloom.sources.datasource import _Guarded

    with pytest.raises(SheetError, match="IO_ERROR"):
        Workbook(_Guarded("x", Bad(b"PK\x03\x04")))


def test_styles_and_sheets_are_checked_first():
    for style in (Style(font={"size": 0}), Style(font={"size": True}), Style(font={"name": ""}), Style(font={"name": "a\x01"}), Style(fill="red"), Style(border={"left": "wavy"}), Style(alignment={"vertical": "up"}), Style(format=""), Style(format="x" * 256)):
        with pytest.raises(SheetError, match="WRITER_STATE"):
            Styles().id(style)
    for sheet in (Sheet("a", hidden="no"), Sheet("a", freeze=(0, 0)), Sheet("a", widths={-1: 5}), Sheet("a", merges=["A1"]), Sheet("a", merges=["A1:B2", "B2:C3"])):
        book = WorkbookWriter(lambda b: None)
        with pytest.raises(SheetError, match="WRITER_STATE"):
            book.add(sheet, [])
    book = WorkbookWriter(lambda b: None)
    with pytest.raises(SheetError, match="can't hold"):
        book.add("a", [[object()]])
    with pytest.raises(SheetError, match="can't hold"):  # the first failure stays
        book.add("b", [[1]])


def test_built_in_formats_and_application_part():
    styles = Styles()
    styles.id(Style(format="0.00")), styles.id(Style(format="h:mm")), styles.id(Style(format="0.000"))
    assert 'numFmtId="2"' in styles.xml() and 'numFmtId="20"' in styles.xml() and styles.xml().count("<numFmt ") == 1
    with zipfile.ZipFile(io.BytesIO(workbook_bytes({"a & b": [[1]], "c": [[2]]}))) as z:
        app = z.read("docProps/app.xml").decode()
    assert "<vt:lpstr>a &amp; b</vt:lpstr><vt:lpstr>c</vt:lpstr>" in app and "<vt:i4>2</vt:i4>" in app


def test_tar_members_and_ranges(spark, tmp_path):
    import tarfile

    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        for name, data in (("x/a.xlsx", b"1234567890"), ("b.txt", b"zz")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    got = {r["name"]: bytes(r["content"]) for r in W.tar_members(spark, f"{tmp_path}/t.tar.gz").collect()}
    assert got == {"x/a.xlsx": b"1234567890", "b.txt": b"zz"}
    (tmp_path / "f").write_bytes(b"0123456789")
    ranges = spark.createDataFrame([(f"{tmp_path}/f", 2, 3), (f"{tmp_path}/f", 0, 1)], "path string, offset long, length long")
    assert sorted(bytes(r["content"]) for r in W.fetch_ranges(ranges).collect()) == [b"0", b"234"]


def test_reads_can_be_cancelled(spark):
    import threading
    import time

    from tabloom.cluster import cancellable

    slow = spark.range(4, numPartitions=4).mapInPandas(lambda frames: (time.sleep(60) or f for f in frames), "id long")
    with cancellable(spark) as cancel, pytest.raises(Exception, match="(?i)cancel"):
        threading.Timer(2, cancel).start()
        began = time.time()
        slow.collect()
    assert time.time() - began < 40 and spark.range(3).count() == 3


def test_decimals_and_misfits(spark):
    folder = scratch(spark)
    d = spark.sql("select cast(1.25 as decimal(10,2)) as a, cast('12345678901234567890.5' as decimal(30,1)) as b, cast(null as decimal(5,1)) as c, 'x' as t")
    save(d, f"{folder}/t.xlsx")
    assert load(spark, f"{folder}/t.xlsx", d.schema).collect() == d.collect()
    other = "a double, t double"
    assert tuple(load(spark, f"{folder}/t.xlsx", other).first()) == (1.25, None)
    with pytest.raises(Exception) as caught:
        load(spark, f"{folder}/t.xlsx", other, misfits="error").collect()
    assert error_code(caught.value) == "TYPE_MISMATCH"
    os.makedirs(f"{folder}/.t.xlsx-123/ready")
    with open(f"{folder}/.t.xlsx-123/ready/part.xlsx", "wb") as f:
        f.write(b"not yet there")
    assert load(spark, folder, d.schema).count() == 1
