"""Queries over workbooks made by hand from a table's rows: what readers make of odd packages, and options of reads."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from ..errors import SheetError, error_code
from ..functions.cells import encode_text
from ..sources.container import ZipOut
from ..sources.datasource import filesystem
from ..sources.writer import Options, Sheet, Style, WorkbookWriter
from .queries import query, table
from .workbooks import as_cells, cells_of_bytes, load, package_parts, read_warnings, records, register_table_functions, round_trip, save, save_rows, scan_errors, scratch, sheet_catalogue, workbook_bytes, write_workbook, zip_entries

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"


def package(parts: dict[str, str | bytes], level: int = 6) -> bytes:
    """An archive of parts as they are."""
    out: list[bytes] = []
    box = ZipOut(out.append)
    for name, text in parts.items():
        box.whole(name, text.encode() if isinstance(text, str) else text, level)
    box.close()
    return b"".join(out)


def book(rows: str, head: str = "", styles: str = "", strings: str = "", sheets: str = "", relations: str = "", more: dict | None = None,
    target: str = "worksheets/sheet1.xml", kind: str = SHEET_TYPE) -> bytes:
    """A workbook of one sheet, Data, whose rows are markup."""
    extra = [("styles", "styles.xml")] * bool(styles) + [("sharedStrings", "sharedStrings.xml")] * bool(strings)
    rels = f'<Relationship Id="rId1" Type="{OFFICE}/worksheet" Target="{target}"/>{relations}' + "".join(f'<Relationship Id="x{k}" Type="{OFFICE}/{t}" Target="{p}"/>' for k, (t, p) in enumerate(extra))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{TYPES}"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}"/></Types>',
        "_rels/.rels": f'<Relationships><Relationship Id="r" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {MAIN} xmlns:r="{OFFICE}"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f"<Relationships>{rels}</Relationships>",
        "xl/worksheets/sheet1.xml": f"<worksheet {MAIN}>{head}<sheetData>{rows}</sheetData></worksheet>",
    }
    parts |= {"xl/styles.xml": f"<styleSheet {MAIN}>{styles}</styleSheet>"} if styles else {}
    parts |= {"xl/sharedStrings.xml": f"<sst {MAIN}>{strings}</sst>"} if strings else {}
    return package(parts | (more or {}))


def text(value: str, ref: str = "") -> str:
    at = f' r="{ref}"' if ref else ""
    return f'<c{at} t="inlineStr"><is><t>{encode_text(value)}</t></is></c>'


def number(value, ref: str = "", style: int = 0) -> str:
    at, look = f' r="{ref}"' if ref else "", f' s="{style}"' if style else ""
    return f"<c{at}{look}><v>{value}</v></c>"


def put(spark, data: bytes, name: str = "book.xlsx", folder: str | None = None) -> str:
    path = f"{folder or scratch(spark)}/{name}"
    store, inner = filesystem(path)
    with store.open_output_stream(inner) as f:
        f.write(data)
    return path


def nations(spark, sf) -> list:
    """The small table that the workbooks below are made from: its rows, by key."""
    return table(spark, sf, "nation").orderBy("n_nationkey").collect()


# Places


@query("""
    SELECT 'A' || (n_nationkey + 5) AS ref, CAST(n_nationkey AS DOUBLE) AS n, NULL AS s FROM nation UNION ALL SELECT 'B' || (n_nationkey +
    5), NULL, n_name FROM nation
""")
def xlsx_places_inferred(spark, sf):
    """Cells without references, in rows of which only the first has a number."""
    rows = "".join(f'<row{" r=\"5\"" if not r[0] else ""}>{number(r[0])}{text(r[1])}</row>' for r in nations(spark, sf))
    return load(spark, put(spark, book(rows)), mode="cells").select("ref", "n", "s")


@query("""
    SELECT CAST(n_nationkey * 2 + 1 AS INTEGER) AS row_index, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 4 ELSE 2 END AS INTEGER) AS cells,
    CAST(CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS filled FROM nation
""")
def xlsx_dense_rows(spark, sf):
    """Holes are null, blank cells at the ends of rows and blank rows are nothing."""
    rows = "".join(f'<row r="{2 * r[0] + 1}">{text(r[1], f"B{2 * r[0] + 1}")}{number(1, f"D{2 * r[0] + 1}") if r[0] % 3 == 0 else f"<c r=\"D{2 * r[0] + 1}\" s=\"0\"/>"}</row><row r="{2 * r[0] + 2}"><c r="A{2 * r[0] + 2}"/></row>' for r in nations(spark, sf))
    d = load(spark, put(spark, book(rows)), mode="array")
    return d.select("row_index", F.size("cells").alias("cells"), F.size(F.filter("cells", lambda c: c.isNotNull())).alias("filled"))


@query("SELECT CAST(n_nationkey AS DOUBLE) AS key, n_name AS name FROM nation")
def xlsx_joined_sheet_data(spark, sf):
    """Two sheetData elements are one run of rows."""
    made = [f"<row>{number(r[0])}{text(r[1])}</row>" for r in nations(spark, sf)]
    rows = f"<row>{text('key')}{text('name')}</row>{''.join(made[:10])}</sheetData><sheetData>{''.join(made[10:])}"
    return load(spark, put(spark, book(rows)))


@query("SELECT l_returnflag, count(*) AS rows, sum(l_quantity) AS quantity, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY ALL")
def xlsx_shares_of_a_sheet(spark, sf):
    """Sheets of all line items, each read by many tasks."""
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_shipdate")
    back = round_trip(d, read={"splitBytes": "100000"})
    return back.groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.sum("l_quantity").alias("quantity"), F.count_distinct("l_orderkey").alias("orders"))


# Headers and columns


def _with_header(spark, sf, header: str, before: str = "", head: str = "", column: int = 0) -> str:
    letters = [chr(65 + column), chr(66 + column)]
    rows = "".join(f'<row r="{r[0] + 4}">{number(r[0], f"{letters[0]}{r[0] + 4}")}{text(r[1], f"{letters[1]}{r[0] + 4}")}</row>' for r in nations(spark, sf))
    return put(spark, book(before + header + rows, head))


@query("SELECT CAST(n_nationkey AS DOUBLE) AS key, n_name AS name FROM nation")
def xlsx_header_row(spark, sf):
    """The header in a row told, behind other rows."""
    before = f'<row r="1">{text("a report", "A1")}</row><row r="2">{number(7, "C2")}</row>'
    return load(spark, _with_header(spark, sf, f'<row r="3">{text("key", "A3")}{text("name", "B3")}</row>', before), headerRow="3")


@query("SELECT n_name AS name FROM nation")
def xlsx_without_empty_headers(spark, sf):
    return load(spark, _with_header(spark, sf, f'<row r="3">{text("name", "B3")}{text("", "C3")}</row>', head='<dimension ref="A3:C28"/>'), dropEmptyHeaders="true")


@query('SELECT CAST(n_nationkey AS DOUBLE) AS "__EMPTY", n_name AS name FROM nation')
def xlsx_declared_columns(spark, sf):
    """Columns begin where the sheet says, even if the header has nothing there."""
    return load(spark, _with_header(spark, sf, f'<row r="3">{text("name", "D3")}</row>', head='<dimension ref="C3:D28"/>', column=2))


@query('SELECT CAST(NULL AS VARCHAR) AS "__EMPTY", CAST(n_nationkey AS DOUBLE) AS "__EMPTY_1", n_name AS name FROM nation')
def xlsx_columns_before(spark, sf):
    """Columns left of the header's first one have names too, if asked for."""
    return load(spark, _with_header(spark, sf, f'<row r="3">{text("name", "C3")}</row>', head='<dimension ref="C3:C28"/>', column=1), namesBefore="true")


@query("SELECT CAST(n_nationkey AS DOUBLE) AS k, n_name AS name, NULL AS late FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def xlsx_late_columns(spark, sf):
    """A folder whose files have different columns: all of them, null where a file lacks one."""
    folder = scratch(spark)
    save(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")),
        f"{folder}/in/a.xlsx") if _folder(f"{folder}/in") else None
    save(table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("late")), f"{folder}/in/b.xlsx")
    return load(spark, f"{folder}/in")


def _folder(path: str) -> bool:
    store, inner = filesystem(path)
    store.create_dir(inner, recursive=True)
    return True


@query("""
    SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CASE WHEN p_partkey > (SELECT max(p_partkey) - 100 FROM part) THEN p_brand ELSE
    CAST(p_size AS VARCHAR) END AS value FROM part
""")
def xlsx_late_types(spark, sf):
    """A column of numbers whose last rows are texts keeps them all; no sheet takes more than it holds."""
    parts, folder = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), scratch(spark)
    count, most = parts.agg(F.count("*"), F.max("p_partkey")).first()
    ordered = parts.repartitionByRange(max(1, -(-count // 250_000)), "p_partkey").sortWithinPartitions("p_partkey")
    save_rows(ordered, folder, ["p_partkey", "value"], lambda key, brand, size: [key, brand if key is not None and key > most - 100 else size])
    return load(spark, folder)


@query("SELECT CAST(o_orderkey AS BIGINT) AS row_index, o_orderpriority AS sheet FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderkey > 5000")
def xlsx_data_named_like_places(spark, sf):
    """Data columns that are called as the reader's own are filtered as data."""
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_index"), F.col("o_orderpriority").alias("sheet"))
    return round_trip(d).where("sheet = '2-HIGH' and row_index > 5000")


@query("SELECT s_suppkey, s_name, '_' || s_nationkey AS file FROM supplier")
def xlsx_rows_by_file(spark, sf):
    """Where records come from."""
    d, folder = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), scratch(spark)
    for (k,) in d.select("s_nationkey").distinct().collect():
        save(d.where(F.col("s_nationkey") == k).drop("s_nationkey"), f"{folder}/in/n_{k}.xlsx") if _folder(f"{folder}/in") else None
    from pyspark.sql.types import StringType, StructField, StructType

    plain = as_cells(d.drop("s_nationkey").schema)
    got = load(spark, f"{folder}/in", StructType([*plain.fields, StructField("_path", StringType()), StructField("_sheet", StringType())]), pathColumn="true")
    return got.select("s_suppkey", "s_name", F.regexp_extract("_path", r"(_\d+)\.xlsx$", 1).alias("file"))


# Values


@query("""
    SELECT CAST(n_nationkey AS DOUBLE) AS k, CASE n_nationkey % 3 WHEN 0 THEN '#N/A' WHEN 1 THEN '#REF!' ELSE 'fine' END AS v, CASE WHEN
    n_nationkey % 3 < 2 THEN 'e' ELSE 's' END AS kind FROM nation
""")
def xlsx_error_cells(spark, sf):
    """Errors as text, and as cells that say what they are."""
    cell = lambda k: f"<c t=\"e\"><v>{('#N/A', '#REF!')[k % 3]}</v></c>" if k % 3 < 2 else text("fine")
    path = put(spark, book(f"<row>{text('k')}{text('v')}</row>" + "".join(f"<row>{number(r[0])}{cell(r[0])}</row>" for r in nations(spark, sf))))
    kinds = load(spark, path, errors="object").select("k", F.col("v.kind").alias("kind"))
    return load(spark, path).join(kinds, "k")


@query("SELECT CAST(n_nationkey AS DOUBLE) AS k FROM nation WHERE n_nationkey % 3 = 2")
def xlsx_errors_as_nothing(spark, sf):
    """Rows of errors alone are no records, if errors are null."""
    rows = "".join(f"<row>{number(r[0]) if r[0] % 3 == 2 else '<c t="e"><v>#DIV/0!</v></c>'}</row>" for r in nations(spark, sf))
    return load(spark, put(spark, book(f"<row>{text('k')}</row>{rows}")), errors="null")


@query("SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, epoch_ms(o_orderdate) / 86400000.0 + 25569 AS o_orderdate FROM orders")
def xlsx_dates_as_serials(spark, sf):
    path = f"{scratch(spark)}/books"
    save(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), path, layout="folder")
    return load(spark, path, dates="serial")


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS instant FROM orders")
def xlsx_dates_as_instants(spark, sf):
    path = f"{scratch(spark)}/books"
    save(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), path, layout="folder")
    return load(spark, path, dates="utc").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.unix_timestamp("o_orderdate").alias("instant"))


@query("SELECT CAST(n_nationkey AS DOUBLE) AS k, CASE WHEN n_nationkey % 2 = 0 THEN '=A' || (n_nationkey + 2) || '*2' ELSE n_name END AS v FROM nation")
def xlsx_formula_texts(spark, sf):
    cell = lambda r: f"<c><f>A{r[0] + 2}*2</f><v>{2 * r[0]}</v></c>" if r[0] % 2 == 0 else text(r[1])
    rows = "".join(f"<row>{number(r[0])}{cell(r)}</row>" for r in nations(spark, sf))
    return load(spark, put(spark, book(f"<row>{text('k')}{text('v')}</row>{rows}")), formulas="text")


@query("SELECT n_name || ' and ' || n_nationkey AS s FROM nation")
def xlsx_rich_strings(spark, sf):
    """Shared strings of several runs, with readings that are no part of them, some of them used twice."""
    rows = nations(spark, sf)
    strings = "".join(f"<si><r><t>{r[1]}</t></r><r><rPr><b/></rPr><t xml:space=\"preserve\"> and </t></r><r><t>{r[0]}</t></r><rPh sb=\"0\" eb=\"1\"><t>no</t></rPh></si>" for r in rows)
    return load(spark, put(spark, book("".join(f'<row><c t="s"><v>{r[0]}</v></c></row>' for r in rows), strings=strings)), mode="cells").select("s")


@query("SELECT CAST(k AS INTEGER) AS xf, k IN (1, 2, 4) AS is_date FROM range(6) t(k)")
def xlsx_cell_formats(spark, sf):
    """Which formats make a number a date: built-in ones, a table's own, and own ones in place of built-in ones."""
    styles = '<numFmts><numFmt numFmtId="170" formatCode="dd/mm"/><numFmt numFmtId="171" formatCode="0.0 &quot;d&quot;"/><numFmt numFmtId="15" formatCode="0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="47"/><xf numFmtId="15"/></cellXfs>'
    path = put(spark, book("<row>" + "".join(number(45_000, style=k) for k in range(6)) + "</row>", styles=styles))
    return load(spark, path, mode="cells").select("xf", (F.col("kind") == "d").alias("is_date"))


@query("SELECT strftime(TIMESTAMP '2024-01-01' + to_days(CAST(n_nationkey AS INTEGER)), '%Y-%m-%d') AS day FROM nation")
def xlsx_iso_dates(spark, sf):
    """Cells of type d, as strict workbooks have them."""
    rows = "".join(f'<row><c t="d"><v>{dt.date(2024, 1, 1) + dt.timedelta(days=r[0])}T00:00:00</v></c></row>' for r in nations(spark, sf))
    return load(spark, put(spark, book(rows)), mode="cells").select(F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("SELECT n_nationkey, n_name || chr(10) || '<&>' || chr(1) || '_x0041_ ' AS v FROM nation")
def xlsx_markup_in_texts(spark, sf):
    """Texts that look like markup or escapes come back as they were."""
    d = table(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit("\n<&>\x01_x0041_ ")).alias("v"))
    return round_trip(d)


# Sheets and packages


@query("SELECT CAST(n_nationkey AS DOUBLE) AS k FROM nation")
def xlsx_sheet_in_any_case(spark, sf):
    path = f"{scratch(spark)}/book.xlsx"
    write_workbook(path, {"Other": table(spark, sf, "region"), "Nation": table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))})
    return load(spark, path, sheet="NATION")


@query("""
    SELECT 'Data' AS name, 'worksheet' AS kind, 'visible' AS state, 25 AS cells UNION ALL SELECT 'Chart', 'chartsheet', 'visible', 0 UNION
    ALL SELECT 'Away', 'worksheet', 'veryHidden', 1
""")
def xlsx_kinds_of_sheets(spark, sf):
    """A chart sheet has no cells; a hidden one has, and says that it is."""
    rows = "".join(f"<row>{number(r[0])}</row>" for r in nations(spark, sf))
    more = {"xl/chartsheets/sheet1.xml": f"<chartsheet {MAIN}/>",
        "xl/worksheets/sheet3.xml": f"<worksheet {MAIN}><sheetData><row>{number(1)}</row></sheetData></worksheet>"}
    relations = f'<Relationship Id="rId2" Type="{OFFICE}/chartsheet" Target="chartsheets/sheet1.xml"/>'
    path = put(spark, book(rows,
        sheets='<sheet name="Chart" sheetId="2" r:id="rId2"/><sheet name="Away" sheetId="3" state="veryHidden" r:id="gone"/>', relations=relations, more=more))
    cells = load(spark, path, mode="cells").groupBy("sheet").agg(F.count("*").alias("n"))
    sheets = sheet_catalogue(spark, path)
    return sheets.join(cells, sheets["name"] == cells["sheet"], "left").select("name", "kind", "state", F.coalesce("n", F.lit(0)).cast("int").alias("cells"))


@query("SELECT CAST(n_nationkey AS DOUBLE) AS n, CAST(k AS INTEGER) AS file FROM nation, range(4) t(k)")
def xlsx_names_of_parts(spark, sf):
    """Targets in another case, from the root, with backslashes, and with dots."""
    rows, out = "".join(f"<row>{number(r[0])}</row>" for r in nations(spark, sf)), None
    for k, target in enumerate(("WORKSHEETS/Sheet1.XML", "/xl/worksheets/sheet1.xml", "worksheets\\sheet1.xml", "./other/../worksheets/sheet1.xml")):
        one = load(spark, put(spark, book(rows, target=target)), mode="cells").select("n", F.lit(k).alias("file"))
        out = one if out is None else out.unionByName(one)
    return out


_SQL_REFUSED = """SELECT * FROM (VALUES ('csv', 'NOT_XLSX'), ('docx', 'NOT_XLSX'), ('doctype', 'XML_DOCTYPE'), ('empty', 'NOT_XLSX'), ('encrypted', 'ENCRYPTED'), ('legacy', 'LEGACY_XLS'), ('ods', 'ODS'), ('twice', 'ZIP_DUPLICATE_ENTRY'),
    ('truncated', 'ZIP_TRUNCATED'), ('xlsb', 'XLSB'), ('zip', 'NOT_XLSX')) t(name, code)"""


@query(_SQL_REFUSED)
def xlsx_refused_files(spark, sf):
    """What is no workbook, or none that can be read, by the code of the error."""
    ole, fine, folder = bytes.fromhex("D0CF11E0A1B11AE1"), book(f"<row>{text(nations(spark, sf)[0][1])}</row>"), scratch(spark)
    files = {
        "csv": b"a,b\n1,2\n", "empty": b"", "legacy": ole + bytes(600), "encrypted": ole + bytes(100) + "EncryptedPackage".encode("utf-16-le"),
            "zip": package({"a.txt": "x"}),
        "ods": package({"mimetype": "application/vnd.oasis.opendocument.spreadsheet"}, 0),
            "docx": book("", kind="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"),
        "xlsb": book("", kind="application/vnd.ms-excel.sheet.binary.macroEnabled.main"), "truncated": fine[: len(fine) // 2], "fine": fine,
            "twice": package({"a.xml": "x", "b.xml": "y"}).replace(b"b.xml", b"a.xml"),
        "doctype": package({"[Content_Types].xml": "<!DOCTYPE x><Types/>"}),
    }
    for name, data in files.items():
        put(spark, data, f"{name}.xlsx", folder)
    return scan_errors(spark, folder).select(F.regexp_extract("path", r"(\w+)\.xlsx$", 1).alias("name"), "code")


def _code(read) -> str | None:
    try:
        read().count()
    except Exception as e:  # the error of a task comes back as Spark's
        if (code := error_code(e)) is None:
            raise
        return code
    return None


@query("""
    SELECT * FROM (VALUES ('columns', 'LIMIT_EXCEEDED'), ('text', 'LIMIT_EXCEEDED'), ('strings', 'LIMIT_EXCEEDED'), ('entries',
    'LIMIT_EXCEEDED'), ('depth', 'LIMIT_EXCEEDED'), ('row', 'LIMIT_EXCEEDED'), ('inflated', 'ZIP_BOMB'), ('past the grid',
    'ROW_OUT_OF_RANGE'), ('no such sheet', 'SHEET_NOT_FOUND'), ('no such file', 'IO_ERROR'), ('records', 'LIMIT_EXCEEDED'), ('checksum',
    'ZIP_CRC_MISMATCH'), ('cut short', 'XML_MALFORMED'), ('sampled', 'TYPE_MISMATCH')) t(name, code)
""")
def xlsx_limits(spark, sf):
    """Limits of a read, and what passing them is called."""
    names = [r[1] for r in nations(spark, sf)]
    many = "".join(f"<row>{''.join(text(n) for n in names)}</row>" for _ in range(40))
    plain = put(spark, book(many))
    shared = put(spark, book('<row><c t="s"><v>0</v></c></row>', strings="".join(f"<si><t>{n}</t></si>" for n in names)))
    past = put(spark, book('<row r="1"><c r="XFE1"><v>1</v></c></row>'))
    mixed = put(spark, workbook_bytes({"s": [["v"], *[[k] for k in range(10)], ["late"]]}))
    deep = put(spark, book('<row><c t="s"><v>0</v></c></row>', strings=f"<si>{'<r>' * 300}<t>a</t>{'</r>' * 300}</si>"))
    spoiled = workbook_bytes({"s": [["checked"]]}, Options(level=0))
    spoiled = spoiled.replace(b"checked", b"chocked", 1)
    cut = put(spark, package_cut(f"<row>{text('a')}</row>"))
    cells = lambda path, **k: (lambda: load(spark, path, mode="cells", **k))
    reads = {
        "columns": cells(plain, maxColumns="10"), "text": cells(plain, maxTextLength="3"), "strings": cells(shared, maxSharedStringChars="50"),
            "entries": cells(plain, maxEntries="2"), "depth": cells(deep), "row": cells(plain, maxRowChars="20"),
        "inflated": cells(plain, maxInflatedBytes="600"), "past the grid": cells(past), "no such sheet": cells(plain, sheet="Nothing"),
            "no such file": cells(f"{plain}.gone"), "records": lambda: records(spark, plain, most_cells=20).frame,
        "checksum": cells(put(spark, spoiled)), "cut short": cells(cut), "sampled": lambda: load(spark, mixed, sampleRows="3"),
    }
    return spark.createDataFrame([(n, _code(read)) for n, read in reads.items()], "name string, code string")


def package_cut(rows: str) -> bytes:
    """A workbook whose sheet ends before its elements do."""
    return book("", more={"xl/worksheets/sheet1.xml": f"<worksheet {MAIN}><sheetData>{rows}"})


@query("""
    SELECT * FROM (VALUES ('[Content_Types].xml'), ('_rels/.rels'), ('docProps/app.xml'), ('docProps/core.xml'),
    ('xl/_rels/workbook.xml.rels'), ('xl/styles.xml'), ('xl/workbook.xml'), ('xl/worksheets/sheet1.xml')) t(name)
""")
def xlsx_package_entries(spark, sf):
    """The entries of a package that is written without packing: as large as their contents, with no two in one place."""
    path = put(spark, workbook_bytes({"s": [[r[0], r[1]] for r in nations(spark, sf)]}, Options(level=0)))
    d = zip_entries(spark, path)
    return d.where((F.col("method") == 0) & (F.col("packed") == F.col("size"))).groupBy("name").agg(F.count("*").alias("n")).where("n = 1").select("name")


@query("SELECT CAST(count(*) AS BIGINT) AS crc_matches FROM nation")
def xlsx_checksums(spark, sf):
    """Checksums of entries are those of their contents."""
    parts = {f"n{r[0]}.txt": r[1] for r in nations(spark, sf)}
    d = zip_entries(spark, put(spark, package(parts)))
    want = spark.createDataFrame(list(parts.items()), "name string, content string")
    return d.join(want, "name").where(F.crc32("content") == F.col("crc")).agg(F.count("*").alias("crc_matches"))


@query("SELECT count(DISTINCT n_regionkey) + 1 AS formats, count(DISTINCT n_regionkey) AS fills, count(*) AS cells FROM nation")
def xlsx_styles_kept_once(spark, sf):
    """A style for each region, used by every nation of it, is written once."""
    rows, out = nations(spark, sf), []
    writer = WorkbookWriter(out.append)
    writer.add("s", [[r[1]] for r in rows], styles=lambda k: Style(fill=f"#0000{rows[k][2]:02d}"))
    writer.close()
    path = put(spark, b"".join(out))
    styles = package_parts(spark, path, ["xl/styles.xml"]).select(F.regexp_extract("part0", r"<cellXfs count=\"(\d+)\"",
        1).cast("long").alias("formats"), F.regexp_count("part0", F.lit('patternType="solid"')).cast("long").alias("fills"))
    cells = load(spark, path, mode="cells").where("xf > 0").count()
    return styles.withColumn("cells", F.lit(cells).cast("long"))


@query("SELECT count(*) AS merges, 'A2' AS pane, count(*) + 1 AS \"rows\" FROM region")
def xlsx_sheet_looks(spark, sf):
    """Merged ranges, a frozen row, a filter over all that was written."""
    rows, out = table(spark, sf, "region").orderBy("r_regionkey").collect(), []
    writer = WorkbookWriter(out.append)
    writer.add(Sheet("s", freeze=(1, 0), merges=[f"C{k + 2}:D{k + 2}" for k in range(len(rows))], auto_filter=True, widths={0: 20.0}),
        [["key", "name"], *[[r[0], r[1]] for r in rows]])
    writer.close()
    d = package_parts(spark, put(spark, b"".join(out)), ["xl/worksheets/sheet1.xml"])
    return d.select(F.regexp_extract("part0", r'<mergeCells count="(\d+)"', 1).cast("long").alias("merges"),
        F.regexp_extract("part0", 'topLeftCell="([A-Z0-9]+)"', 1).alias("pane"),
        F.regexp_extract("part0", r'<autoFilter ref="A1:B(\d+)"', 1).cast("long").alias("rows"))


# What a caller is told


@query("""SELECT count(*) AS "rows", 2 AS columns, 1 AS files, count(*) FILTER (length(text) * 12 > 32767) AS truncated FROM documents""")
def xlsx_write_report(spark, sf):
    """How many rows, columns and files were written, and how many texts were cut."""
    done = save(table(spark, sf, "documents").select("doc_id", F.repeat("text", F.lit(12)).alias("t")), f"{scratch(spark)}/book.xlsx")
    return spark.createDataFrame([tuple(done[c] for c in ("rows", "columns", "files", "truncated"))], "rows long, columns int, files int, truncated long")


@query("""
    SELECT most, least(most, n) AS "rows", most < n AS truncated, 'n_nationkey,n_name,n_regionkey' AS headers FROM (VALUES (10), (24), (25),
    (30)) t(most), (SELECT count(*) AS n FROM nation)
""")
def xlsx_records_cut_off(spark, sf):
    """Whether a limit of rows left any out."""
    path, out = f"{scratch(spark)}/book.xlsx", []
    save(table(spark, sf, "nation").orderBy("n_nationkey"), path)
    for most in (10, 24, 25, 30):
        r = records(spark, path, maxRows=str(most))
        out.append((most, r.rows, r.truncated, ",".join(r.headers)))
    return spark.createDataFrame(out, "most int, rows long, truncated boolean, headers string")


@query("""
    SELECT 'DATA_BEYOND_HEADER' AS code, 'Data' AS sheet, 'C2' AS ref, count(*) AS cells, '[2]' AS columns FROM nation UNION ALL SELECT
    'SST_INDEX_OUT_OF_RANGE', 'Data', 'B2', 0, '[]'
""")
def xlsx_warnings(spark, sf):
    """Each warning once for a sheet, with the first place it is about."""
    rows = "".join(f'<row r="{r[0] + 2}">{number(r[0], f"A{r[0] + 2}")}<c r="B{r[0] + 2}" t="s"><v>99</v></c>{number(1, f"C{r[0] + 2}")}</row>' for r in nations(spark, sf))
    path = put(spark, book(f'<row r="1">{text("a", "A1")}{text("b", "B1")}</row>{rows}', strings="<si><t>x</t></si>"))
    return read_warnings(spark, path).select("code", "sheet", "ref", "cells", F.to_json("columns").alias("columns"))


@query("""
    SELECT 'nation' AS sheet, CAST(n_nationkey + 1 AS INTEGER) AS row_index, n_name AS s FROM nation UNION ALL SELECT 'region',
    CAST(r_regionkey + 1 AS INTEGER), r_name FROM region
""")
def xlsx_cells_of_bytes(spark, sf):
    """Workbooks that are a column of bytes."""
    path = put(spark, workbook_bytes({"nation": [[r[1]] for r in nations(spark, sf)],
        "region": [[r[1]] for r in table(spark, sf, "region").orderBy("r_regionkey").collect()]}))
    return cells_of_bytes(spark.read.format("binaryFile").load(path)).select("sheet", "row_index", "s")


@query("SELECT CAST(n_nationkey + 1 AS INTEGER) AS row_index, n_name AS s FROM nation")
def xlsx_cells_function(spark, sf):
    """The table function, from SQL."""
    path = put(spark, workbook_bytes({"nation": [[r[1]] for r in nations(spark, sf)], "other": [["x"]]}))
    register_table_functions(spark)
    spark.read.format("binaryFile").load(path).createOrReplaceTempView("books__")
    return spark.sql("SELECT c.row_index, c.s FROM books__, LATERAL xlsx_cells(content, map('sheet', 'nation')) c")


@query("SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT ceil(count(*) / 999.0) AS files, count(*) AS n FROM customer) t")
def xlsx_folder_of_sheets(spark, sf):
    """A frame as a folder of workbooks of at most 1,000 rows each with the header, read back as one."""
    d, path = table(spark, sf, "customer").select("c_custkey", "c_name"), f"{scratch(spark)}/many"
    done = save(d.coalesce(1), path, layout="folder", maxRows="1000")
    back = load(spark, path, as_cells(d.schema))
    full = -(-done["rows"] // 999) == done["files"]
    return back.agg(F.lit(int(full)).cast("long").alias("files"), F.count_distinct("c_custkey").alias("rows"))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def xlsx_overwritten(spark, sf):
    """A target that was a folder, then a file, holds what was written last; what failed left it as it was."""
    d, folder = table(spark, sf, "nation").select("n_nationkey", "n_name"), scratch(spark)
    path = f"{folder}/target"
    save(table(spark, sf, "region"), path, layout="folder")
    save(d.unionByName(d), path)
    try:
        save(d.withColumn("n_name", F.raise_error(F.lit("stopped")).cast("string")), path)
    except SheetError:
        raise
    except Exception as e:  # the failure that is asked for
        if "stopped" not in str(e):
            raise
    return load(spark, path, as_cells(d.schema))


@query("SELECT CAST(n_nationkey AS DOUBLE) AS k, n_name AS name FROM nation")
def xlsx_headers_told(spark, sf):
    """Names given by the caller, from the first column on, and rows to leave out before."""
    rows = [["a", "b"], ["c", "d"], *[[r[0], r[1]] for r in nations(spark, sf)]]
    return load(spark, put(spark, workbook_bytes({"s": rows})), headers=json.dumps(["k", "name"]), headerRow="2")


@query("""
    SELECT * FROM (VALUES ('append', 'WRITER_STATE'), ('array', 'WRITER_STATE'), ('map', 'WRITER_STATE'), ('overlong', 'CELL_TOO_LONG'),
    ('no sheet', 'WRITER_STATE'), ('all hidden', 'WRITER_STATE'), ('merges', 'WRITER_STATE'), ('freeze', 'WRITER_STATE'), ('colour',
    'WRITER_STATE'), ('font size', 'WRITER_STATE'), ('border', 'WRITER_STATE'), ('format', 'WRITER_STATE'), ('error cell', 'WRITER_STATE'),
    ('columns', 'ROW_OUT_OF_RANGE'), ('bytes', 'LIMIT_EXCEEDED')) t(name, code)
""")
def xlsx_writer_refusals(spark, sf):
    """What is not written, and what that is called."""
    from ..sources.writer import ErrorValue

    small, path = table(spark, sf, "region"), f"{scratch(spark)}/book.xlsx"
    save(small, path)

    def made(sheet=None, rows=(), style=None):
        def run():
            writer = WorkbookWriter(lambda data: None)
            if sheet is not None:
                writer.add(sheet, rows, style)
            writer.close()

        return run

    acts = {
        "append": lambda: small.write.format("tabloom.xlsx").mode("append").save(path),
            "array": lambda: save(small.select(F.array("r_name").alias("a")), path),
            "map": lambda: save(small.select(F.create_map("r_name", "r_name").alias("m")), path),
        "overlong": lambda: save(small.select(F.repeat("r_name", F.lit(9_000)).alias("t")), path, overlong="error"), "no sheet": made(),
            "all hidden": made(Sheet("a", hidden="hidden")), "merges": made(Sheet("a", merges=["A1:B2", "B2:C3"])),
        "freeze": made(Sheet("a", freeze=(0, 0))), "colour": made("a", [[1]], Style(fill="red")),
            "font size": made("a", [[1]], Style(font={"size": 500})), "border": made("a", [[1]], Style(border={"top": "wavy"})),
            "format": made("a", [[1]], Style(format="")),
        "error cell": made("a", [[ErrorValue("nothing")]]), "columns": made("a", [[1] * 16_385]), "bytes": lambda: workbook_bytes({"a": [["x" * 1_000]]}, most=100),
    }
    out = []
    for name, act in acts.items():
        try:
            act()
            out.append((name, None))
        except Exception as e:
            if error_code(e) is None:
                raise
            out.append((name, error_code(e)))
    return spark.createDataFrame(out, "name string, code string")


@query("SELECT 2 AS writes, 1 AS kinds, '2026-01-01T00:00:00Z' AS created")
def xlsx_same_bytes(spark, sf):
    """The same rows written twice are the same bytes, with a set time in the document's properties."""
    rows = [[r[0], r[1]] for r in nations(spark, sf)]
    books = [workbook_bytes({"s": rows}) for _ in range(2)]
    core = package_parts(spark, put(spark, books[0]), ["docProps/core.xml"]).select(F.regexp_extract("part0", r">([0-9TZ:-]+)</dcterms:created>", 1)).first()[0]
    return spark.createDataFrame([(len(books), len(set(books)), core)], "writes int, kinds int, created string")


@query("SELECT count(*) AS \"references\", count(DISTINCT n_regionkey) AS unique_count, false AS frozen FROM nation")
def xlsx_shared_string_table(spark, sf):
    """What the writer says of its table of shared strings."""
    out: list[bytes] = []
    writer = WorkbookWriter(out.append, Options(strings="shared"))
    writer.add("s", [[f"region {r[2]}"] for r in nations(spark, sf)])
    told = writer.close()["strings"]
    return spark.createDataFrame([(told["count"], told["unique"], told["frozen"])], "references long, unique_count long, frozen boolean")

