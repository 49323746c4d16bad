"""The registered queries over workbooks and cells, each with the same question in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as X
from ..operators import relations as R
from ..sources.datasource import filesystem
from ..sources.writer import Options, Sheet
from ..streaming.events import follow, tumbling_counts
from .workbooks import as_cells, load, round_trip, save, scratch, sheet_catalogue, write_workbook


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Scans and sinks


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def xlsx_roundtrip_nation(spark, sf):
    return round_trip(table(spark, sf, "nation"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders")
def xlsx_roundtrip_orders(spark, sf):
    return round_trip(table(spark, sf, "orders")).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query("""
    SELECT event_id, user_id, event_type, value, props, strftime(date_trunc('milliseconds', ts + INTERVAL 500 MICROSECOND),
    '%Y-%m-%d %H:%M:%S.%g') AS ts FROM events
""")
def xlsx_roundtrip_events(spark, sf):
    return round_trip(table(spark, sf, "events")).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def xlsx_pricing_summary(spark, sf):
    """The flagship: line items written as workbooks in parallel, the columns asked for scanned back and aggregated."""
    items, path = table(spark, sf, "lineitem").repartition(spark.sparkContext.defaultParallelism), f"{scratch(spark)}/items"
    save(items, path, layout="folder")
    needed = items.select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    d = load(spark, path, as_cells(needed.schema))
    return d.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("count_order"),
    )


def _strings(mode: str):
    def run(spark, sf):
        path = f"{scratch(spark)}/book.xlsx"
        frame = table(spark, sf, "nation").orderBy("n_nationkey")
        write_workbook(path, {"nation": frame, "region": table(spark, sf, "region")}, Options(strings=mode))
        return load(spark, path, frame.schema, sheet="nation")

    return run


for _mode in ("inline", "shared", "auto"):
    QUERIES[f"xlsx_strings_{_mode}"] = _strings(_mode)
    SQL[f"xlsx_strings_{_mode}"] = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1904-01-01'")
def xlsx_roundtrip_1904(spark, sf):
    return round_trip(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), date1904="true").select("o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN event_type END, 'none') AS event_type FROM events")
def xlsx_records_default(spark, sf):
    sparse = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type"))
    return round_trip(sparse, read={"defval": "none"})


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) + 1 AS r FROM customer) WHERE r BETWEEN 11 AND 30")
def xlsx_row_window(spark, sf):
    path = f"{scratch(spark)}/book.xlsx"
    frame = table(spark, sf, "customer").select("c_custkey").orderBy("c_custkey")
    save(frame, path)
    return load(spark, path, frame.schema, headers=json.dumps(["c_custkey"]), startRow="11", maxRows="20")


@query("SELECT CAST(r AS INTEGER) AS row_index, CASE WHEN r % 3 = 1 THEN 1 ELSE 0 END AS filled FROM range(1, 41) t(r)")
def xlsx_blank_rows(spark, sf):
    path = f"{scratch(spark)}/book.xlsx"
    frame = spark.range(1, 41).select(F.when(F.col("id") % 3 == 1, F.col("id")).alias("v")).coalesce(1)
    save(frame, path, header="false")
    rows = load(spark, path, mode="array")
    return R.fill_row_gaps(rows, 1, 40).select("row_index", F.when(F.size("cells") > 0, 1).otherwise(0).alias("filled"))


@query("SELECT * FROM (VALUES ('Name'), ('Name_1'), ('__EMPTY'), ('Amount'), ('Name_2')) t(name)")
def xlsx_header_names(spark, sf):
    from .workbooks import workbook_bytes

    path = f"{scratch(spark)}/book.xlsx"
    store, inner = filesystem(path)
    with store.open_output_stream(inner) as f:
        f.write(workbook_bytes({"s": [["Name", "Name", None, "Amount", "Name"], [1, 2, 3, 4, 5]]}))
    return spark.createDataFrame([(n,) for n in load(spark, path).columns], "name string")


@query("SELECT * FROM (VALUES (0, 'nation', 'visible'), (1, 'Hidden', 'hidden'), (2, 'nation (2)', 'visible')) t(\"index\", name, state)")
def xlsx_sheet_catalogue(spark, sf):
    path, small = f"{scratch(spark)}/book.xlsx", table(spark, sf, "region")
    write_workbook(path, {"a": small, "b": small, "c": small}, looks={"a": Sheet("nation"), "b": Sheet("Hidden", hidden="hidden"), "c": Sheet("NATION".lower())})
    return sheet_catalogue(spark, path).select("index", "name", "state")


@query("""
    SELECT 'A' || (r + 1) AS ref, CAST(r_regionkey AS DOUBLE) AS n, NULL AS s FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS r
    FROM region) WHERE r <= 3 UNION ALL SELECT 'B' || (r + 1), NULL, r_name FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS r
    FROM region) WHERE r <= 3 UNION ALL SELECT 'A1', NULL, 'r_regionkey' UNION ALL SELECT 'B1', NULL, 'r_name'
""")
def xlsx_head(spark, sf):
    path = f"{scratch(spark)}/book.xlsx"
    save(table(spark, sf, "region").orderBy("r_regionkey"), path)
    heads = R.head_map(load(spark, path, mode="cells", maxRows="4"), 4)
    return heads.select(F.explode("cells").alias("ref", "cell")).select("ref", "cell.n", "cell.s")


@query("SELECT 's' AS sheet, count(*) AS cells, 2 AS columns, 2 AS first_column, 3 AS last_column, 'C2' AS first_ref FROM nation, range(2)")
def xlsx_beyond_header(spark, sf):
    path = f"{scratch(spark)}/book.xlsx"
    frame = table(spark, sf, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name", F.lit(1).alias("c"), F.lit(2).alias("d"))
    save(frame, path, sheet="s")
    cells = R.beyond_header(load(spark, path, mode="cells"), 1)
    return cells.select("sheet", "cells", F.col("columns").cast("int").alias("columns"), "first_column", "last_column", "first_ref")


@query("SELECT max(r) + 1 AS rows, 4 AS columns, (count(*) + 1) * 4 AS cells FROM (SELECT row_number() OVER () AS r FROM customer)")
def xlsx_extent(spark, sf):
    path = f"{scratch(spark)}/book.xlsx"
    save(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), path)
    return R.sheet_extent(load(spark, path, mode="cells")).select(F.col("rows").cast("long").alias("rows"), "columns", "cells")


@query("""
    SELECT event_type, count(*) AS events, round(sum(value), 4) AS total, strftime(time_bucket(INTERVAL 1 HOUR, date_trunc('milliseconds',
    ts + INTERVAL 500 MICROSECOND)), '%Y-%m-%d %H:%M:%S') AS start FROM events GROUP BY ALL
""")
def events_stream_tumbling(spark, sf):
    folder = scratch(spark)
    source = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    for k in range(2):
        save(source.where(F.col("event_id") % 2 == k), f"{folder}/in/part-{k}", layout="folder") if _made(f"{folder}/in") else None
    counted = tumbling_counts(follow(spark, f"{folder}/in", as_cells(source.schema)), "ts", "1000 days", "1 hour", "event_type")
    # Each trigger's whole result replaces the one before, in files: it may be larger than the driver.
    running = counted.writeStream.foreachBatch(lambda d,
        _: d.write.mode("overwrite").parquet(f"{folder}/out")).outputMode("complete").trigger(availableNow=True).option("checkpointLocation",
        f"{folder}/state").start()
    running.awaitTermination()
    out = spark.read.schema(counted.schema).parquet(f"{folder}/out")
    return out.select("event_type", "events", F.round("total", 4).alias("total"), F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


def _made(folder: str) -> bool:
    store, inner = filesystem(folder)
    store.create_dir(inner, recursive=True)
    return True


# Values


@query("SELECT o_orderkey, epoch_ms(o_orderdate) / 86400000.0 + 25569 AS serial FROM orders")
def excel_serial_from_ts(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.serial_from_timestamp(F.col("o_orderdate")).alias("serial"))


@query("""
    SELECT l_orderkey, l_linenumber, strftime(TIMESTAMP '1899-12-30' + to_days(CAST(floor(l_quantity * 700) AS INTEGER) + 61), '%Y-%m-%d')
    AS day FROM lineitem
""")
def excel_ts_from_serial(spark, sf):
    serial = F.floor(F.col("l_quantity") * 700) + 61
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.date_format(X.timestamp_from_serial(serial), "yyyy-MM-dd").alias("day"))


@query("""
    SELECT CAST(serial AS DOUBLE) AS serial, day FROM (VALUES (0.0, '1899-12-30'), (1.0, '1900-01-01'), (59.0, '1900-02-28'), (60.0,
    '1900-03-01'), (61.0, '1900-03-01'), (45351.5, '2024-02-29'), (-1.0, NULL), (3e6, NULL)) t(serial, day)
""")
def excel_serial_edges(spark, sf):
    d = spark.sql("SELECT * FROM (VALUES (0D), (1D), (59D), (60D), (61D), (45351.5D), (-1D), (3e6D)) t(serial)")
    return d.select("serial", F.date_format(X.timestamp_from_serial(F.col("serial")), "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS t FROM events")
def excel_iso_parse(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf, "events").select("event_id", F.date_format(X.timestamp_from_iso(text), "yyyy-MM-dd HH:mm:ss").alias("t"))


#: Codes of which only those at odd places are dates.
_CODES = ["0.00", "yyyy-mm-dd", '"day" 0', "[h]:mm", "General", "h AM/PM", "[Red]0", "[mm]", "0\\d", "[$-409]d", "[Red", "d[Red", '"s', "a/p", "_d0*y", "[hh"]


@query("SELECT p_partkey, p_partkey % 16 % 2 = 1 AS is_date FROM part")
def excel_date_formats(spark, sf):
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("p_partkey") % len(_CODES) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", X.is_date_code(code).alias("is_date"))


@query("""
    SELECT CAST(i AS INTEGER) AS i, CASE WHEN i < 26 THEN chr(CAST(65 + i AS INTEGER)) WHEN i < 702 THEN chr(CAST(65 + (i - 26) // 26 AS
    INTEGER)) || chr(CAST(65 + (i - 26) % 26 AS INTEGER)) ELSE chr(CAST(65 + (i - 702) // 676 AS INTEGER)) || chr(CAST(65 + (i - 702) // 26
    % 26 AS INTEGER)) || chr(CAST(65 + (i - 702) % 26 AS INTEGER)) END AS letters, CAST(i AS INTEGER) AS back FROM range(16384) t(i)
""")
def excel_column_letters(spark, sf):
    d = spark.range(16384).select(F.col("id").cast("int").alias("i"), X.column_letters(F.col("id")).alias("letters"))
    return d.select("i", "letters", X.column_index(F.col("letters")).alias("back"))


@query("""
    SELECT * FROM (VALUES ('A1', 'A1'), ('B2:A1', 'A1:B2'), ('$C$3:D4', 'C3:D4'), ('XFD1048576', 'XFD1048576'), ('XFE1', NULL), ('A0',
    NULL), ('a1', NULL), ('A1:B2:C3', NULL)) t(text, range)
""")
def excel_ranges(spark, sf):
    d = spark.sql("SELECT * FROM (VALUES ('A1'), ('B2:A1'), ('$C$3:D4'), ('XFD1048576'), ('XFE1'), ('A0'), ('a1'), ('A1:B2:C3')) t(text)")
    r = X.parse_range(F.col("text"))
    return d.withColumn("r", r).select("text", X.format_range(F.col("r.top"), F.col("r.left"), F.col("r.bottom"), F.col("r.right")).alias("range"))


@query("""
    SELECT page_id, length(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS chars,
    md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM pages
""")
def excel_encode_text(spark, sf):
    text = X.encode_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(text).cast("long").alias("chars"), F.md5(text).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def excel_decode_text(spark, sf):
    hidden = F.concat(F.replace(F.col("text"), F.lit(" "), F.lit("_x0020_")), F.lit("_x00e9__xD83d_"))
    back = F.regexp_replace(X.decode_text(hidden), ".{2}\\z", "")
    return table(spark, sf, "documents").select("doc_id", F.md5(back).alias("digest"))


@query("""
    SELECT doc_id, CASE WHEN length(t) > 32767 THEN 32767 ELSE length(t) END AS chars, md5(CASE WHEN length(t) > 32767 THEN left(t, 32764)
    || '...' ELSE t END) AS digest, length(t) > 32767 AS cut FROM (SELECT doc_id, repeat(text, 12) AS t FROM documents)
""")
def excel_truncate_cells(spark, sf):
    text = F.repeat("text", F.lit(12))
    short = X.limit_text(F.col("t"), suffix="...")
    return table(spark, sf, "documents").select("doc_id", text.alias("t")).select("doc_id", F.length(short).cast("long").alias("chars"),
        F.md5(short).alias("digest"), (X.utf16_units(F.col("t")) > 32767).alias("cut"))


@query("""SELECT page_id, CASE WHEN length(n) > 31 THEN regexp_replace(left(n, 31), '[ '']+$', '') ELSE n END AS name
    FROM (SELECT page_id, trim(regexp_replace(url, '[\\\\/?*:\\[\\]]', '_', 'g'), ' ') AS n FROM pages)""")
def excel_sheet_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.clean_sheet_name(F.col("url")).alias("name"))


@query("""
    SELECT text, CAST(number AS DOUBLE) AS number FROM (VALUES ('1', 1.0), (' 2.50 ', 2.5), ('-0', 0.0), ('1e3', 1000.0), ('.5', 0.5),
    ('0x1F', NULL), ('inf', NULL), ('NaN', NULL), ('1d', NULL), ('', NULL), ('1e999', NULL)) t(text, number)
""")
def excel_parse_number(spark, sf):
    texts = ["1", " 2.50 ", "-0", "1e3", ".5", "0x1F", "inf", "NaN", "1d", "", "1e999"]
    return spark.createDataFrame([(t,) for t in texts], "text string").select("text", X.parse_number(F.col("text")).alias("number"))


@query("""
    WITH v AS (SELECT p_partkey, p_retailprice / CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 700000 WHEN 3 THEN -0.003 ELSE
    1e9 END AS x FROM part), e AS (SELECT *, CAST(floor(log10(abs(x))) AS INTEGER) AS e FROM v), f AS ( SELECT *,
    regexp_replace(regexp_replace(CASE WHEN e < -6 THEN '' WHEN e < 0 THEN printf('%.9f', x) WHEN e = 0 THEN printf('%.9f', x) WHEN e = 1
    THEN printf('%.8f', x) WHEN e = 2 THEN printf('%.7f', x) WHEN e = 3 THEN printf('%.6f', x) WHEN e = 4 THEN printf('%.5f', x) WHEN e = 5
    THEN printf('%.4f', x) WHEN e = 6 THEN printf('%.3f', x) ELSE '' END, '0+$', ''), '[.]$', '') AS short, printf('%.5e', x) AS long FROM
    e) SELECT p_partkey, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) WHEN e >= -4 THEN short ELSE
    regexp_replace(regexp_replace(regexp_extract(long, '^[^e]+'), '0+$', ''), '[.]$', '') || 'E' || regexp_extract(long, 'e(.+)$', 1) END AS
    general, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS
    VARCHAR) END AS number FROM f JOIN part USING (p_partkey)
""")
def excel_general_number(spark, sf):
    X.register_functions(spark)
    part = F.when(F.col("p_partkey") % 5 == 0, 1.0)
    for k, by in ((1, 7.0), (2, 700_000.0), (3, -0.003)):
        part = part.when(F.col("p_partkey") % 5 == k, by)
    d = table(spark, sf, "part").withColumn("x", F.col("p_retailprice") / part.otherwise(1e9))
    return d.select("p_partkey", F.expr("general_text(x)").alias("general"), F.expr("number_text(p_retailprice)").alias("number"))


#: What stands before a page's text, by its number; the kinds that follow are written out in the SQL.
_HEADS = ["", "504B0304", "504B0506", "D0CF11E0A1B11AE1", "EFBBBF", "FFFE", "00010203FF", "3C3F786D6C3E", "3C613E", "636166E92C78",
    "D0CF11E0A1B11AE1" + "EncryptedPackage".encode("utf-16-le").hex()]


@query("""
    SELECT page_id, CASE page_id % 11 WHEN 1 THEN 'zip' WHEN 2 THEN 'empty-zip' WHEN 3 THEN 'xls' WHEN 6 THEN 'unknown' WHEN 10 THEN
    'encrypted' WHEN 5 THEN 'utf-16' WHEN 0 THEN CASE WHEN html IS NULL OR html = '' THEN 'empty' WHEN regexp_matches(html,
    '^\\s*(<!doctype html|<html)', 'i') THEN 'html' ELSE 'other' END WHEN 4 THEN CASE WHEN html IS NULL OR html = '' THEN 'unknown' WHEN
    regexp_matches(html, '^\\s*(<!doctype html|<html)', 'i') THEN 'html' ELSE 'other' END WHEN 7 THEN CASE WHEN regexp_matches(left('<?xml>'
    || coalesce(html, ''), 2000), '<html[\\s>]', 'i') THEN 'html' ELSE 'xml' END WHEN 8 THEN CASE WHEN regexp_matches(left('<a>' ||
    coalesce(html, ''), 2000), '<html[\\s>]', 'i') THEN 'html' ELSE 'xml' END ELSE 'text' END AS kind FROM pages
""")
def sniff_formats(spark, sf):
    """Pages as they are, and behind the first bytes of other kinds of files."""
    head = F.element_at(F.array(*[F.unhex(F.lit(h)) for h in _HEADS]), (F.col("page_id") % len(_HEADS) + 1).cast("int"))
    content = F.concat(head, F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    wide = F.concat(head, F.encode(F.coalesce("html", F.lit("")), "UTF-16LE"))
    kind = X.sniff_kind(F.when(F.col("page_id") % len(_HEADS) == 5, wide).otherwise(content))
    # UTF-16 text may be of any kind of text; what counts is that it is read at all.
    return table(spark, sf, "pages").select("page_id", F.when((F.col("page_id") % len(_HEADS) == 5) & kind.isin("html", "xml", "text", "unknown"),
        "utf-16").otherwise(kind).alias("kind"))


# Relations


@query("""
    SELECT count(*) AS "references", count(DISTINCT l_returnflag || l_linestatus || l_quantity) AS unique_count, (SELECT sum(length(t)) FROM
    (SELECT DISTINCT l_returnflag || l_linestatus || l_quantity AS t FROM lineitem))::BIGINT AS chars FROM lineitem
""")
def dictionary_stats(spark, sf):
    text = F.concat("l_returnflag", "l_linestatus", F.col("l_quantity").cast("string"))
    return R.dictionary_stats(table(spark, sf, "lineitem").select(text.alias("t")), "t").select("references", "unique_count", "chars")


@query("""
    SELECT text, first, "references", row_number() OVER (ORDER BY first) - 1 AS id FROM (SELECT c_name[10:] AS text, min(c_custkey) AS
    first, count(*) AS "references" FROM customer GROUP BY ALL)
""")
def dictionary_encode(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", F.substring("c_name", 10, 100).alias("t"))
    return R.dictionary(d, "t", "c_custkey")


def _rectangles(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select(k.alias("id"), (F.col("o_custkey") % 50).alias("sheet"), (k * 7 % 500).alias("top"), (k * 13 % 90).alias("left"),
        (k * 7 % 500 + k % 9).alias("bottom"), (k * 13 % 90 + k % 5).alias("right"))


@query("""
    WITH r AS (SELECT o_orderkey AS id, o_custkey % 50 AS sheet, o_orderkey * 7 % 500 AS top, o_orderkey * 13 % 90 AS "left", o_orderkey * 7
    % 500 + o_orderkey % 9 AS bottom, o_orderkey * 13 % 90 + o_orderkey % 5 AS "right" FROM orders) SELECT a.sheet, a.id AS a, b.id AS b
    FROM r a JOIN r b ON a.sheet = b.sheet AND a.id < b.id AND a.top <= b.bottom AND a.bottom >= b.top AND a."left" <= b."right" AND
    a."right" >= b."left"
""")
def merge_overlaps(spark, sf):
    """The rectangles of all orders, whatever their status."""
    return R.overlapping_ranges(_rectangles(table(spark, sf, "orders")))


@query("""
    WITH c AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'number' WHEN p_partkey % 5 = 0 THEN
    'number-read-as-text' ELSE 'match' END AS category FROM part), u AS (SELECT category FROM c UNION ALL SELECT 'unexpected' FROM range(3))
    SELECT 'part' AS sheet, category, count(*) AS cells FROM u GROUP BY category UNION ALL SELECT 'part', NULL, count(*) FROM u UNION ALL
    SELECT NULL, NULL, count(*) FROM u
""")
def typed_diff_report(spark, sf):
    k = F.col("p_partkey")
    none = {c: F.lit(None).cast(t) for c, t in (("s", "string"), ("n", "double"), ("b", "boolean"), ("ts", "timestamp_ntz"), ("err", "string"))}
    base = table(spark, sf, "part").select(F.lit("part").alias("sheet"), k.alias("row_index"), F.lit(0).alias("col_index"), F.lit("n").alias("kind"),
        F.col("p_retailprice").alias("n"), *[v.alias(c) for c, v in none.items() if c != "n"])
    row = F.col("row_index")
    text = (row % 5 == 0) & (row % 7 != 0)
    changed = base.where(row % 11 != 0).withColumn("s", F.when(text, F.col("n").cast("string"))).withColumn("kind",
        F.when(text, "s").otherwise("n")).withColumn("n", F.when(text, F.lit(None)).when(row % 7 == 0, F.col("n") + 1).otherwise(F.col("n")))
    extra = spark.range(3).select(F.lit("part").alias("sheet"), (F.col("id") + 10_000_000).alias("row_index"), F.lit(0).alias("col_index"),
        F.lit("n").alias("kind"), F.lit(1.0).alias("n"), *[v.alias(c) for c, v in none.items() if c != "n"])
    return R.difference_report(R.compare_cells(base, changed.unionByName(extra)))


@query("""
    SELECT event_type, count(*) AS runs, (SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT 'file' || lpad(CAST(event_id AS VARCHAR), 9,
    '0') AS f FROM events x WHERE x.event_type = e.event_type ORDER BY f LIMIT 5)) AS examples FROM events e GROUP BY event_type
""")
def audit_summary(spark, sf):
    runs = table(spark, sf, "events").select("event_type", F.concat(F.lit("file"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("file"))
    return R.audit_summary(runs, "event_type", "file")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def audit_top_slowest(spark, sf):
    return R.top_by(table(spark, sf, "events").select("event_id", "value"), "value", 10, "event_id")


@query("""
    SELECT a.was, b.now, count(*) AS files FROM (SELECT o_orderkey, o_orderstatus AS was FROM orders WHERE o_orderkey % 3 <> 0) a JOIN
    (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'F' ELSE o_orderstatus END AS now FROM orders WHERE o_orderkey % 4 <> 0) b USING
    (o_orderkey) GROUP BY ALL
""")
def audit_transitions(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    now = o.where("o_orderkey % 4 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "F").otherwise(F.col("o_orderstatus")))
    return R.transitions(o.where("o_orderkey % 3 <> 0"), now, "o_orderkey", "o_orderstatus")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def audit_resume(spark, sf):
    """Who is left to do: customers without an urgent order, of which there are some."""
    done = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return R.resume(table(spark, sf, "customer").select("c_custkey"), done, "c_custkey")


@query("""
    WITH m AS (SELECT event_type, user_id % 4 AS size, median(value) AS median FROM events GROUP BY ALL), r AS (SELECT m.median / b.median
    AS ratio FROM m JOIN m b ON m.size = b.size AND b.event_type = (SELECT min(event_type) FROM events)) SELECT CASE WHEN ratio IS NULL THEN
    'not run' WHEN ratio <= 1.0 THEN 'pass' ELSE 'fail' END AS verdict, count(*) AS gates FROM r GROUP BY ALL
""")
def bench_gates(spark, sf):
    runs = table(spark, sf, "events").withColumn("size", F.col("user_id") % 4)
    baseline = runs.agg(F.min("event_type")).first()[0]
    return R.gates(R.ratios(R.run_medians(runs, ["event_type", "size"], "value"), "event_type", baseline, ["size"]), 1.0)


@query("""
    SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' ||
    event_id), event_id) AS k FROM events) WHERE k <= 20
""")
def stratified_sample(spark, sf):
    return R.stratified_sample(table(spark, sf, "events").select("event_type", "event_id"), "event_type", "event_id", 20)


@query("""
    SELECT o_orderpriority, max(CASE WHEN o_orderstatus = 'F' THEN n END) AS "F", max(CASE WHEN o_orderstatus = 'O' THEN n END) AS "O",
    max(CASE WHEN o_orderstatus = 'P' THEN n END) AS "P" FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY
    ALL) GROUP BY ALL
""")
def verdict_matrix(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return R.verdict_matrix(n, "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "n")


@query("""
    SELECT tag, string_agg(CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS items FROM (SELECT DISTINCT
    unnest(string_split(p_type, ' ')) AS tag, p_size FROM part) GROUP BY tag
""")
def tag_index(spark, sf):
    return R.tag_index(table(spark, sf, "part").select("p_size", F.split("p_type", " ").alias("tags")), "p_size", "tags")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(-1.0 AS DOUBLE) ELSE c_acctbal END AS c_acctbal FROM customer")
def manifest_upsert(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return R.latest_by_key(old, old.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.lit(-1.0)), "c_custkey")


@query("""
    SELECT workbook, position, CASE WHEN k = 1 THEN name ELSE left(name, 31 - length(' (' || k || ')')) || ' (' || k || ')' END AS name FROM
    (SELECT *, row_number() OVER (PARTITION BY workbook, lower(name) ORDER BY position) AS k FROM (SELECT c_nationkey AS workbook, c_custkey
    AS position, left(c_mktsegment || repeat('x', CAST(c_custkey % 2 * 30 AS INTEGER)), 31) AS name FROM customer))
""")
def unique_sheet_names(spark, sf):
    name = F.concat("c_mktsegment", F.repeat(F.lit("x"), (F.col("c_custkey") % 2 * 30).cast("int")))
    return R.unique_sheet_names(table(spark, sf, "customer").select(F.col("c_nationkey").alias("workbook"), F.col("c_custkey").alias("position"),
        name.alias("name")))


from . import rule_queries, sheet_queries  # noqa: E402, F401  (they add theirs)
