"""Queries over cell rules and relations, each on a table of the data folder and with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import relations as R
from .datasets import dataset, draw, xorshift32
from .queries import query, table

# Texts


@query("""
    SELECT doc_id, left(t, 1) = ' ' OR right(t, 1) = ' ' OR contains(t, chr(10)) OR contains(t, chr(9)) OR contains(t, chr(13)) AS space
    FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' ' || t WHEN 1 THEN t || ' ' ELSE t END AS t FROM (SELECT doc_id, left(text, 20) AS t
    FROM documents)) WHERE t IS NOT NULL
""")
def excel_space_preserve(spark, sf):
    t = F.substring("text", 1, 20)
    t = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" "), t)).when(F.col("doc_id") % 4 == 1, F.concat(t, F.lit(" "))).otherwise(t)
    return table(spark, sf, "documents").select("doc_id", X.needs_space(t).alias("space")).where("space is not null")


@query("""
    SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"',
    '&quot;'), chr(9), '&#9;'), chr(10), '&#10;'), chr(13), '&#13;')) AS attribute, md5(replace(replace(replace(html, '&', '&amp;'), '<',
    '&lt;'), '>', '&gt;')) AS text FROM pages
""")
def excel_escape_markup(spark, sf):
    """Names and titles as markup; what XML does not allow is dropped, here two characters put in for that."""
    t = F.concat(F.col("html"), F.lit("\x01￾"))
    return table(spark, sf, "pages").select("page_id", F.md5(X.escape_attribute(t)).alias("attribute"), F.md5(X.escape_text(t)).alias("text"))


@query("""
    SELECT doc_id, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM (SELECT doc_id,
    replace(replace(text, chr(10), chr(13) || chr(10)), ' the ', chr(13)) AS text FROM documents)
""")
def excel_line_ends(spark, sf):
    t = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), F.lit(" the "), F.lit("\r"))
    return table(spark, sf, "documents").select("doc_id", F.md5(X.line_ends(t)).alias("digest"))


@query("SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE left(text, 57) || '... (' || length(text) || ' chars)' END AS preview FROM documents")
def excel_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("""
    WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '''' || p_name WHEN 2 THEN replace(p_name, ' ', '_') ELSE
    p_name || '''s' END AS name FROM part) SELECT p_partkey, length(name) BETWEEN 1 AND 31 AND left(name, 1) <> '''' AND trim(name) = name
    AS valid, CASE WHEN regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*') THEN name ELSE '''' || replace(name, '''', '''''') || '''' END AS
    quoted FROM n
""")
def excel_quote_names(spark, sf):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    name = F.when(k == 0, name).when(k == 1, F.concat(F.lit("'"), name)).when(k == 2, F.replace(name, F.lit(" "), F.lit("_"))).otherwise(F.concat(name, F.lit("'s")))
    return table(spark, sf, "part").select("p_partkey", X.valid_sheet_name(name).alias("valid"), X.quote_sheet_name(name).alias("quoted"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE 'FF' || upper(substr(md5(c_name), 3, 6)) END AS colour FROM customer")
def excel_colours(spark, sf):
    six = F.substring(F.md5("c_name"), 3, 6)
    text = F.element_at(F.array(F.concat(F.lit("#"), six), six, F.concat(F.lit("80"), six), F.concat(F.lit("x"), six)), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", X.colour(text).alias("colour"))


# Numbers and times


@query("""
    SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_id % 5 IN (1, 2) END AS value, CASE WHEN event_id % 5 IN (1, 2) THEN
    'TRUE' WHEN event_id % 5 < 4 THEN 'FALSE' END AS shown FROM events
""")
def excel_booleans(spark, sf):
    text = F.element_at(F.array(*map(F.lit, ("0", "1", " true", "yes", " "))), (F.col("event_id") % 5 + 1).cast("int"))
    value = X.parse_boolean(text)
    return table(spark, sf, "events").select("event_id", value.alias("value"), X.boolean_text(value).alias("shown"))


@query("""
    SELECT o_orderkey, CASE WHEN v <= 9007199254740992 THEN CAST(v AS DOUBLE) END AS n, CASE WHEN v > 9007199254740992 THEN CAST(v AS
    VARCHAR) END AS s FROM (SELECT o_orderkey, 9007199254740992 + CAST(o_orderkey % 7 AS BIGINT) - 3 AS v FROM orders)
""")
def excel_whole_or_text(spark, sf):
    v = X.whole_or_text(F.lit(2**53) + (F.col("o_orderkey") % 7).cast("long") - 3)
    return table(spark, sf, "orders").select("o_orderkey", v["n"].alias("n"), v["s"].alias("s"))


@query("SELECT p_partkey, p_partkey % 3 <> 2 AS same FROM part")
def excel_same_number(spark, sf):
    x = F.col("p_retailprice")
    y = F.when(F.col("p_partkey") % 3 == 0, x).when(F.col("p_partkey") % 3 == 1, x * (1 + 2.0**-52)).otherwise(x * (1 + 1e-13))
    return table(spark, sf, "part").select("p_partkey", X.same_number(x, y).alias("same"))


@query("""
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN millisecond(ts) % 1000 = 0 THEN '' ELSE strftime(ts, '.%g') END AS iso,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events
""")
def excel_iso_text(spark, sf):
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", X.iso_text(ts).alias("iso"), X.document_stamp(ts).alias("stamp"))


@query("""
    SELECT l_orderkey, l_linenumber, k AS id, k BETWEEN 14 AND 22 OR k BETWEEN 27 AND 36 OR k BETWEEN 45 AND 47 OR k BETWEEN 50 AND 58 OR k
    BETWEEN 71 AND 81 AS is_date FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 100 AS INTEGER) AS k FROM lineitem)
""")
def excel_date_ids(spark, sf):
    k = (F.col("l_partkey") % 100).cast("int")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", k.alias("id"), X.is_date_id(k).alias("is_date"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 22 WHEN 3 THEN 40 WHEN 4 THEN 49 ELSE -1 END AS id FROM part")
def excel_builtin_formats(spark, sf):
    code = F.element_at(F.array(*map(F.lit, ("General", "0.00", "m/d/yy h:mm", "#,##0.00;[Red](#,##0.00)", "@", "0.000"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", X.builtin_format_id(code).alias("id"))


@query("""
    SELECT s_suppkey, CASE WHEN s_suppkey = 0 THEN 'A1' ELSE 'A1:' || chr(CAST(65 + s_suppkey % 26 AS INTEGER)) || (s_suppkey + 1) END AS
    range, '$A$1:$' || chr(CAST(65 + s_suppkey % 26 AS INTEGER)) || '$' || (s_suppkey + 1) AS absolute FROM supplier
""")
def excel_sheet_ranges(spark, sf):
    rows, columns = F.col("s_suppkey") + 1, F.col("s_suppkey") % 26 + 1
    return table(spark, sf, "supplier").select("s_suppkey", X.sheet_range(rows, columns).alias("range"),
        X.sheet_range(rows, columns, absolute=True).alias("absolute"))


@query("""
    SELECT l_orderkey, l_linenumber, chr(CAST(65 + l_suppkey % 26 AS INTEGER)) || (l_partkey % 1000 + 1) AS ref, CAST(l_partkey % 1000 + 1
    AS INTEGER) AS "row", CAST(l_suppkey % 26 AS INTEGER) AS "column" FROM lineitem
""")
def excel_references(spark, sf):
    """References made from numbers, with dollar signs in some, and read back."""
    ref = X.format_ref(F.col("l_partkey") % 1000 + 1, F.col("l_suppkey") % 26)
    fixed = F.when(F.col("l_orderkey") % 2 == 0, F.regexp_replace(ref, "([A-Z]+)", "\\$$1\\$")).otherwise(ref)
    back = X.parse_ref(fixed)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ref.alias("ref"), back["row"].alias("row"), back["column"].alias("column"))


@query("""
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"$datetime":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '"}' WHEN 1 THEN '{"$date":"'
    || strftime(ts, '%Y-%m-%d') || '"}' WHEN 2 THEN '{"$time":"' || strftime(ts, '%H:%M:%S.%g') || '"}' WHEN 3 THEN '"' || event_type || '"'
    ELSE '{"$error":"#N/A"}' END AS json, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%g') WHEN 1 THEN strftime(ts,
    '%Y-%m-%d 00:00:00.000') WHEN 2 THEN strftime(ts, '1899-12-30 %H:%M:%S.%g') END AS back FROM (SELECT event_id, event_type, CASE WHEN
    hour(t) + minute(t) + second(t) + millisecond(t) = 0 THEN t + INTERVAL 1 SECOND ELSE t END AS ts FROM (SELECT *,
    date_trunc('milliseconds', ts) AS t FROM events))
""")
def typed_dumps(spark, sf):
    """Cells as a typed dump has them, and times read back from it."""
    k, t = F.col("event_id") % 5, F.date_trunc("millisecond", "ts")
    ts = F.when(F.date_trunc("day", t) == t, t + F.expr("INTERVAL 1 SECOND")).otherwise(t).cast("timestamp_ntz")
    clock = ts - F.date_trunc("day", ts).cast("timestamp_ntz") + F.lit("1899-12-30").cast("timestamp_ntz")
    ts = F.when(k == 1, F.date_trunc("day", ts).cast("timestamp_ntz")).when(k == 2, clock).otherwise(ts)
    kind = F.when(k < 3, "d").when(k == 3, "s").otherwise("e")
    text = X.typed_json(kind, F.col("event_type"), F.lit(None).cast("double"), F.lit(None).cast("boolean"), ts, F.lit("#N/A"))
    return table(spark, sf, "events").select("event_id", text.alias("json")).withColumn("back",
        F.date_format(X.typed_moment(F.col("json")), "yyyy-MM-dd HH:mm:ss.SSS"))


@query("SELECT o_orderkey, o_orderkey % 24 = 2 AS gap FROM orders")
def wall_clock_gaps(spark, sf):
    """Times of a night on which clocks went forward at two."""
    ts = F.timestamp_seconds(F.lit(1_710_028_800) + F.col("o_orderkey") % 24 * 3600 + 60)
    return table(spark, sf, "orders").select("o_orderkey", X.in_clock_gap(ts, "America/New_York").alias("gap"))


# Relations


@query("""
    WITH f AS (SELECT c_name[10:] AS text, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS id FROM customer GROUP BY ALL), r AS (SELECT
    *, CAST(sum(length(text)) OVER (ORDER BY id) AS BIGINT) AS chars FROM f) SELECT text, id, chars, id >= (SELECT min(id) FROM r WHERE id
    >= 900 OR chars > 5000) AS frozen FROM r
""")
def dictionary_freeze(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", F.substring("c_name", 10, 100).alias("t"))
    return R.freeze_point(R.dictionary(d, "t", "c_custkey").select("text", "id"), 900, 5000)


@query("""
    SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'size' WHEN 2 THEN 'digest' ELSE 'not listed' END AS problem FROM
    customer WHERE c_custkey % 6 < 4
""")
def manifest_integrity(spark, sf):
    files = table(spark, sf, "customer").select("c_custkey", F.encode("c_name", "UTF-8").alias("content"))
    k = F.col("c_custkey") % 6
    listed = files.where(k != 3).select("c_custkey", F.when(k == 2, "0").otherwise(F.sha2("content", 256)).alias("sha256"),
        (F.octet_length("content") + F.when(k == 1, 1).otherwise(0)).alias("bytes"))
    return R.integrity(files.where(k != 0), listed, "c_custkey")


@query("SELECT o_orderpriority, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY ALL")
def newest_runs(spark, sf):
    d = R.first_per_key(table(spark, sf, "orders"), ["o_orderpriority"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return d.select("o_orderpriority", F.col("o_orderkey").alias("newest"))


@query("""
    SELECT p_partkey, reader, coalesce(CASE WHEN p_size <= 10 THEN 'strict' END, 'lenient') AS policy FROM part, (VALUES ('a'), ('b'),
    ('c')) r(reader) WHERE list_contains(string_split(p_type, ' '), 'PROMO')
""")
def fixtures_readers(spark, sf):
    """Fixtures of a tag with each of three readers, and the policy that a table has for some of them."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split("p_type", " ").alias("tags"), "p_size")
    policies = parts.where("p_size <= 10").select("id", F.lit("strict").alias("policy"))
    chosen = R.look_up(R.fixtures_by(parts, tag="PROMO"), policies, "id", "policy", "lenient")
    return R.with_each(chosen, "reader", ["a", "b", "c"]).select(F.col("id").alias("p_partkey"), "reader", "policy")


@query("""
    SELECT c_custkey AS "row", CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'c_acctbal' END AS "column", CASE c_custkey
    % 9 WHEN 0 THEN 'ours-only' WHEN 1 THEN 'theirs-only' ELSE 'differs' END AS verdict FROM customer WHERE c_custkey % 9 < 3
""")
def records_parity(spark, sf):
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("row"), "c_name", "c_acctbal")
    k = F.col("row") % 9
    theirs = d.where(k != 0).withColumn("c_acctbal", F.when(k == 2, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return R.compare_records(d.where(k != 1), theirs, "row", ["c_name", "c_acctbal"])


def _cells(spark, sf, sheet: str):
    none = {c: F.lit(None).cast(t) for c, t in (("s", "string"), ("b", "boolean"), ("ts", "timestamp_ntz"), ("err", "string"))}
    return table(spark, sf, "part").select(F.lit(sheet).alias("sheet"), F.col("p_partkey").alias("row_index"), F.lit(0).alias("col_index"),
        F.lit("n").alias("kind"), F.col("p_retailprice").alias("n"), *[v.alias(c) for c, v in none.items()])


@query("""
    SELECT p_brand, count(*) AS cells, count(*) FILTER (p_partkey % 10 > 2) AS matches, CAST(round(count(*) FILTER (p_partkey % 10 > 2) *
    100.0 / count(*)) AS INTEGER) AS percent FROM part GROUP BY ALL
""")
def match_percentages(spark, sf):
    category = F.when(F.col("p_partkey") % 10 == 0, "missing").when(F.col("p_partkey") % 10 < 3, "number")
    return R.match_summary(table(spark, sf, "part").select("p_brand", category.alias("category")), ["p_brand"]).drop("top")


@query("""
    WITH c AS (SELECT event_type, c, count(*) AS n FROM (SELECT event_type, CASE WHEN event_id % 10 = 0 THEN 'missing' WHEN event_id % 10 <
    3 THEN 'number' WHEN event_id % 10 < 4 THEN 'text' ELSE NULL END AS c FROM events) WHERE c IS NOT NULL GROUP BY ALL), r AS (SELECT *,
    row_number() OVER (PARTITION BY event_type ORDER BY n DESC, c) AS k FROM c) SELECT event_type, string_agg(c || ' ' || n, ', ' ORDER BY
    k) AS top FROM r WHERE k <= 2 GROUP BY ALL
""")
def match_top_categories(spark, sf):
    k = F.col("event_id") % 10
    category = F.when(k == 0, "missing").when(k < 3, "number").when(k < 4, "text")
    return R.match_summary(table(spark, sf, "events").select("event_type", category.alias("category")), ["event_type"]).select("event_type", "top")


@query("""
    SELECT coalesce(category, 'match') AS category, count(*) AS cells FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'number' END AS category
    FROM part) GROUP BY ALL UNION ALL SELECT 'sheet-missing', 1 UNION ALL SELECT 'sheet-unexpected', 2
""")
def diff_of_sheets(spark, sf):
    one, two = _cells(spark, sf, "one"), _cells(spark, sf, "two")
    changed = one.withColumn("n", F.when(F.col("row_index") % 5 == 0, F.col("n") + 1).otherwise(F.col("n")))
    got = R.compare_workbooks(one.unionByName(two), changed.unionByName(_cells(spark, sf, "three")).unionByName(_cells(spark, sf, "four")))
    return got.groupBy(F.coalesce("category", F.lit("match")).alias("category")).agg(F.count("*").alias("cells"))


@query("SELECT 'data' AS sheet, CASE WHEN p_partkey % 5 = 0 THEN 'number' ELSE 'match' END AS category, count(*) AS cells FROM part GROUP BY ALL")
def diff_of_a_renamed_sheet(spark, sf):
    one = _cells(spark, sf, "data")
    changed = _cells(spark, sf, "renamed").withColumn("n", F.when(F.col("row_index") % 5 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return R.compare_workbooks(one, changed).groupBy("sheet", F.coalesce("category", F.lit("match")).alias("category")).agg(F.count("*").alias("cells"))


@query("""
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'text-controls' ELSE 'text' END AS
    category FROM documents WHERE text IS NOT NULL AND length(text) > 20 AND NOT regexp_matches(text, '_x[0-9A-Fa-f]{4}_')
""")
def diff_by_policies(spark, sf):
    """Texts cut, trimmed or with other line ends, which policies allow, and two kinds of changes that none does."""
    d = table(spark, sf, "documents").where("text is not null and length(text) > 20 and not text rlike '_x[0-9A-Fa-f]{4}_'")
    k, text = F.col("doc_id") % 5, F.col("text")
    e = F.when(k == 0, F.concat(F.repeat(text, F.lit(2)), F.lit("\n"), text)).when(k == 1,
        F.concat(F.lit(" "), F.trim(text), F.lit("  "))).when(k == 2, F.concat(F.repeat(F.lit("x"), F.lit(40_000)), text)).when(k == 3,
        F.concat(F.lit("\x01"), text)).otherwise(text)
    a = F.when(k == 0, F.replace(e, F.lit("\n"), F.lit("\r\n"))).when(k == 1, F.trim(text)).when(k == 2,
        F.repeat(F.lit("x"), F.lit(32_767))).when(k == 3, text).otherwise(F.concat(F.lit("#"), text))
    cell = lambda s, name: F.struct(F.lit("s").alias("kind"), s.alias("s"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("n", "double"), ("b", "boolean"), ("ts", "timestamp_ntz"), ("err", "string"))]).alias(name)
    return d.select("doc_id", cell(e, "e"), cell(a, "a")).select("doc_id", R.cell_difference(policies=("truncate", "trim", "line-ends")).alias("category"))


@query("""
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'millisecond-cut' WHEN 1 THEN 'serial-60' WHEN 2 THEN 'error-as-default' WHEN 3 THEN
    'line-ends' WHEN 4 THEN 'no-number' END AS reason FROM events
""")
def known_divergences(spark, sf):
    k = F.col("event_id") % 6
    ts = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
    pick = lambda *v: F.element_at(F.array(*v), (k + 1).cast("int"))
    text, none = (lambda *v: pick(*[F.lit(x).cast("string") for x in v])), F.lit(None)
    when = lambda *v: pick(*[none.cast("timestamp_ntz") if x is None else x for x in v])
    real = lambda *v: pick(*[F.lit(x).cast("double") for x in v])
    theirs = F.struct(text("d", "n", "s", "s", "blank", "s").alias("kind"), text(None, None, "", "a\nb", None, "x").alias("s"),
        real(None, 60.5, None, None, None, None).alias("n"), when(ts, None, None, None, None, None).alias("ts"),
        text(None, None, None, None, None, None).alias("err"))
    ours = F.struct(text("d", "d", "e", "s", "s", "s").alias("kind"), text(None, None, None, "a\r\nb", "-inf", "y").alias("s"),
        real(None, None, None, None, None, None).alias("n"),
        when(ts + F.expr("INTERVAL 1 MILLISECOND"), F.lit("1900-03-01").cast("timestamp_ntz"), None, None, None, None).alias("ts"),
        text(None, None, "#N/A", None, None, None).alias("err"))
    return table(spark, sf, "events").select("event_id", theirs.alias("t"), ours.alias("o")).select("event_id", R.known_divergence("t", "o").alias("reason"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'before-1900-as-text' WHEN 1 THEN 'clock-gap' END AS reason FROM orders")
def writer_conventions(spark, sf):
    k = F.col("o_orderkey") % 3
    expected = F.when(k == 0, F.lit("1899-05-05 00:00:00")).when(k == 1, "2024-03-10 02:30:00").otherwise("2024-03-10 05:30:00").cast("timestamp_ntz")
    actual = F.when(k > 0, expected + F.expr("INTERVAL 1 HOUR"))
    shown = F.when(k == 0, "1899-05-05T00:00:00")
    return table(spark, sf, "orders").select("o_orderkey", R.writer_convention(expected, actual, shown, "America/New_York").alias("reason"))


@query("""
    SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'same' WHEN 1 THEN 'same' WHEN 2 THEN 'text-cell-without-text' WHEN 3 THEN
    'time-marker-day' END AS verdict FROM customer
""")
def header_parity(spark, sf):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("c_custkey") % 5 + 1).cast("int"))
    theirs, ours = pick("a", "__EMPTY_2", "_1", "1900-01-00T01:02:03", "a"), pick("a", "__EMPTY", "__EMPTY_4", "1899-12-30T01:02:03", "b")
    return table(spark, sf, "customer").select("c_custkey", R.same_header(theirs, ours, F.lit(True)).alias("verdict"))


@query("""
    SELECT folder, status, count(*) AS files FROM (SELECT CASE WHEN event_id % 10 = 0 THEN '' ELSE 'f' || user_id % 3 || '/x' END AS folder,
    CASE WHEN event_id % 7 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'rejected' ELSE 'unclassified-error' END WHEN event_id % 3 = 0 AND
    event_id % 5 = 0 THEN 'diff:parity+roundtrip' WHEN event_id % 3 = 0 THEN 'diff:parity' WHEN event_id % 5 = 0 THEN 'diff:roundtrip' ELSE
    'pass' END AS status FROM events) GROUP BY ALL
""")
def audit_folders(spark, sf):
    k = F.col("event_id")
    status = R.run_status(k % 7 != 0, k % 2 == 0, parity=k % 3 != 0, objects=F.lit(None).cast("boolean"), roundtrip=k % 5 != 0)
    file = F.when(k % 10 == 0, F.concat(k.cast("string"), F.lit(".xlsx"))).otherwise(F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string"),
        F.lit("/x/"), k.cast("string"), F.lit(".xlsx")))
    return R.folder_status(table(spark, sf, "events").select(file.alias("file"), status.alias("status")), "file", "status")


@query("SELECT event_type, count(*) AS runs, sum(event_id)::BIGINT AS event_id FROM events GROUP BY ALL")
def audit_sums(spark, sf):
    runs = table(spark, sf, "events").select("event_type", "event_id", F.col("event_id").cast("string").alias("file"))
    return R.audit_summary(runs, "event_type", "file", sums=("event_id",)).drop("examples")


@query("""
    SELECT CASE c_custkey % 5 WHEN 0 THEN 'backslash-entry-names' WHEN 1 THEN 'openxml-sdk-dotnet' WHEN 2 THEN 'Microsoft_Excel_16_rup' WHEN
    3 THEN 'no-application' ELSE 'LibreOffice_7.6' END AS writer, count(*) AS population, least(count(*), 20) AS selected FROM customer
    GROUP BY ALL
""")
def writers_selected(spark, sf):
    k = (F.col("c_custkey") % 5 + 1).cast("int")
    names = F.element_at(F.array(F.array(F.lit("xl\\workbook.xml")), *[F.array(F.lit("xl/workbook.xml"), F.lit("docProps/app.xml"))] * 4), k)
    app = F.element_at(F.array(*map(F.lit, ("", "", "<Application>Microsoft Excel</Application><AppVersion>16.0300</AppVersion>", "<x/>",
        "<ap:Application>LibreOffice/7.6</ap:Application>"))), k)
    book = F.element_at(F.array(*map(F.lit, ("", '<sheet r:id="R0123456789abcdef"/>', '<fileVersion appName="xl" rupBuild="1"/>', "", ""))), k)
    d = table(spark, sf, "customer").select("c_custkey", R.writer_name(names, app, book).alias("writer"))
    return R.select_by(d, "writer", "c_custkey", 20)


@query("""
    WITH r AS (SELECT o_custkey AS sheet, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_index, o_orderkey % 3 AS k
    FROM orders), e AS (SELECT sheet, max(row_index) FILTER (k > 0) AS last FROM r GROUP BY ALL) SELECT sheet, CAST(row_index AS INTEGER) AS
    row_index, CAST(k AS INTEGER) AS cells FROM r JOIN e USING (sheet) WHERE row_index <= last
""")
def normalized_rows(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    k = F.col("o_orderkey") % 3
    cells = F.when(k == 0, F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))).when(k == 1,
        F.array(F.lit(1), F.lit(None).cast("int"))).otherwise(F.array(F.lit(None).cast("int"), F.lit(1), F.lit(None).cast("int")))
    rows = R.normalize_rows(table(spark, sf, "orders").select(F.col("o_custkey").alias("sheet"), n.alias("row_index"), cells.alias("cells")))
    return rows.select("sheet", "row_index", F.size("cells").alias("cells"))


@query("""
    WITH t AS (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS tag, CAST(p_size AS VARCHAR) AS item FROM part), c AS (SELECT DISTINCT
    unnest(string_split(p_type, ' ')) AS tag, 'listed' AS item FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT 'nothing', NULL), b AS
    (SELECT DISTINCT tag, item FROM (SELECT * FROM t UNION ALL SELECT * FROM c)) SELECT tag, coalesce(string_agg(item, ',' ORDER BY item),
    '') AS items, tag IN (SELECT tag FROM c) AS listed FROM b GROUP BY tag
""")
def tag_catalogue(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_size", F.split("p_type", " ").alias("tags"))
    own = parts.where("p_partkey % 50 = 0").select(F.explode("tags").alias("tag")).distinct().select("tag", F.array(F.lit("listed")).alias("items"))
    nothing = own.limit(1).select(F.lit("nothing").alias("tag"), F.array().cast("array<string>").alias("items"))
    return R.tag_index(parts, "p_size", "tags", own.unionByName(nothing))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a,b,c' ELSE 'a,b' END AS keys FROM customer")
def record_keys(spark, sf):
    second = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a")))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(R.key_union(F.array(F.lit("a"), F.lit("b")), second), ",").alias("keys"))


@query("SELECT o_orderkey AS row_index FROM orders WHERE o_orderkey % 500 = 0")
def progress_rows(spark, sf):
    return R.progress_marks(table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_index")), 500)


@query("""SELECT '| ' || n_nationkey || ' | ' || replace(n_name, 'A', '\\|') || ' |  |' AS line FROM nation""")
def markdown_lines(spark, sf):
    d = table(spark, sf, "nation").select("n_nationkey", F.replace(F.col("n_name"), F.lit("A"), F.lit("|")).alias("n"), F.lit(None).cast("string").alias("x"))
    return R.markdown(d, ["n_nationkey", "n", "x"])


# Generated data


@query("""
    WITH a AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) AS s FROM orders), b AS (SELECT *, xor(s, s << 13) & 4294967295 AS t FROM a), c
    AS (SELECT *, xor(t, t >> 17) AS u FROM b) SELECT o_orderkey, xor(u, u << 5) & 4294967295 AS state FROM c
""")
def generator_steps(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", xorshift32(F.col("o_orderkey")).alias("state"))


@query("SELECT event_id, CAST('0x' || substr(md5('5:x:' || event_id), 1, 8) AS BIGINT) AS drawn FROM events")
def generator_draws(spark, sf):
    return table(spark, sf, "events").select("event_id", draw(5, "x", F.col("event_id")).alias("drawn"))


@query("""
    SELECT 'mixed' AS name, 20 AS columns, 1000 AS "rows", 1000 AS ids, true AS some_nulls UNION ALL SELECT 'wide', 107, 1000, 1000, false
    UNION ALL SELECT 'strings-unique', 20, 1000, 1000, false UNION ALL SELECT 'numeric', 20, 1000, NULL, false
""")
def generated_datasets(spark, sf):
    """The four shapes: columns, rows, different values of the first column, and whether any value is null."""
    out = []
    for name in ("mixed", "wide", "strings-unique", "numeric"):
        d = dataset(spark, name, 1000)
        first = d.columns[0]
        nulls = F.max(F.greatest(*[F.col(f"`{c}`").isNull().cast("int") for c in d.columns])) == 1
        seen = d.agg(F.count("*").alias("rows"), F.count_distinct(first).alias("ids"), nulls.alias("some_nulls"))
        out.append(seen.select(F.lit(name).alias("name"), F.lit(len(d.columns)).alias("columns"), F.col("rows").cast("int").alias("rows"),
            (F.lit(None) if name == "numeric" else F.col("ids")).cast("int").alias("ids"), "some_nulls"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
