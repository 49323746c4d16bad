"""Relational tools over cells, runs and manifests: comparing, auditing, encoding, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..cluster import shared_folder
from ..functions.cells import MAX_CELL_CHARS, SheetNames
from ..functions.columns import limit_text, same_number, utf16_units

KEYS = ["sheet", "row_index", "col_index"]
GRID_BLOCK = 16


#: Differences that a reader or writer is allowed, by the name of its policy.
POLICIES = {
    "truncate": lambda es, as_: as_ == limit_text(es, MAX_CELL_CHARS),
    "truncate-marked": lambda es, as_: as_ == limit_text(es, MAX_CELL_CHARS, "..."),
    "trim": lambda es, as_: as_ == F.trim(es),
    "line-ends": lambda es, as_: F.regexp_replace(es, "\r\n?", "\n") == F.regexp_replace(as_, "\r\n?", "\n"),
}


def cell_difference(e: str = "e", a: str = "a", policies: tuple[str, ...] = ()) -> Column:
    """Why two cells differ, or null: the first rule that holds names the category.

    A formula whose cached value the other side lacks is dropped; else formulas count by their values.
    ``policies`` names differences of texts that count as none.
    """
    x = lambda side, f: F.col(f"{side}.{f}")
    both = lambda k: (x(e, "kind") == k) & (x(a, "kind") == k)
    pair = lambda k, m: (x(e, "kind") == k) & (x(a, "kind") == m)
    blank = lambda side: x(side, "kind").isNull() | (x(side, "kind") == "blank")
    es, as_ = x(e, "s"), x(a, "s")
    allowed = F.lit(False)
    for name in policies:
        allowed |= POLICIES[name](es, as_)
    control = F.regexp_replace(es, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return (
        F.when(blank(e) & blank(a), F.lit(None))
        .when(blank(e) & (x(a, "kind") == "s") & (as_ == ""), "blank-read-as-empty")
        .when(blank(a) & (x(e, "kind") == "s") & (es == ""), "empty-read-as-blank")
        .when(blank(a), "missing")
        .when(blank(e), "unexpected")
        .when(both("n") & (x(e, "n") == x(a, "n")), F.lit(None))
        .when(both("n") & same_number(x(e, "n"), x(a, "n")), "number-last-digit")
        .when(both("n"), "number")
        .when(both("b"), F.when(x(e, "b") == x(a, "b"), F.lit(None)).otherwise("boolean"))
        .when(both("e"), F.when(x(e, "err") == x(a, "err"), F.lit(None)).otherwise("error-code"))
        .when(both("d"), F.when(x(e, "ts") == x(a, "ts"), F.lit(None)).when(F.abs(F.unix_micros(x(e, "ts").cast("timestamp")) - F.unix_micros(x(a,
            "ts").cast("timestamp"))) <= 1000, "date-rounding").when(F.to_date(x(e, "ts")) == F.to_date(x(a, "ts")), "date-time").otherwise("date"))
        .when(both("s") & ((es == as_) | allowed), F.lit(None))
        .when(both("s") & (F.trim(es) == F.trim(as_)), "text-space")
        .when(both("s") & (F.regexp_replace(es, "\r\n?", "\n") == F.regexp_replace(as_, "\r\n?", "\n")), "text-line-ends")
        .when(both("s") & (control == as_), "text-controls")
        .when(both("s") & F.startswith(es, as_), "text-truncated")
        .when(both("s") & (es.rlike("_x[0-9A-Fa-f]{4}_") | as_.rlike("_x[0-9A-Fa-f]{4}_")), "text-escapes")
        .when(both("s") & (F.lower(es) == F.lower(as_)), "text-case")
        .when(both("s"), "text")
        .when(pair("d", "n"), "date-read-as-number")
        .when(pair("n", "d"), "number-read-as-date")
        .when(pair("n", "s") & (as_.try_cast("double") == x(e, "n")), "number-read-as-text")
        .when(pair("s", "n"), "text-read-as-number")
        .when(pair("b", "s") | pair("b", "n"), "boolean-type")
        .when(pair("e", "s"), "error-read-as-text")
        .otherwise("type")
    )


def compare_cells(expected: DataFrame, actual: DataFrame, policies: tuple[str, ...] = ()) -> DataFrame:
    """(sheet, row_index, col_index, category): a full outer join of two cell relations, each pair judged."""
    def side(d: DataFrame, name: str) -> DataFrame:
        return d.select(*KEYS, F.struct("kind", "s", "n", "b", "ts", "err").alias(name))

    joined = side(expected, "e").join(side(actual, "a"), KEYS, "full_outer")
    return joined.select(*KEYS, cell_difference(policies=policies).alias("category"))


def compare_workbooks(expected: DataFrame, actual: DataFrame, policies: tuple[str, ...] = ()) -> DataFrame:
    """As compare_cells, sheet by sheet: one only sheet on either side is compared whatever its name; a sheet
    that one side lacks is one difference, ``sheet-missing`` or ``sheet-unexpected``, without row and column."""
    names = [d.select("sheet").distinct() for d in (expected, actual)]
    both = names[0].withColumn("e", F.col("sheet")).join(names[1].withColumn("a", F.col("sheet")), "sheet", "full_outer")
    alone = both.agg(F.count("e").alias("ne"), F.count("a").alias("na"), F.max("e").alias("e"), F.max("a").alias("a")).first()
    if alone["ne"] == alone["na"] == 1 and alone["e"] != alone["a"]:
        return compare_cells(expected, actual.withColumn("sheet", F.lit(alone["e"])), policies)
    lost = both.where("e is null or a is null").select("sheet", F.when(F.col("a").isNull(), "sheet-missing").otherwise("sheet-unexpected").alias("category"))
    shared = both.where("e is not null and a is not null").select("sheet")
    cells = compare_cells(*(d.join(shared, "sheet", "left_semi") for d in (expected, actual)), policies)
    none = F.lit(None).cast("int")
    return cells.unionByName(lost.select("sheet", none.alias("row_index"), none.alias("col_index"), "category"))


def match_summary(compared: DataFrame, by: list[str], most: int = 2) -> DataFrame:
    """(by, cells, matches, percent, top): the share of matching cells, and the categories that are there most."""
    counts = compared.groupBy(*by, "category").agg(F.count("*").alias("n"))
    named = F.filter(F.collect_list(F.struct((-F.col("n")).alias("less"), "category")), lambda x: x["category"].isNotNull())
    out = counts.groupBy(*by).agg(F.sum("n").alias("cells"),
        F.coalesce(F.sum(F.when(F.col("category").isNull(), F.col("n"))), F.lit(0)).alias("matches"), F.slice(F.array_sort(named), 1, most).alias("top"))
    text = F.array_join(F.transform("top", lambda x: F.concat(x["category"], F.lit(" "), (-x["less"]).cast("string"))), ", ")
    return out.select(*by, "cells", "matches", F.round(F.col("matches") * 100 / F.col("cells")).cast("int").alias("percent"), text.alias("top"))


def compare_records(ours: DataFrame, theirs: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """(row, column, verdict) of every field in which records of the same source row differ, with ``ours-only`` or
    ``theirs-only`` and no column for a record that the other side lacks."""
    left, right = (d.select(row, F.struct(*columns).alias(n)) for d, n in ((ours, "o"), (theirs, "t")))
    joined = left.join(right, row, "full_outer")
    fields = F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"t.{c}")), F.struct(F.lit(c).alias("column"), F.lit("differs").alias("verdict"))) for c in columns])
    only = F.when(F.col("t").isNull(), "ours-only").when(F.col("o").isNull(), "theirs-only")
    none = F.struct(F.lit(None).cast("string").alias("column"), only.alias("verdict"))
    found = F.when(only.isNotNull(), F.array(none)).otherwise(F.filter(fields, lambda f: f.isNotNull()))
    return joined.select(row, F.explode(found).alias("f")).select(row, "f.column", "f.verdict")


def known_divergence(theirs: str, ours: str) -> Column:
    """The reason why another reader's cell may differ from ours, both CELL structs; null if none is known."""
    t, o = (lambda f: F.col(f"{theirs}.{f}")), (lambda f: F.col(f"{ours}.{f}"))
    day = F.expr("INTERVAL 1 DAY")
    blank = t("kind").isNull() | (t("kind") == "blank")
    apart = lambda a, b: F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp")))
    both = lambda k: (t("kind") == k) & (o("kind") == k)
    return (
        F.when(both("d") & (F.to_date(t("ts")) == F.lit("1899-12-31").cast("date")) & (apart(t("ts") - day, o("ts")) <= 1000), "time-marker-day")
        .when(both("d") & (apart(t("ts"), o("ts")) <= 1000), "millisecond-cut")
        .when((o("kind") == "n") & (t("kind") == "d") & (F.year(t("ts")) > 9999), "past-9999")
        .when((o("kind") == "e") & (blank | (t("s") == "")), "error-as-default")
        .when((t("s") == "") & (o("kind").isNull() | (o("kind") == "blank")), "text-cell-without-text")
        .when(both("s") & ((F.regexp_replace(o("s"), "\r\n?", "\n") == F.replace(t("s"), F.lit("\r"), F.lit("\n"))) | (F.replace(o("s"), F.lit("\r"),
            F.lit("")) == t("s"))), "line-ends")
        .when((t("kind") == "d") & (o("kind") == "n") & ((o("n") == 60) | (o("n") < 0)), "no-such-date")
        .when((t("kind") == "n") & (o("kind") == "d") & (t("n") >= 60) & (t("n") < 61), "serial-60")
        .when(blank & (o("kind") == "s") & F.lower(o("s")).rlike(r"^(-?inf|nan|-?\d(\.\d+)?e\+30[89])$"), "no-number")
    )


def writer_convention(expected: Column, actual: Column, shown: Column, zone: str = "UTC") -> Column:
    """Why a time that was written may read otherwise: before March 1900 it is text (``shown``); a wall clock that
    ``zone`` skips comes back an hour later."""
    gap = F.from_utc_timestamp(F.to_utc_timestamp(expected, zone), zone) != expected.cast("timestamp")
    later = F.unix_micros(actual.cast("timestamp")) - F.unix_micros(expected.cast("timestamp")) == 3_600_000_000
    return F.when(shown.isNotNull() & (expected < F.lit("1900-03-01").cast("timestamp_ntz")), "before-1900-as-text").when(gap & later, "clock-gap")


def same_header(theirs: Column, ours: Column, without_text: Column) -> Column:
    """``same`` if two readers' names are one column's, the reason if they are so for one, else null."""
    empty, nothing = r"^__EMPTY(_\d+)?\z", r"^(_\d+)?\z"
    clock = F.regexp_extract(theirs, r"^1900-01-00T(\d\d:\d\d:\d\d(?:_\d+)?)\z", 1)
    return (
        F.when((theirs == ours) | theirs.rlike(empty) & ours.rlike(empty), "same")
        .when(ours.rlike(empty) & theirs.rlike(nothing) & without_text, "text-cell-without-text")
        .when((clock != "") & (ours == F.concat(F.lit("1899-12-30T"), clock)), "time-marker-day")
    )


def run_status(ok: Column, classified: Column, **passed: Column) -> Column:
    """``pass``, ``diff:`` with the checks that failed, or why a file was not read; a check that wasn't run is null."""
    failed = F.array_join(F.array_compact(F.array(*[F.when(~p, name) for name, p in passed.items()])), "+")
    return F.when(~ok, F.when(classified, "rejected").otherwise("unclassified-error")).when(failed != "", F.concat(F.lit("diff:"), failed)).otherwise("pass")


def normalize_rows(rows: DataFrame) -> DataFrame:
    """(sheet, row_index, cells) without null cells at the ends of rows, and without empty rows at the ends of sheets."""
    last = F.coalesce(F.array_max(F.transform("cells", lambda x, k: F.when(x.isNotNull(), k + 1))), F.lit(0))
    cut = rows.select("sheet", "row_index", F.slice("cells", 1, last).alias("cells"))
    ends = cut.where(F.size("cells") > 0).groupBy("sheet").agg(F.max("row_index").alias("end__"))
    return cut.join(ends, "sheet").where(F.col("row_index") <= F.col("end__")).drop("end__")


def writer_name(names: Column, app: Column, workbook: Column) -> Column:
    """Which program wrote a package: by marks that some leave in it, else by the name and version it gives.

    ``names`` are the entries' names, ``app`` and ``workbook`` the texts of the two parts, null if not there.
    """
    app, workbook = F.coalesce(app, F.lit("")), F.coalesce(workbook, F.lit(""))
    said = F.trim(F.regexp_extract(app, r"<(?:\w+:)?Application>([^<]*)<", 1))
    major = F.split_part(F.regexp_extract(app, r"<(?:\w+:)?AppVersion>([^<]*)<", 1), F.lit("."), F.lit(1))
    version = F.regexp_extract(workbook, r"<(?:\w+:)?fileVersion\b[^>]*>", 0)
    mark = F.when(version == "", "nofv").when(F.contains(version, F.lit("rupBuild")), "rup").otherwise("fv")
    name = F.when(said == "", "no-application").otherwise(said)
    full = F.when(F.lower(name).startswith("microsoft"), F.trim(F.concat_ws(" ", name, major, mark))).otherwise(name)
    key = F.regexp_replace(F.regexp_replace(full, "[^A-Za-z0-9.+-]+", "_"), r"^[_.]+|[_.]+\z", "")
    view = F.regexp_extract(workbook, r"<(?:\w+:)?workbookView\s+(\w+)=", 1)
    return (
        F.when(F.exists(names, lambda n: F.contains(n, F.lit("\\"))), "backslash-entry-names")
        .when(workbook.rlike('r:id="R[0-9a-f]{16}"'), "openxml-sdk-dotnet")
        .when(F.contains(workbook, F.lit("schemas.microsoft.com/office/mac/excel/2008/main")) & ~F.array_contains(names, "docProps/app.xml"), "google-sheets-2014")
        .when((view == "activeTab") & F.contains(workbook, F.lit('rupBuild="4505"')), "phpexcel")
        .when(key == "", "unknown")
        .otherwise(key)
    )


def select_by(items: DataFrame, group: str, key: str, per: int, seed: int = 7) -> DataFrame:
    """(group, population, selected): how many there are, and how many a stratified sample takes."""
    chosen = stratified_sample(items, group, key, per, seed).groupBy(group).agg(F.count("*").alias("selected"))
    return items.groupBy(group).agg(F.count("*").alias("population")).join(chosen, group)


def difference_report(compared: DataFrame) -> DataFrame:
    """(sheet, category, cells): counts by sheet and category, with totals (nulls) by rollup."""
    named = compared.select("sheet", F.coalesce("category", F.lit("match")).alias("category"))
    return named.rollup("sheet", "category").agg(F.count("*").alias("cells"))


def dictionary(values: DataFrame, value: str, position: str) -> DataFrame:
    """(text, first, references, id): distinct values numbered in order of first occurrence.

    Ids come from a range-partitioned running count: counts by partition, then an offset for each, so
    that no task sees all values.
    """
    found = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("text")).agg(F.min(position).alias("first"), F.count("*").alias("references"))
    return number_in_order(found, ["first", "text"], "id")


def number_in_order(d: DataFrame, by: str | list[str], name: str, parts: int | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """Numbers rows from 0 in the order of ``by`` without one task for all of them; ``sums`` adds, under the names
    told, what columns sum up to from the first row to this one."""
    n, by, sums = parts or int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), [by] if isinstance(by, str) else by, sums or {}
    # Written once: a partition's number must be the same for its rows and for its count.
    path = shared_folder(d.sparkSession, "ordered")
    d.repartitionByRange(n, *by).withColumn("part__", F.spark_partition_id()).write.parquet(path)
    placed = d.sparkSession.read.parquet(path)
    totals = placed.groupBy("part__").agg(F.count("*").alias("n__"), *[F.sum(c).alias(f"{to}__") for c, to in sums.items()])
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part__", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n__", *[f"{to}__" for to in sums.values()])])
    within = Window.partitionBy("part__").orderBy(*by)
    numbered = placed.withColumn("rank__", F.row_number().over(within))
    for column, to in sums.items():
        numbered = numbered.withColumn(to, F.sum(column).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = numbered.join(F.broadcast(offsets), "part__").withColumn(name, F.col("n__") + F.col("rank__") - 1)
    for to in sums.values():
        out = out.withColumn(to, F.col(to) + F.col(f"{to}__"))
    return out.drop("part__", "rank__", "n__", *[f"{to}__" for to in sums.values()])


def dictionary_stats(values: DataFrame, value: str) -> DataFrame:
    """(references, unique_count, chars): what a shared-string table of the values would hold."""
    counted = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return counted.agg(F.sum("n").alias("references"), F.count("*").alias("unique_count"), F.sum(utf16_units(F.col(value))).alias("chars"))


def freeze_point(entries: DataFrame, unique_budget: int, char_budget: int) -> DataFrame:
    """(text, id, chars, frozen): from which entry of a dictionary on a bounded table takes no more."""
    counted = entries.select("text", "id", utf16_units(F.col("text")).cast("long").alias("units"))
    running = number_in_order(counted, "id", "place", sums={"units": "chars"})
    first = running.where((F.col("place") >= unique_budget) | (F.col("chars") > char_budget)).agg(F.min("id")).first()[0]
    return running.select("text", "id", "chars", (F.lit(False) if first is None else F.col("id") >= first).alias("frozen"))


def overlapping_ranges(ranges: DataFrame) -> DataFrame:
    """(sheet, a, b): pairs of rectangles of a sheet that share a cell.

    Rectangles go to the 16-row blocks they touch and meet there by an equi join; a pair is given
    out in the first block that both touch only.
    """
    blocks = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("top") / GRID_BLOCK), F.floor(F.col("bottom") / GRID_BLOCK))))
    a, b = (blocks.select("sheet", "block", *[F.col(c).alias(f"{c}_{t}") for c in ("id", "top", "left", "bottom", "right")]) for t in "ab")
    meet = (F.col("id_a") < F.col("id_b")) & (F.col("top_a") <= F.col("bottom_b")) & (F.col("bottom_a") >= F.col("top_b")) & (F.col("left_a") <= F.col("right_b")) & (F.col("right_a") >= F.col("left_b"))
    first = F.col("block") == F.floor(F.greatest("top_a", "top_b") / GRID_BLOCK)
    return a.join(b, ["sheet", "block"]).where(meet & first).select("sheet", F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def fill_row_gaps(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Every row number from first to last; those without cells get an empty list."""
    span = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("row_index"))
    return span.join(rows, "row_index", "left").select("row_index", F.coalesce("cells", F.array().cast(rows.schema["cells"].dataType)).alias("cells"))


def head_map(cells: DataFrame, rows: int) -> DataFrame:
    """(path, sheet, cells): a map from reference to cell of each sheet's first rows."""
    entry = F.struct("ref", F.struct("kind", "s", "n", "b", "ts", "err", "formula"))
    return cells.where(F.col("row_index") <= rows).groupBy("path", "sheet").agg(F.map_from_entries(F.collect_list(entry)).alias("cells"))


def beyond_header(cells: DataFrame, header_end: int, header_row: int = 1) -> DataFrame:
    """(sheet, cells, columns, first_column, last_column, first_ref) of values right of the header."""
    over = cells.where((F.col("col_index") > header_end) & (F.col("row_index") > header_row))
    return over.groupBy("sheet").agg(F.count("*").alias("cells"), F.count_distinct("col_index").alias("columns"),
        F.min("col_index").alias("first_column"), F.max("col_index").alias("last_column"), F.min_by("ref", F.struct("row_index", "col_index")).alias("first_ref"))


def sheet_extent(cells: DataFrame) -> DataFrame:
    return cells.groupBy("path", "sheet").agg(F.max("row_index").alias("rows"), (F.max("col_index") + 1).alias("columns"), F.count("*").alias("cells"))


def first_per_key(d: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: a warning once per sheet and code, the newest run per label."""
    return d.withColumn("k__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("k__ = 1").drop("k__")


def unique_sheet_names(names: DataFrame) -> DataFrame:
    """(workbook, position, name): names that a workbook's sheets may have, repeated ones, in any case, with (2),
    (3) and so on until none is there twice.  A workbook has at most as many sheets as an archive has entries."""
    def rename(frame):
        frame, names = frame.sort_values("position"), SheetNames()
        # A name is cleaned alone first: an empty one is Sheet1, unless that is taken.
        out = [names.add(name or "", 1 if "sheet1" not in names.used else None) for name in frame["name"]]
        return frame.assign(name=out)

    narrow = names.select("workbook", "position", F.col("name").cast("string").alias("name"))
    return narrow.groupBy("workbook").applyInPandas(rename, narrow.schema)


def progress_marks(rows: DataFrame, every: int = 5_000) -> DataFrame:
    """The rows at which a writer that reports every so many rows says how far it is."""
    return rows.where(F.col("row_index") % every == 0)


def key_union(a: Column, b: Column) -> Column:
    """The keys of two records, those of the first one first."""
    return F.array_union(a, b)


def fixtures_by(items: DataFrame, ids: list[str] | None = None, tag: str | None = None, generated: bool | None = None) -> DataFrame:
    """The fixtures of some ids, of a tag, or made by a generator or not; what isn't told isn't asked."""
    for told, test in ((ids, F.col("id").isin(ids or [])), (tag, F.array_contains("tags", tag or "")), (generated, F.col("generated") == bool(generated))):
        items = items if told is None else items.where(test)
    return items


def with_each(items: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Every item once for each of a few values, such as fixtures and readers."""
    return items.withColumn(column, F.explode(F.array(*map(F.lit, values))))


def look_up(items: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Items with the value that a table has for their key, or else the default."""
    return items.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def markdown(d: DataFrame, columns: list[str]) -> DataFrame:
    """(line): each row as a line of a Markdown table, with bars escaped and line ends as spaces."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "\n", " ")
    return d.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))


def audit_summary(runs: DataFrame, key: str, file: str, examples: int = 5, sums: tuple[str, ...] = ()) -> DataFrame:
    """(key, runs, sums, examples): counts and sums with the first few files of each key by name."""
    order = Window.partitionBy(key).orderBy(file)
    kept = runs.withColumn("k__",
        F.row_number().over(order)).where(F.col("k__") <= examples).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(file)), ",").alias("examples"))
    return runs.groupBy(key).agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in sums]).join(kept, key)


def folder_status(runs: DataFrame, file: str, status: str) -> DataFrame:
    """(folder, status, files): how many files of each folder came out how."""
    folder = F.when(F.contains(F.col(file), F.lit("/")), F.regexp_extract(file, "^(.*)/[^/]*$", 1)).otherwise("")
    return runs.groupBy(folder.alias("folder"), status).agg(F.count("*").alias("files"))


def resume(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to do."""
    return files.join(done.select(key), key, "left_anti")


def transitions(before: DataFrame, now: DataFrame, key: str, status: str) -> DataFrame:
    """(was, now, files): how files that are in both runs moved between statuses."""
    joined = before.select(key, F.col(status).alias("was")).join(now.select(key, F.col(status).alias("now")), key)
    return joined.groupBy("was", "now").agg(F.count("*").alias("files"))


def top_by(d: DataFrame, column: str, k: int, tie: str) -> DataFrame:
    return d.orderBy(F.col(column).desc(), tie).limit(k)


def stratified_sample(d: DataFrame, stratum: str, key: str, per: int, seed: int = 7) -> DataFrame:
    """At most ``per`` rows of each stratum, the same at every run: those of the smallest digests."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    order = Window.partitionBy(stratum).orderBy(digest, key)
    return d.withColumn("k__", F.row_number().over(order)).where(F.col("k__") <= per).drop("k__")


def run_medians(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("runs"))


def ratios(medians: DataFrame, engine: str, baseline: str, keys: list[str]) -> DataFrame:
    """Every engine's median over the baseline's, for the same workload."""
    base = medians.where(F.col(engine) == baseline).select(*keys, F.col("median").alias("base"))
    return medians.join(base, keys).withColumn("ratio", F.col("median") / F.col("base"))


def gates(ratios_: DataFrame, limit: float) -> DataFrame:
    """(verdict, gates): how many workloads keep to the limit."""
    verdict = F.when(F.col("ratio").isNull(), "not run").when(F.col("ratio") <= limit, "pass").otherwise("fail")
    return ratios_.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("gates"))


def verdict_matrix(results: DataFrame, row: str, column: str, values: list[str], verdict: str) -> DataFrame:
    """One row a fixture, one column a reader, the verdict in the cell."""
    return results.groupBy(row).pivot(column, values).agg(F.first(verdict))


def tag_index(items: DataFrame, key: str, tags: str, catalogue: DataFrame | None = None) -> DataFrame:
    """(tag, items): which items carry each tag, in order.

    With a ``catalogue`` (tag, items) its own lists are merged in, and (tag, items, listed) says whether it
    has the tag at all; tags of it that no item carries are there too.
    """
    carried = items.select(F.explode(tags).alias("tag"), F.col(key).cast("string").alias("item"))
    if catalogue is not None:
        known = catalogue.select("tag", F.explode_outer("items").alias("item"))
        both = carried.withColumn("listed", F.lit(0)).unionByName(known.select("tag", F.col("item").cast("string").alias("item"), F.lit(1).alias("listed")))
        found = both.groupBy("tag", "item").agg(F.max("listed").alias("listed")).groupBy("tag")
        return found.agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"), (F.max("listed") == 1).alias("listed"))
    # One row a tag and item first, so that only distinct ones are gathered.
    return carried.distinct().groupBy("tag").agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))


def latest_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A manifest with rows replaced or added by key."""
    both = old.withColumn("new__", F.lit(0)).unionByName(new.withColumn("new__", F.lit(1)))
    return first_per_key(both, [key], [F.col("new__").desc()]).drop("new__")


def integrity(files: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """(key, problem): files whose size or digest is not the manifest's, or that one side lacks."""
    have = files.select(key, F.sha2("content", 256).alias("have"), F.octet_length("content").alias("size"))
    joined = manifest.select(key, "sha256", "bytes").join(have, key, "full_outer")
    problem = F.when(F.col("sha256").isNull(), "not listed").when(F.col("have").isNull(), "missing").when(F.col("size") != F.col("bytes"),
        "size").when(F.col("have") != F.col("sha256"), "digest")
    return joined.select(key, problem.alias("problem")).where(F.col("problem").isNotNull())
