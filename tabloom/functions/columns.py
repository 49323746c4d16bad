"""Spreadsheet rules as Spark columns, all within code generation but where a function says otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from .cells import BUILTIN_FORMATS, DATE_FORMAT_IDS, DAY_MS, LAST_SERIAL_1900, MAX_CELL_CHARS, MAX_COLUMNS, MAX_ROWS, MAX_SHEET_NAME, OFFSET_1904, SPACES

_EPOCH_DAYS = 25_569


def serial_from_timestamp(ts: Column, d1904: bool = False) -> Column:
    """The serial of a wall clock time, rounded to the millisecond; null outside the system's years."""
    micros = F.unix_micros(ts.cast("timestamp_ntz").cast("timestamp"))
    ms = F.floor((micros + 500) / 1000).cast("long") + F.lit(_EPOCH_DAYS * DAY_MS)
    clock = F.when((ms >= 0) & (ms < DAY_MS), ms)
    if d1904:
        late = ms - F.lit(OFFSET_1904 * DAY_MS)
        out = F.coalesce(clock, F.when((late >= 0) & (ms < LAST_SERIAL_1900 * DAY_MS), late))
    else:
        early = F.when(ms < 61 * DAY_MS, ms - DAY_MS).otherwise(ms)
        out = F.coalesce(clock, F.when((early >= DAY_MS) & (early < LAST_SERIAL_1900 * DAY_MS), early))
    return out / F.lit(float(DAY_MS))


def timestamp_from_serial(x: Column, d1904: bool = False) -> Column:
    """Wall clock time (timestamp_ntz) of a serial; null below 0, past the year 9999, or not finite."""
    x = x.cast("double")
    shifted = x + OFFSET_1904 if d1904 else x
    ms = F.floor(shifted * F.lit(float(DAY_MS)) + 0.5)
    if not d1904:
        ms = F.when((ms >= DAY_MS) & (ms < 61 * DAY_MS), ms + DAY_MS).otherwise(ms)
    fits = ~F.isnan(x) & (x >= 0) & (x < LAST_SERIAL_1900) & (ms < F.lit(LAST_SERIAL_1900 * DAY_MS))
    micros = F.when(fits, (ms - F.lit(_EPOCH_DAYS * DAY_MS)) * 1000).cast("long")
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def timestamp_from_iso(text: Column) -> Column:
    """Of a date, a date with time, or a time alone (on 1899-12-30), to the millisecond; zones are dropped."""
    pattern = r"^(?:(\d{4}-\d\d-\d\d))?(?:T?(\d\d:\d\d(?::\d\d)?)(?:[.,](\d+))?)?(?:Z|[+-]\d\d:?\d\d)?$"
    text = F.trim(text)
    day, clock, rest = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    ms = F.floor(F.concat(F.lit("0."), rest, F.lit("0")).cast("double") * 1000 + 0.5)
    base = F.concat(F.when(day == "", "1899-12-30").otherwise(day), F.lit(" "),
        F.when(clock == "", "00:00:00").when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock))
    good = text.rlike(pattern) & ((day != "") | (clock != ""))
    return F.when(good, F.try_to_timestamp(base, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ms / 1000))


def is_date_id(number: Column) -> Column:
    return number.isin(*sorted(DATE_FORMAT_IDS))


def is_date_code(code: Column) -> Column:
    """Whether a number format shows a date or time, outside quotes, escapes, colours and General."""
    rest = F.regexp_replace(code, r'(?is)"[^"]*"?|\\.?|[_*].?|\[(?!(?:hh?|mm?|ss?)(?:\]|\z))[^\]]*\]?|general', "")
    return rest.rlike(r"(?i)[ymdhs]|a/p|am/pm")


def builtin_format_id(code: Column) -> Column:
    """The id of a built-in format with exactly that code; -1 if there is none."""
    known = F.create_map(*[F.lit(x) for k, c in BUILTIN_FORMATS.items() for x in (c, k)])
    return F.coalesce(F.try_element_at(known, code), F.lit(-1))


def column_letters(index: Column) -> Column:
    """A for 0 up to XFD; null beyond."""
    k = index.cast("int")
    letter = lambda c: F.char(c + 65)
    one = letter(k)
    two = F.concat(letter(F.floor((k - 26) / 26)), letter(F.pmod(k - 26, F.lit(26))))
    rest = k - 702
    three = F.concat(letter(F.floor(rest / 676)), letter(F.pmod(F.floor(rest / 26), F.lit(26))), letter(F.pmod(rest, F.lit(26))))
    return F.when((k < 0) | (k >= MAX_COLUMNS), F.lit(None)).when(k < 26, one).when(k < 702, two).otherwise(three)


def column_index(letters: Column) -> Column:
    """0 for A; -1 if that is no column."""
    value = lambda p: F.ascii(F.substring(letters, p, 1)) - 64
    n = F.length(letters)
    k = F.when(n == 1, value(1)).when(n == 2, value(1) * 26 + value(2)).otherwise(value(1) * 676 + value(2) * 26 + value(3))
    return F.when(letters.rlike(r"^[A-Z]{1,3}\z") & (k <= MAX_COLUMNS), k - 1).otherwise(F.lit(-1)).cast("int")


def parse_ref(ref: Column) -> Column:
    """struct(row from 1, column from 0) of an A1 reference; null if it is none."""
    pattern = r"^\$?([A-Z]{1,3})\$?([1-9]\d{0,6})\z"
    column, row = column_index(F.regexp_extract(ref, pattern, 1)), F.regexp_extract(ref, pattern, 2)
    number = F.when(row != "", row).cast("int")
    return F.when(ref.rlike(pattern) & (column >= 0) & (number <= MAX_ROWS), F.struct(number.alias("row"), column.alias("column")))


def format_ref(row: Column, column: Column) -> Column:
    return F.concat(column_letters(column), row.cast("string"))


def parse_range(text: Column) -> Column:
    """struct(top, left, bottom, right) with corners in order; null if it is no range."""
    a, b = parse_ref(F.substring_index(text, ":", 1)), parse_ref(F.substring_index(text, ":", -1))
    good = a.isNotNull() & b.isNotNull() & (F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit(""))) <= 1)
    return F.when(good, F.struct(F.least(a["row"], b["row"]).alias("top"), F.least(a["column"], b["column"]).alias("left"),
        F.greatest(a["row"], b["row"]).alias("bottom"), F.greatest(a["column"], b["column"]).alias("right")))


def format_range(top: Column, left: Column, bottom: Column, right: Column) -> Column:
    a, b = format_ref(F.least(top, bottom), F.least(left, right)), format_ref(F.greatest(top, bottom), F.greatest(left, right))
    return F.when(a == b, a).otherwise(F.concat(a, F.lit(":"), b))


def encode_text(text: Column) -> Column:
    """A cell's text for XML: controls as ``_xHHHH_``, look-alikes of such escapes kept apart."""
    out = F.regexp_replace(text, r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_")
    escaped = out
    for code in [*range(9), *range(11, 32), 0xFFFE, 0xFFFF]:
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"_x{code:04X}_"))
    out = F.when(out.rlike("[\\x00-\\x08\\x0B-\\x1F\\uFFFE\\uFFFF]"), escaped).otherwise(out)
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(name))
    return out


def decode_text(text: Column) -> Column:
    """``_xHHHH_`` back to characters, left to right."""
    pattern = "_x[Dd][89ABab][0-9A-Fa-f]{2}__x[Dd][C-Fc-f][0-9A-Fa-f]{2}_|_x[0-9A-Fa-f]{4}_"
    code = lambda m: F.concat(F.substring(m, 3, 4), F.substring(m, 10, 4))  # noqa: E731  (both halves of a pair)
    one = lambda m: F.when((F.length(m) == 7) & m.rlike("(?i)^_xd[89a-f]"), F.lit("\ufffd")).otherwise(F.decode(F.unhex(code(m)), "UTF-16BE"))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one)
    parts = F.split(text, pattern, -1)
    joined = F.array_join(F.zip_with(parts, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("_x")), joined).otherwise(text)


def needs_space(text: Column) -> Column:
    return text.rlike(r"\A | \z|[\t\n\r]")


def utf16_units(text: Column) -> Column:
    """Length in the units in which spreadsheets count."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def limit_text(text: Column, limit: int = MAX_CELL_CHARS, suffix: str = "") -> Column:
    """At most ``limit`` UTF-16 units with the suffix, never half a pair."""
    room = 2 * max(0, limit - len(suffix.encode("utf-16-be")) // 2)
    cut = F.substring(F.encode(text, "UTF-16BE"), 1, room)
    half = F.hex(F.substring(cut, -2, 2)).rlike("^D[89AB]")
    whole = F.when(half, F.substring(F.encode(text, "UTF-16BE"), 1, room - 2)).otherwise(cut)
    return F.when(utf16_units(text) <= limit, text).otherwise(F.concat(F.decode(whole, "UTF-16BE"), F.lit(suffix)))


def clean_sheet_name(name: Column, fallback: str = "Sheet1") -> Column:
    """A name that a sheet may have; names of one workbook are kept apart by ``operators.relations``."""
    edges = lambda c: F.regexp_replace(c, f"^[{SPACES}']+|[{SPACES}']+\\z", "")
    out = edges(F.regexp_replace(name, r"[\\/?*:\[\]\x00-\x1F\uFFFE\uFFFF]", "_"))
    out = F.when(F.lower(out) == "history", F.concat(out, F.lit("_"))).otherwise(out)
    out = F.when(utf16_units(out) > MAX_SHEET_NAME, edges(limit_text(out, MAX_SHEET_NAME))).otherwise(out)
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit(fallback)).otherwise(out)


def valid_sheet_name(name: Column) -> Column:
    return (name != "") & (clean_sheet_name(name) == name)


def quote_sheet_name(name: Column) -> Column:
    return F.when(name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z"), name).otherwise(F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'")))


def parse_number(text: Column) -> Column:
    """The finite decimal number that a cell's text is; null if it is none."""
    value = F.trim(text).try_cast("double")
    good = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z") & (F.abs(value) < float("inf"))
    return F.when(good, F.when(value == 0, F.lit(0.0)).otherwise(value))


def whole_or_text(value: Column) -> Column:
    """A long as a cell keeps it: a number within 2**53, else text."""
    return F.struct(F.when(F.abs(value) <= 2**53, value.cast("double")).alias("n"), F.when(F.abs(value) > 2**53, value.cast("string")).alias("s"))


def sniff_kind(content: Column) -> Column:
    """What a file's first bytes say: zip, empty-zip, encrypted, xls, xml, html, text, empty or unknown.

    The same kinds as ``sources.sniff``.  Text is UTF-16 by its mark, or UTF-8 of which nine tenths are
    printable, or a one-byte code with hardly a control character in it.
    """
    head = F.substring(content, 1, 65_536)
    four, eight = F.hex(F.substring(content, 1, 4)), F.hex(F.substring(content, 1, 8))
    marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    body = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(head, 4, 65_536)).otherwise(head)
    # A code point that is cut at the end of the head is no fault of the text.
    whole = F.coalesce(*[F.when(F.is_valid_utf8(x.cast("string")), x.cast("string")) for x in (body, *[F.substring(body, 1, 65_533 - k) for k in range(4)])])
    text = F.when(marked, F.decode(head, "UTF-16")).otherwise(whole)
    start = F.regexp_replace(text, "^[\ufeff \\t\\r\\n]+", "")
    latin = F.decode(body, "ISO-8859-1")
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    controls = count(latin, r"[\x01-\x08\x0B\x0E-\x1F]")
    odd = count(text, r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}&&[^\t\r\n\f ]]")
    markup = start.rlike(r"^(?:<\?xml|<[A-Za-z_][\w:.-]*[\s/>])")
    return (
        F.when(F.octet_length(content) == 0, "empty")
        .when(four == "504B0304", "zip")
        .when(four.isin("504B0506", "504B0708"), "empty-zip")
        .when(eight == "D0CF11E0A1B11AE1", F.when(F.locate("EncryptedPackage".encode("utf-16-le").hex().upper(), F.hex(head)) > 0, "encrypted").otherwise("xls"))
        .when(text.isNull(), F.when(~F.contains(latin, F.lit("\x00")) & (controls <= F.length(latin) * 0.02), "text").otherwise("unknown"))
        .when(start.rlike(r"(?i)^(<!doctype html|<html)") | markup & F.substring(start, 1, 2000).rlike(r"(?i)<html[\s>]"), "html")
        .when(markup, "xml")
        .when((F.length(text) > 0) & ~F.contains(text, F.lit("\x00")) & (odd <= F.length(text) * 0.1), "text")
        .otherwise("unknown")
    )


#: What a kind that is no workbook is refused with.
REFUSALS = {"encrypted": "ENCRYPTED", "xls": "LEGACY_XLS"}


def refusal_code(kind: Column) -> Column:
    """The error code that a sniffed kind is refused with; null for zip."""
    out = F.when(kind == "zip", F.lit(None).cast("string"))
    for name, code in REFUSALS.items():
        out = out.when(kind == name, code)
    return out.otherwise("NOT_XLSX")


def escape_text(text: Column) -> Column:
    """Markup's text of names and titles: what XML does not allow is dropped."""
    out = F.regexp_replace(text, "[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "")
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(name))
    return out


def escape_attribute(text: Column) -> Column:
    """The same between quotes."""
    out = escape_text(text)
    for plain, name in (('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(plain), F.lit(name))
    return out


def line_ends(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def preview(text: Column, most: int = 60) -> Column:
    """A long text's beginning and its length, for reports."""
    n = utf16_units(text)
    return F.when(n <= most, text).otherwise(F.concat(limit_text(text, most - 3), F.lit("... ("), n.cast("string"), F.lit(" chars)")))


def colour(text: Column) -> Column:
    """#RRGGBB, RRGGBB or AARRGGBB as FFRRGGBB; null if it is none of them."""
    digits = F.upper(F.regexp_replace(text, "^#", ""))
    return F.when(digits.rlike(r"^([0-9A-F]{2})?[0-9A-F]{6}\z"), F.concat(F.lit("FF"), F.right(digits, F.lit(6))))


def iso_text(ts: Column) -> Column:
    """A wall clock time as text, with milliseconds if there are any."""
    ms = F.date_format(ts, "SSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(ms == "000", "").otherwise(F.concat(F.lit("."), ms)))


def document_stamp(ts: Column) -> Column:
    """A document property's time: to the second, in UTC; null outside the years 1 to 9999."""
    return F.when(F.year(ts).between(1, 9999), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def typed_json(kind: Column, s: Column, n: Column, b: Column, ts: Column, err: Column) -> Column:
    """A cell as the JSON of a typed dump: texts, numbers, booleans and null as they are, and objects of one key for
    dates, dates with a time, times of the marker day and errors."""
    day, clock = F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "HH:mm:ss.SSS")
    one = lambda key, value: F.concat(F.lit(f'{{"{key}":"'), value, F.lit('"}'))
    text = F.regexp_replace(F.to_json(F.array(s)), r"(?s)^\[|\]\z", "")
    number = F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("long").cast("string")).otherwise(F.regexp_replace(F.to_json(F.array(n)), r"^\[|\]\z", ""))
    return (
        F.when(kind == "s", text)
        .when(kind == "n", number)
        .when(kind == "b", b.cast("string"))
        .when(kind == "e", one("$error", err))
        .when(kind == "d", F.when(day == "1899-12-30", one("$time", clock)).when(clock == "00:00:00.000",
            one("$date", day)).otherwise(one("$datetime", F.concat(day, F.lit("T"), clock))))
        .otherwise("null")
    )


def typed_moment(text: Column) -> Column:
    """The wall clock time of a typed dump's date, date with a time, or time; null for any other value."""
    inner = lambda key: F.get_json_object(text, f"$['${key}']")
    return F.coalesce(*[timestamp_from_iso(inner(k)) for k in ("datetime", "date", "time")])


def in_clock_gap(ts: Column, zone: str) -> Column:
    """Whether ``zone`` has no such wall clock time, as clocks were put forward."""
    wall = ts.cast("timestamp_ntz").cast("timestamp")
    return F.from_utc_timestamp(F.to_utc_timestamp(wall, zone), zone) != wall


def boolean_text(value: Column) -> Column:
    return F.when(value, "TRUE").when(~value, "FALSE")


def parse_boolean(text: Column) -> Column:
    """1 and true are true, anything else is false; null if blank."""
    return F.when(F.trim(text) != "", F.trim(text).isin("1", "true"))


def sheet_range(rows: Column, columns: Column, absolute: bool = False) -> Column:
    """The range of a sheet's first rows and columns; with dollar signs for a defined name."""
    if absolute:
        return F.concat(F.lit("$A$1:$"), column_letters(columns - 1), F.lit("$"), rows.cast("string"))
    return format_range(F.lit(1), F.lit(0), rows, columns - 1)


def same_number(a: Column, b: Column, tolerance: float = 1e-15) -> Column:
    return (a == b) | (F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b)))


def register_functions(spark) -> None:
    """Number texts for SQL, as Arrow functions; the rest are columns and need no registration."""
    from pyspark.sql.types import StringType

    from . import cells

    def general_text(s: pd.Series) -> pd.Series:
        # Values that come again, as prices do, are spelled once.
        codes, values = s.factorize()
        spelled = [cells.general_text(v) for v in values]
        return pd.Series([None if k < 0 else spelled[k] for k in codes], index=s.index)

    def number_text(s: pd.Series) -> pd.Series:
        from ..sources.cellxml import number_texts

        shown = s.notna() & (s.abs() < float("inf"))
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        out[shown] = number_texts(s[shown].to_numpy(float)).to_pylist()
        return out

    for name, rule in (("general_text", general_text), ("number_text", number_text)):
        spark.udf.register(name, F.pandas_udf(rule, StringType()))
