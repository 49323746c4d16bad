"""Cell rules, and their column forms against them."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tabloom.functions import cells as C, columns as X


def test_serials_of_the_1900_system():
    day = lambda x: C.from_serial(x)
    assert day(0) == dt.datetime(1899, 12, 30) and day(1) == dt.datetime(1900, 1, 1) and day(59) == dt.datetime(1900, 2, 28)
    assert day(60) == day(61) == dt.datetime(1900, 3, 1) and day(45351.5) == dt.datetime(2024, 2, 29, 12)
    assert day(2958465) == dt.datetime(9999, 12, 31) and day(2958466) is None and day(-1) is None and day(float("nan")) is None
    assert day(1 - 1e-12) == dt.datetime(1900, 1, 1)  # rounds up into the next day
    for x in (0.25, 1, 59, 61, 45351.123):
        assert abs(C.to_serial(C.from_serial(x)) - x) < 1e-8
    assert C.to_serial(dt.datetime(1899, 12, 29)) is None and C.to_serial(dt.datetime(1899, 12, 31)) is None


def test_serials_of_the_1904_system():
    assert C.from_serial(0, True) == dt.datetime(1904, 1, 1) and C.to_serial(dt.datetime(1904, 1, 2), True) == 1
    assert C.to_serial(dt.datetime(1903, 12, 31), True) is None


def test_text_escapes():
    for text in ["_x0041_", "_x005F_x0041_", "\x01\x1f\x7f\x00", "a\tb\nc\rd", "_x00", "__x0041_", "_xZZZZ_", "_X0041_", "é😀"]:
        encoded = C.encode_text(text)
        assert C.decode_text(encoded.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")) == text
    assert C.encode_text("\x01") == "_x0001_" and C.encode_text("a\rb") == "a_x000D_b" and C.decode_text("_xD83D__xDE00_") == "😀"
    assert C.decode_text("_X0041_") == "_X0041_"


def test_limits_count_utf16_units():
    text = "😀" * 20_000
    out = C.limit_text(text)
    assert C.units(out) <= C.MAX_CELL_CHARS and out == "😀" * 16_383
    assert C.limit_text("x" * 40_000, suffix="...") == "x" * 32_764 + "..." and C.limit_text("abc", 2, "wxyz") == "wx"


@pytest.mark.parametrize("x,text", [(0.0, "0"), (-0.0, "0"), (42.0, "42"), (0.1 + 0.2, "0.30000000000000004"), (1e21, "1E+21"), (1e-300, "1E-300"), (1.5e-7, "0.00000015"), (-2.5, "-2.5"), (123456789012345680000.0, "123456789012345680000")])
def test_number_text(x, text):
    assert C.number_text(x) == text and float(text) == x


@pytest.mark.parametrize(
    "x,text",
    [
        (1234.5, "1234.5"), (1 / 3, "0.333333333"), (12345678901.0, "12345678901"), (-5, "-5"), (0.0, "0"), (-0.0, "0"),
        # Whole numbers keep their digits; small ones are plain while they fit; with eleven digits there is no fraction.
        (123456789012.0, "123456789012"), (0.00001234, "0.00001234"), (-1e-7, "-0.0000001"), (12345678901.5, "12345678901"), (1e21, "1e+21"),
        (4.2728917499999985, "4.27289175"), (1.2345678e-7, "1.23457E-07"), (123456789012.5, "1.23457E+11"), (99999.999999999, "100000"),
        (9999999999.95, "1E+10"), (-1234567.891234, "-1234567.891"), (2.0**-10, "0.000976563"), (1e-10, "1E-10"), (123456789012345680000.0, "123456789012345680000"),
    ],
)
def test_general_text(x, text):
    assert C.general_text(x) == text


def test_parse_number():
    assert C.parse_number("1e3") == 1000 and C.parse_number(" ") is None and C.parse_number("0x1F") == "0x1F" and C.parse_number("1e999") == "1e999" and C.parse_number("nan") == "nan"
    assert str(C.parse_number("-0")) == "0.0"


def test_references():
    assert [C.column_letters(k) for k in (0, 25, 26, 701, 702, 16383)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert all(C.column_index(C.column_letters(k)) == k for k in range(16384))
    assert C.column_index("XFE") == C.column_index("a") == C.column_index("") == -1
    assert C.parse_ref("$B$3") == (3, 1) and C.parse_ref("A0") is None and C.parse_ref("XFE1") is None and C.parse_ref("A1048577") is None
    assert C.parse_range("C3:A1") == (1, 0, 3, 2) and C.format_range(3, 2, 1, 0) == "A1:C3" and C.parse_range("A1") == (1, 0, 1, 0)


def test_sheet_names():
    assert C.clean_sheet_name("a/b:c") == "a_b_c" and C.clean_sheet_name("'x'") == "x" and C.clean_sheet_name("History") == "History_"
    assert C.clean_sheet_name("", ("a",)) == "Sheet2" and C.clean_sheet_name("A", ("a", "a (2)")) == "A (3)" and len(C.clean_sheet_name("x" * 40)) == 31
    assert C.clean_sheet_name("x" * 31, ("x" * 31,)) == "x" * 27 + " (2)" and C.valid_sheet_name("ok") and not C.valid_sheet_name("a*b")
    assert C.clean_sheet_name("a", ("a", "a", "a (2)")) == "a (3)" and C.clean_sheet_name("x" * 31, tuple(["x" * 31] + ["x" * 27 + f" ({k})" for k in range(2, 10)])) == "x" * 26 + " (10)"
    assert C.clean_sheet_name(" ' 'a' ' ") == "a" and C.clean_sheet_name("\u00a0b\ufeff") == "b" and C.clean_sheet_name("", ("sheet2", "x"), None) == "Sheet3" and C.clean_sheet_name("a\x7f") == "a\x7f"
    assert C.clean_sheet_name("", ("Sheet2",)) == "Sheet3"
    assert C.quote_sheet_name("It's") == "'It''s'" and C.quote_sheet_name("Data_1") == "Data_1"


@pytest.mark.parametrize("code,date", [("yyyy-mm-dd", True), ("0.00", False), ("[h]:mm", True), ('"day" 0', False), ("General", False), ("[Red]0", False), ("h AM/PM", True), ("0\\d", False), ("_d0", False), ("[$-409]d", True), ("[Red", False), ("[hh", True), ('"y', False), ("[hhh]0", False), ("0\\", False), ("[Red]yy", True), ("*d0", False), ("a/p", True)])
def test_date_formats(code, date):
    assert C.is_date_format(code) is date


def test_iso():
    assert C.from_iso("2024-02-29") == dt.datetime(2024, 2, 29) and C.from_iso("2024-02-29T01:02:03.9996Z") == dt.datetime(2024, 2, 29, 1, 2, 4)
    assert C.from_iso("12:30") == dt.datetime(1899, 12, 30, 12, 30) and C.from_iso("2023-02-29") is None and C.from_iso("x") is None and C.from_iso("") is None


def test_columns_agree_with_the_rules(spark):
    rnd = random.Random(3)
    # Markup comes back as XML, so decoding is held against the rule on the same encoded text.
    texts = ["_x0041_", "a_x005F_x0041_", "\x01\x1f", " a", "a\n", "", "plain", "_xD83D__xDE00_", "😀" * 40, "It's", "x" * 50, "History", "a/b", "'q'"] + ["".join(rnd.choice("_x0041\x02 '/<&é😀") for _ in range(20)) for _ in range(100)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = d.select("t", X.encode_text(t).alias("enc"), X.needs_space(t).alias("space"), X.utf16_units(t).alias("units"), X.limit_text(t, 15, "~").alias("cut"), X.clean_sheet_name(t).alias("name"), X.quote_sheet_name(t).alias("quoted"), X.decode_text(X.encode_text(t)).alias("back")).collect()
    for r in got:
        s = r["t"]
        assert r["enc"] == C.encode_text(s) and r["space"] == C.needs_space(s) and r["units"] == C.units(s), s
        assert r["cut"] == C.limit_text(s, 15, "~") and r["quoted"] == C.quote_sheet_name(s), s
        assert r["back"] == C.decode_text(C.encode_text(s)), s
    codes = ["yyyy", "[Red", "[Red]0", "[h]", "[hh", "[hhh]", '"d', "0\\d", "_d", "*y0", "General", "a/p", "[$-409]d;@"]
    for r in spark.createDataFrame([(c,) for c in codes], "c string").select("c", X.is_date_code(F.col("c")).alias("d")).collect():
        assert r["d"] == C.is_date_format(r["c"]), r["c"]
    serials = [0.0, 0.5, 1.0, 59.25, 60.0, 61.0, 45351.123456, 2958465.9, 2958466.0, -1.0, float("nan"), 1 - 1e-12]
    d = spark.createDataFrame([(x,) for x in serials], "x double")
    for old in (False, True):
        for r in d.select("x", X.timestamp_from_serial(F.col("x"), old).alias("t"), X.serial_from_timestamp(X.timestamp_from_serial(F.col("x"), old), old).alias("back")).collect():
            want = C.from_serial(r["x"], old)
            assert r["t"] == want, r["x"]
            if want:
                assert r["back"] == C.to_serial(want, old)
    isos = ["2024-02-29", "2024-02-29T01:02:03.9996Z", "12:30", "2023-02-29", "x", "", "2024-01-01T10:11:12+02:00"]
    for r in spark.createDataFrame([(x,) for x in isos], "x string").select("x", X.timestamp_from_iso(F.col("x")).alias("t")).collect():
        assert r["t"] == C.from_iso(r["x"]), r["x"]


def test_many_names_of_sheets():
    """The same names as one by one with all the others, in any case, and in time in proportion to their number."""
    def plain(name, used):
        out = C.clean_sheet_name(name)
        if not name and out.lower() in used:
            k = len(used) + 1
            while f"sheet{k}" in used:
                k += 1
            return f"Sheet{k}"
        base, k = out, 2
        while out.lower() in used:
            tail = f" ({k})"
            out, k = C.limit_text(base, 31 - len(tail)).rstrip() + tail, k + 1
        return out

    rng = random.Random(5)
    some = ["", "a", "A", "a (2)", "A (3)", "x" * 31, "X" * 31, "x" * 27 + " (2)", "x" * 26 + "y" * 5, "Sheet2", "sheet40", "sheet41", "\u0130" * 31, "i\u0307" * 15, "\u03a3" * 30, "a" * 26 + "\U0001f600" * 3]
    for _ in range(20):
        names, used = C.SheetNames(), set()
        for name in rng.choices(some, k=150):
            wanted = plain(name, used)
            assert names.add(name, 1 if "sheet1" not in names.used else None) == wanted
            used.add(wanted.lower())
    began, names = time.process_time(), C.SheetNames()
    made = {names.add(rng.choice(("x" * 31, "X" * 31, "b", ""))).lower() for _ in range(40_000)}
    assert len(made) == 40_000 and time.process_time() - began < 10


def test_names_of_a_large_workbook(spark):
    """Took minutes when every name was compared with a new set of all others."""
    from tabloom.operators.relations import unique_sheet_names

    rows = spark.range(30_000).selectExpr("1 AS workbook", "id AS position", "if(id % 2 = 0, 'a', 'B') AS name")
    began = time.time()
    got = unique_sheet_names(rows).selectExpr("count(DISTINCT lower(name))", "max(length(name))").first()
    assert tuple(got) == (30_000, 9) and time.time() - began < 30
