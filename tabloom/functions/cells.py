"""Cell rules in plain Python, for readers and writers: text escapes, numbers, serials, references.

Column forms of the same rules are in ``columns``; tests hold the two against each other.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
from collections.abc import Iterable
from itertools import count

MAX_ROWS, MAX_COLUMNS = 1_048_576, 16_384
MAX_CELL_CHARS = 32_767
MAX_SHEET_NAME = 31
DAY_MS = 86_400_000
LAST_SERIAL_1900 = 2_958_466
OFFSET_1904 = 1_462
_EPOCH = dt.datetime(1899, 12, 30)

# Ids of built-in number formats that show dates or times.
DATE_FORMAT_IDS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59), *range(71, 82)])
# Error texts that a cell of type e may hold when written.
ERROR_TEXTS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#GETTING_DATA")

_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_LITERAL = re.compile(r"_(?=x[0-9A-Fa-f]{4}_)")
_CONTROL = re.compile("[\x00-\x08\x0b-\x1f￾￿]")


def decode_text(text: str) -> str:
    """``_xHHHH_`` back to characters, left to right."""
    if "_x" not in text:
        return text
    out = _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search("[\ud800-\udfff]", out) else out


def encode_text(text: str) -> str:
    """XML text of a cell: controls as ``_xHHHH_``, and what looks like such an escape kept apart."""
    if "_x" in text:
        text = _LITERAL.sub("_x005F_", text)
    text = _CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", text)
    if re.search("[\ud800-\udfff]", text):
        text = re.sub("[\ud800-\udfff]", "�", text)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attribute(text: str) -> str:
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]", "", text)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("\t", "&#9;").replace("\n",
        "&#10;").replace("\r", "&#13;")


def needs_space(text: str) -> bool:
    return text[:1] == " " or text[-1:] == " " or "\t" in text or "\n" in text or "\r" in text


def units(text: str) -> int:
    """Length in UTF-16 units, in which spreadsheets count."""
    return len(text) + sum(c > "￿" for c in text) if not text.isascii() else len(text)


def limit_text(text: str, limit: int = MAX_CELL_CHARS, suffix: str = "") -> str:
    """At most ``limit`` UTF-16 units with the suffix, never half a pair."""
    if units(text) <= limit:
        return text
    room, out = limit - units(suffix), []
    if room <= 0:
        return limit_text(suffix, limit) if units(suffix) > limit else suffix
    for c in text:
        room -= 1 + (c > "￿")
        if room < 0:
            break
        out.append(c)
    return "".join(out) + suffix


def number_text(x: float) -> str:
    """The shortest decimal text that reads back the same, as spreadsheets write it."""
    if x == 0:
        return "0"
    if isinstance(x, int) or x == int(x) and abs(x) < 2**53:
        return str(int(x))
    text = repr(float(x))
    if "e" in text:
        digits, _, power = text.partition("e")
        p = int(power)
        if -7 <= p < 0:
            sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
            return f"{sign}0.{'0' * (-p - 1)}{digits.replace('.', '').rstrip('0') if digits.endswith('.0') else digits.replace('.', '')}"
        digits = digits.removesuffix(".0")
        if 0 < p < 21:
            sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
            whole, _, part = digits.partition(".")
            return f"{sign}{whole}{part.ljust(p, '0')}"
        return f"{digits}E{'+' if p > 0 else '-'}{abs(p)}"
    return text.removesuffix(".0")


def _rounded(x: float, places: int) -> decimal.Decimal:
    """The exact value of x at so many decimal places, halves away from zero."""
    return decimal.Decimal(x).quantize(decimal.Decimal(1).scaleb(-places), decimal.ROUND_HALF_UP)


def _plain(d: decimal.Decimal) -> str:
    text = f"{d:f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def _exponential(x: float, places: int) -> str:
    """With so many places behind the first digit, zeros at the end dropped, and an exponent of two digits at least."""
    power = decimal.Decimal(x).adjusted()
    d = _rounded(x, places - power)
    if d.adjusted() > power:
        power, d = power + 1, _rounded(x, places - power - 1)
    return f"{_plain(d.scaleb(-power))}E{'+' if power >= 0 else '-'}{abs(power):02d}"


def general_text(x: float) -> str:
    """A number as the General format shows it: eleven characters and a sign, else an exponent.

    Whole numbers keep all their digits.  Below 1 there are nine decimals down to 0.0001; below that, and
    from 1 up to ten digits, as many as fit; with eleven digits before the point there is no room for any.
    """
    with decimal.localcontext() as context:
        context.prec = 400
        if not math.isfinite(x):
            return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
        if x == int(x):
            if abs(x) < 1e21:
                return _plain(decimal.Decimal(repr(float(x)))) if x else "0"
            digits, _, power = repr(float(x)).partition("e")
            return f"{digits.removesuffix('.0')}e{power}"
        room, size = 12 if x < 0 else 11, decimal.Decimal(x).adjusted()
        if -4 <= size <= -1:
            return _plain(_rounded(x, 9))
        if size == 10:
            return _plain(decimal.Decimal(f"{_rounded(x, 10):f}"[:12].rstrip(".")))
        places = 12 if abs(size) <= 9 else 11
        whole = _plain(_rounded(x, places))
        if len(whole) <= room and decimal.Decimal(whole):
            return whole
        if 0 <= size <= 9:
            ten = _rounded(x, 9 - size)
            if ten.adjusted() > size:  # 9.99... went up to the next power
                ten = _rounded(x, 8 - size)
            if ten.adjusted() <= 9 and len(f"{ten:f}") <= room:
                return _plain(ten)
        return _exponential(x, 5)


_NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*")


def parse_number(text: str) -> float | str | None:
    """A cell's number; None if blank; the text itself if it is no finite decimal number."""
    if _NUMBER.fullmatch(text):
        x = float(text)
        if -1.7976931348623157e308 <= x <= 1.7976931348623157e308:
            return x or 0.0
    return text if text.strip() else None


def from_serial(x: float, d1904: bool = False) -> dt.datetime | None:
    """Wall clock time of a serial, to the millisecond; None if there is none.

    In the 1900 system 60 is a day that never was: it reads as the first of March, as 61 does, and
    serials from 1 to below 60 stand a day later than they are counted.
    """
    if not math.isfinite(x) or x < 0:
        return None
    if d1904:
        x += OFFSET_1904
    ms = math.floor(x * DAY_MS + 0.5)
    if ms >= LAST_SERIAL_1900 * DAY_MS:
        return None
    if not d1904 and DAY_MS <= ms < 61 * DAY_MS:
        ms += DAY_MS
    return _EPOCH + dt.timedelta(milliseconds=ms)


def to_serial(t: dt.datetime, d1904: bool = False) -> float | None:
    """The serial of a wall clock time, rounded to the millisecond; None outside the system's years."""
    ms = (t - _EPOCH) // dt.timedelta(microseconds=1)
    ms = (ms + 500) // 1000
    if 0 <= ms < DAY_MS:
        return ms / DAY_MS
    if d1904:
        ms -= OFFSET_1904 * DAY_MS
        return ms / DAY_MS if ms >= 0 else None
    if ms < 61 * DAY_MS:
        ms -= DAY_MS
    return ms / DAY_MS if DAY_MS <= ms < LAST_SERIAL_1900 * DAY_MS else None


_ISO = re.compile(r"(?:(\d{4})-(\d\d)-(\d\d))?(?:T?(\d\d):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?)?(?:Z|[+-]\d\d:?\d\d)?")


def from_iso(text: str) -> dt.datetime | None:
    """A date, a date with time, or a time alone (on the marker day); zones are not applied."""
    m = _ISO.fullmatch(text.strip())
    if not m or not (m[1] or m[4]):
        return None
    try:
        day = dt.datetime(int(m[1]), int(m[2]), int(m[3])) if m[1] else _EPOCH
        clock = dt.timedelta(hours=int(m[4] or 0), minutes=int(m[5] or 0), seconds=int(m[6] or 0), milliseconds=math.floor(float(f"0.{m[7] or 0}") * 1000 + 0.5))
        return day + clock if int(m[4] or 0) < 25 and int(m[5] or 0) < 60 and int(m[6] or 0) < 60 else None
    except (ValueError, OverflowError):
        return None


def iso_text(t: dt.datetime) -> str:
    return f"{t:%Y-%m-%dT%H:%M:%S}" + (f".{t.microsecond // 1000:03d}" if t.microsecond >= 1000 else "") if t.year >= 1000 else t.isoformat(timespec="milliseconds")


# What a format shows as it is; a quote or bracket that isn't closed goes on to the end.  Elapsed time stays.
_LITERALS = re.compile(r'"[^"]*"?|\\.?|[_*].?|\[(?!(?:hh?|mm?|ss?)(?:\]|$))[^\]]*\]?|general', re.IGNORECASE | re.DOTALL)

# Built-in number formats by their ids.
BUILTIN_FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
_BUILTIN_IDS = {code: k for k, code in BUILTIN_FORMATS.items()}


def builtin_format_id(code: str) -> int:
    """The id of a built-in format with exactly that code; -1 if there is none."""
    return _BUILTIN_IDS.get(code, -1)


def is_date_format(code: str) -> bool:
    """Whether a number format shows a date or time: y m d h s or AM/PM outside quotes, escapes and colours."""
    rest = _LITERALS.sub("", code)
    return bool(re.search(r"[ymdhs]|a/p|am/pm", rest, re.IGNORECASE))


def column_letters(k: int) -> str:
    if not 0 <= k < MAX_COLUMNS:
        raise ValueError(k)
    out = ""
    k += 1
    while k:
        k, rest = divmod(k - 1, 26)
        out = chr(65 + rest) + out
    return out


def column_index(letters: str) -> int:
    """0 for A; -1 if that is no column."""
    if not 1 <= len(letters) <= 3 or not letters.isascii() or not letters.isalpha() or not letters.isupper():
        return -1
    k = 0
    for c in letters:
        k = k * 26 + ord(c) - 64
    return k - 1 if k <= MAX_COLUMNS else -1


_REF = re.compile(r"\$?([A-Z]{1,3})\$?([1-9]\d{0,6})")


def parse_ref(ref: str) -> tuple[int, int] | None:
    """(row from 1, column from 0) of an A1 reference."""
    m = _REF.fullmatch(ref)
    if not m or (c := column_index(m[1])) < 0 or int(m[2]) > MAX_ROWS:
        return None
    return int(m[2]), c


def format_ref(row: int, column: int) -> str:
    return f"{column_letters(column)}{row}"


def parse_range(text: str) -> tuple[int, int, int, int] | None:
    """(top, left, bottom, right) with corners in order; one cell is a range."""
    ends = [parse_ref(p) for p in text.split(":")]
    if len(ends) > 2 or None in ends:
        return None
    (r, c), (s, d) = ends[0], ends[-1]
    return min(r, s), min(c, d), max(r, s), max(c, d)


def format_range(top: int, left: int, bottom: int, right: int) -> str:
    a, b = format_ref(min(top, bottom), min(left, right)), format_ref(max(top, bottom), max(left, right))
    return a if a == b else f"{a}:{b}"


_BAD_NAME = re.compile("[\\\\/?*:\\[\\]\x00-\x1f\ufffe\uffff\ud800-\udfff]")
# What counts as white space at a name's edges.
SPACES = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def clean_sheet_name(name: str, taken: tuple[str, ...] = (), number: int | None = None) -> str:
    """A name that a sheet may have, and that none of ``taken`` has in any case."""
    return SheetNames(taken).add(name, number)


class SheetNames:
    """The names of a workbook's sheets, given one after another; numbers known to be taken are not tried again."""

    def __init__(self, taken: Iterable[str] = ()):
        self.used = {t.lower() for t in taken}
        self.free: dict[tuple[str, int], int] = {}  # by a name's cut beginning and the digits behind it
        self.run = (0, 0)  # numbers of sheets without a name, from the first up to the second, that are taken

    def add(self, name: str, number: int | None = None) -> str:
        """A name that a sheet may have, and that no sheet before has in any case."""
        out = _BAD_NAME.sub("_", name).strip(SPACES + "'")
        if out.lower() == "history":
            out += "_"
        out = limit_text(out, MAX_SHEET_NAME).strip(SPACES + "'")
        if not out:
            out = self._unnamed(number if number is not None else len(self.used) + 1)
        if out.lower() in self.used:
            out = self._numbered(out)
        self.used.add(out.lower())
        return out

    def _unnamed(self, k: int) -> str:
        low, high = self.run
        first, k = (low, high) if low <= k < high else (k, k)
        while f"sheet{k}" in self.used:
            k += 1
        self.run = (first, k + 1)
        return f"Sheet{k}"

    def _numbered(self, base: str) -> str:
        for digits in count(1):
            stem = limit_text(base, MAX_SHEET_NAME - digits - 3).rstrip(SPACES)
            key, end = (stem.lower(), digits), 10**digits
            k = self.free.get(key, max(2, end // 10))
            while k < end and f"{stem} ({k})".lower() in self.used:
                k += 1
            self.free[key] = k
            if k < end:
                return f"{stem} ({k})"


def escape_text(text: str) -> str:
    """Markup's text of names and titles: what XML does not allow is dropped."""
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff\ud800-\udfff]", "", text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def preview(text: str, most: int = 60) -> str:
    """A long text's beginning and its length, for reports."""
    return text if units(text) <= most else f"{limit_text(text, most - 3)}... ({units(text)} chars)"


def valid_sheet_name(name: str) -> bool:
    return bool(name) and clean_sheet_name(name) == name


def quote_sheet_name(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) else "'" + name.replace("'", "''") + "'"
