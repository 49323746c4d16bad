"""Plain sheet rows as columns: a block of rows is taken apart by array operations, without a step a cell.

A block is the bytes of whole rows.  Its tags are found and classified at once; only blocks whose tags
follow each other the way most writers put them, and whose attributes are references, styles and
types in double quotes, become a ``Grid``.  Any other block is the row reader's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.cells import DAY_MS, LAST_SERIAL_1900, MAX_ROWS, OFFSET_1904, decode_text, from_iso

# What a cell holds.
TEXT, NUMBER, BOOLEAN, DATE, ERROR = range(1, 6)
KINDS = ("", "s", "n", "b", "d", "e")
EPOCH_DAYS = 25_569

(ROW, ROW_ALONE, ROW_END, C, C_ALONE, C_END, V, V_ALONE, V_END, IS, IS_END, T, T_ALONE, T_END, F, F_ALONE, F_END, OTHER) = range(18)
_CONTENT = (V, V_ALONE, IS, C_END)
_AFTER = {
    ROW: (ROW_END, C, C_ALONE), ROW_ALONE: (ROW, ROW_ALONE), ROW_END: (ROW, ROW_ALONE),
    C: (*_CONTENT, F, F_ALONE), C_ALONE: (C, C_ALONE, ROW_END), C_END: (C, C_ALONE, ROW_END),
    V: (V_END,), V_ALONE: (C_END,), V_END: (C_END,), IS: (T, T_ALONE), IS_END: (C_END,),
    T: (T_END,), T_ALONE: (IS_END,), T_END: (IS_END,), F: (F_END,), F_ALONE: _CONTENT, F_END: _CONTENT,
}
_FOLLOWS = np.zeros((OTHER + 1, OTHER + 1), bool)
for _tag, _next in _AFTER.items():
    _FOLLOWS[_tag, list(_next)] = True

_SHARED, _STRING, _INLINE, _BOOLEAN, _ERROR, _NUMBER, _ISO = range(7)
_PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_ENTITY = re.compile(r"&(amp|lt|gt|quot|apos|#[0-9]{1,8}|#x[0-9a-fA-F]{1,7});")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _entity(m: re.Match) -> str:
    name = m[1]
    if name in _NAMED:
        return _NAMED[name]
    code = int(name[2:], 16) if name[1] == "x" else int(name[1:])
    return chr(code) if 0 < code < 0xD800 or 0xDFFF < code < 0x110000 else m[0]


def resolve(text: str) -> str:
    """Markup's text: line ends as one character, known references as theirs; unknown ones stay."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _ENTITY.sub(_entity, text) if "&" in text else text


@dataclass
class Grid:
    """Rows and their cells with a value, in document order; arrays run parallel to the cells but for
    ``numbers``, the rows' numbers, and ``texts``, to which ``text_at`` points."""

    numbers: np.ndarray
    row: np.ndarray
    column: np.ndarray
    kind: np.ndarray
    number: np.ndarray
    micros: np.ndarray
    text_at: np.ndarray
    texts: pa.Array
    style: np.ndarray

    def where(self, keep: np.ndarray) -> Grid:
        """The cells that ``keep`` marks; rows stay."""
        parts = (getattr(self, n)[keep] for n in ("row", "column", "kind", "number", "micros", "text_at"))
        row, column, kind, number, micros, text_at = parts
        return Grid(self.numbers, row, column, kind, number, micros, text_at, self.texts, self.style[keep])


def _whole(buf: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of at most ``most`` digits between the places, and which of them are such."""
    size = end - start
    value, fine = np.zeros(len(start), np.int64), (size >= 1) & (size <= most)
    for k in range(min(most, int(size.max(initial=0)))):
        live = k < size
        digit = buf[np.minimum(start + k, len(buf) - 1)].astype(np.int64) - 48
        fine &= ~live | ((digit >= 0) & (digit <= 9))
        value = np.where(live, value * 10 + digit, value)
    return value, fine


def _tags(buf: np.ndarray, lt: np.ndarray, gt: np.ndarray) -> np.ndarray:
    """What each tag is."""
    kind, size = np.full(len(lt), OTHER, np.int8), gt - lt
    one, two, three, alone = buf[lt + 1], buf[lt + 2], buf[lt + 3], buf[gt - 1] == ord("/")
    closing = one == ord("/")
    for tag, letter, length in ((C_END, "c", 3), (V_END, "v", 3), (T_END, "t", 3), (F_END, "f", 3), (IS_END, "i", 4)):
        kind[closing & (two == ord(letter)) & (size == length)] = tag
    kind[closing & (two == ord("r")) & (three == ord("o")) & (size == 5)] = ROW_END
    named = (two == ord(" ")) | (two == ord(">")) | (two == ord("/"))
    for tag, other, letter in ((C, C_ALONE, "c"), (T, T_ALONE, "t"), (F, F_ALONE, "f"), (V, V_ALONE, "v")):
        mine = (one == ord(letter)) & named
        kind[mine & ~alone] = tag
        kind[mine & alone] = other
    kind[(one == ord("i")) & (two == ord("s")) & (size == 3)] = IS
    after = buf[lt + 4]
    row = (one == ord("r")) & (two == ord("o")) & (three == ord("w")) & ((after == ord(" ")) | (after == ord(">")) | (after == ord("/")))
    kind[row & ~alone] = ROW
    kind[row & alone] = ROW_ALONE
    return kind


def dates_from_serials(x: np.ndarray, d1904: bool) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds since 1970 of serials, and which of them are dates (see ``cells.from_serial``)."""
    with np.errstate(invalid="ignore", over="ignore"):
        fine = np.isfinite(x) & (x >= 0) & (x < LAST_SERIAL_1900)
        shifted = np.where(fine, x, 0.0) + (OFFSET_1904 if d1904 else 0)
        ms = np.floor(shifted * DAY_MS + 0.5).astype(np.int64)
    fine &= ms < LAST_SERIAL_1900 * DAY_MS
    if not d1904:
        ms += np.where((ms >= DAY_MS) & (ms < 61 * DAY_MS), DAY_MS, 0)
    return (ms - EPOCH_DAYS * DAY_MS) * 1000, fine


def scan(block: bytes, before: int, book, max_columns: int, serials: bool, formulas: bool, kinds_only: bool = False) -> Grid | None:
    """The block's rows; None if it isn't plain.  ``before`` is the number of the row before it.  With
    ``kinds_only`` no text is taken out."""
    if len(block) > book.limits.row_chars:
        return None
    buf = np.frombuffer(block + b" " * 8, np.uint8)
    lt, ends = np.flatnonzero(buf == ord("<")), np.flatnonzero(buf == ord(">"))
    at = np.searchsorted(ends, lt)
    if not len(lt) or at[-1] == len(ends):
        return None
    gt = ends[at]
    if (gt[:-1] > lt[1:]).any():
        return None
    tag = _tags(buf, lt, gt)
    if tag[0] not in (ROW, ROW_ALONE) or tag[-1] not in (ROW_END, ROW_ALONE) or not _FOLLOWS[tag[:-1], tag[1:]].all():
        return None
    if formulas and (tag >= F).any():
        return None

    # Attributes: one letter between a space and =", up to the next quote.
    quotes, equals = np.flatnonzero(buf == ord('"')), np.flatnonzero(buf == ord("="))
    equals = equals[(equals >= 2)]
    equals = equals[(buf[equals - 2] == ord(" ")) & (buf[equals + 1] == ord('"'))]
    letter = buf[equals - 1]
    opening = np.flatnonzero(np.isin(tag, (ROW, ROW_ALONE, C, C_ALONE, T, T_ALONE, V, F, F_ALONE)))
    apart = np.searchsorted(quotes, gt[opening]) - np.searchsorted(quotes, lt[opening])
    if (apart % 2).any():
        return None  # a > within quotes
    singles = np.flatnonzero(buf == ord("'")) if b"'" in block else ()
    if len(singles) and (np.searchsorted(singles, gt[opening]) != np.searchsorted(singles, lt[opening])).any():
        return None

    def attribute(name: str, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each tag has it, and between which places its value stands."""
        places = equals[letter == ord(name)]
        if not len(places):
            return np.zeros(len(first), bool), first, first
        k = np.minimum(np.searchsorted(places, first), len(places) - 1)
        start = places[k] + 2
        has = (places[k] > first) & (places[k] < last)
        return has, start, quotes[np.minimum(np.searchsorted(quotes, start), len(quotes) - 1)]

    rows = np.flatnonzero(tag <= ROW_ALONE)
    has, start, end = attribute("r", lt[rows], gt[rows])
    value, fine = _whole(buf, start, end, 7)
    given = has & fine & (value >= 1) & (value <= MAX_ROWS)
    places = np.arange(len(rows))
    anchor = np.maximum.accumulate(np.where(given, places, -1))
    numbers = np.where(anchor >= 0, value[anchor] + places - anchor, before + 1 + places)

    cells = np.flatnonzero((tag == C) | (tag == C_ALONE))
    first, last = lt[cells], gt[cells]
    row = np.searchsorted(rows, cells, "right") - 1
    has_r, start_r, end_r = attribute("r", first, last)
    has_s, start_s, end_s = attribute("s", first, last)
    has_t, start_t, end_t = attribute("t", first, last)
    known = 2 * (has_r.astype(np.int64) + has_s + has_t)
    if (np.searchsorted(quotes, last) - np.searchsorted(quotes, first) != known).any():
        return None

    # Columns: the letters of a reference, else the next one.
    codes = [buf[np.minimum(start_r + k, len(buf) - 1)].astype(np.int64) - 64 for k in range(4)]
    is_letter = [(c >= 1) & (c <= 26) for c in codes]
    two, three = is_letter[0] & is_letter[1], is_letter[0] & is_letter[1] & is_letter[2]
    if (has_r & (~is_letter[0] | three & is_letter[3])).any():
        return None
    column = np.where(three, (codes[0] * 26 + codes[1]) * 26 + codes[2], np.where(two, codes[0] * 26 + codes[1], codes[0])) - 1
    places = np.arange(len(cells))
    begins = np.ones(len(cells), bool)
    begins[1:] = row[1:] != row[:-1]
    anchor = np.maximum.accumulate(np.where(has_r | begins, places, 0)) if len(cells) else places
    column = np.where(has_r, column, 0)[anchor] + places - anchor
    if len(column) and column.max() >= max_columns:
        return None

    style, fine = _whole(buf, start_s, end_s, 9)
    if (has_s & ~fine).any():
        return None
    style = np.where(has_s, style, 0)
    size, initial = end_t - start_t, buf[np.minimum(start_t, len(buf) - 1)]
    kind = np.where(has_t, -1, _NUMBER)
    for code, name in ((_SHARED, "s"), (_STRING, "str"), (_INLINE, "inlineStr"), (_BOOLEAN, "b"), (_ERROR, "e"), (_NUMBER, "n"), (_ISO, "d")):
        kind[has_t & (size == len(name)) & (initial == ord(name[0]))] = code
    if (kind < 0).any():
        return None

    # Where values stand: behind <v> or <is><t>, after a formula if there is one.
    inner = np.minimum(cells + 1, len(tag) - 1)
    inner = np.where(tag[inner] == F, inner + 2, np.where(tag[inner] == F_ALONE, inner + 1, inner))
    content, within = tag[inner], tag[np.minimum(inner + 1, len(tag) - 1)]
    open_ = tag[cells] == C
    plain, inline = open_ & ((content == V) | (content == V_ALONE)), open_ & (content == IS)
    holder = np.where(inline, inner + 1, inner)
    start = gt[np.minimum(holder, len(gt) - 1)] + 1
    end = lt[np.minimum(holder + 1, len(lt) - 1)]
    empty = (plain & (content == V_ALONE)) | (inline & (within == T_ALONE))
    end = np.where(empty, start, end)
    filled = end > start
    words = (kind == _STRING) | (kind == _INLINE)
    valued = (plain & (words | filled)) | (inline & (kind == _INLINE))
    picked = np.flatnonzero(valued)
    row, column, style, kind, start, end = (x[picked] for x in (row, column, style, kind, start, end))
    if ((row[1:] == row[:-1]) & (column[1:] <= column[:-1])).any():
        return None

    out = np.zeros(len(picked), np.int8)
    number, micros, text_at = np.zeros(len(picked)), np.zeros(len(picked), np.int64), np.full(len(picked), -1, np.int64)

    def slices(which: np.ndarray) -> list[bytes]:
        return [block[a:b] for a, b in zip(start[which].tolist(), end[which].tolist())]

    texts: list[pa.Array] = []
    held = 0
    if kinds_only:
        out[(kind == _STRING) | (kind == _INLINE) | (kind == _SHARED)], out[kind == _ERROR] = TEXT, ERROR
        kind = np.where((kind == _NUMBER) | (kind == _BOOLEAN) | (kind == _ISO), kind, -1)
    try:
        if len(mine := np.flatnonzero((kind == _STRING) | (kind == _INLINE) | (kind == _ERROR))):
            found = pa.array(slices(mine), pa.binary()).cast(pa.string())
            if pc.max(pc.utf8_length(found)).as_py() > book.limits.text // 2:
                return None
            if b"&" in block or b"\r" in block or b"_x" in block:
                odd = np.flatnonzero(pc.match_substring_regex(found, r"[&\r]|_x").to_numpy(zero_copy_only=False))
                if len(odd):
                    raw, shown = found.to_pylist(), kind[mine] != _ERROR
                    for k in odd.tolist():
                        raw[k] = decode_text(resolve(raw[k])) if shown[k] else resolve(raw[k])
                    found = pa.array(raw, pa.string())
            out[mine] = np.where(kind[mine] == _ERROR, ERROR, TEXT)
            text_at[mine] = held + np.arange(len(mine))
            texts.append(found)
            held += len(found)
        if len(mine := np.flatnonzero(kind == _SHARED)):
            index, fine = _whole(buf, start[mine], end[mine], 9)
            items = book.string_array()
            if not fine.all() or index.max() >= len(items):
                return None
            out[mine], text_at[mine] = TEXT, held + np.arange(len(mine))
            texts.append(items.take(pa.array(index)))
            held += len(mine)
        if len(mine := np.flatnonzero(kind == _NUMBER)):
            found = pa.array(slices(mine), pa.binary()).cast(pa.string())
            if not pc.all(pc.match_substring_regex(found, _PLAIN_NUMBER)).as_py():
                return None
            x = found.cast(pa.float64()).to_numpy() + 0.0
            if not np.isfinite(x).all():
                return None
            out[mine], number[mine] = NUMBER, x
            if not serials and len(book.dates):
                flags, styles = np.array(book.dates, bool), style[mine]
                dated = flags[np.minimum(styles, len(flags) - 1)] & (styles < len(flags))
                when, fine = dates_from_serials(x, book.d1904)
                dated &= fine
                out[mine[dated]], micros[mine[dated]] = DATE, when[dated]
        if len(mine := np.flatnonzero(kind == _BOOLEAN)):
            digit, short = buf[start[mine]], end[mine] - start[mine] == 1
            out[mine], number[mine] = BOOLEAN, short & (digit == ord("1"))
            for k in mine[~short | (digit < ord("0"))].tolist():
                said = block[start[k] : end[k]].strip()
                if not said:
                    return None
                number[k] = said in (b"1", b"true")
        if (kind == _ISO).any():
            moments = {k: from_iso(resolve(block[start[k] : end[k]].decode())) for k in np.flatnonzero(kind == _ISO).tolist()}
            if None in moments.values():
                return None
            for k, t in moments.items():
                out[k], micros[k] = DATE, pa.scalar(t, pa.timestamp("us")).value
    except (pa.ArrowInvalid, UnicodeDecodeError):
        return None
    joined = pa.concat_arrays(texts) if texts else pa.array([], pa.string())
    return Grid(numbers, row, column, out, number, micros, text_at, joined, style)


_ROW_NUMBER = re.compile(rb'<row\s(?:[^>]*\s)?r="([0-9]{1,7})"')


def count_rows(block: bytes, before: int) -> tuple[int, int]:
    """How many rows the block has, and the last one's number.  Nothing else in it begins like a row."""
    count, at, back = block.count(b"<row"), len(block), 0
    while (at := block.rfind(b"<row", 0, at)) >= 0:
        m = _ROW_NUMBER.match(block, at)
        if m and 0 < int(m[1]) <= MAX_ROWS:
            return count, int(m[1]) + back
        back += 1
    return count, before + count
