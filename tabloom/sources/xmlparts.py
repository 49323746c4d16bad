"""XML of workbook parts: namespace prefixes dropped, DOCTYPE refused, depth and text bounded."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable
from xml.parsers import expat

from ..errors import SheetError
from .container import Limits

_LOOSE = re.compile(r"&(?!(?:amp|lt|gt|quot|apos);|#[0-9]{1,8};|#x[0-9a-fA-F]{1,7};)")
_REFERENCE = re.compile(r"&#(x[0-9a-fA-F]+|[0-9]+);")


def _allowed(m: re.Match) -> str:
    code = int(m[1][1:], 16) if m[1][0] == "x" else int(m[1])
    fine = code in (9, 10, 13) or 0x20 <= code < 0xD800 or 0xE000 <= code < 0xFFFE or 0x10000 <= code < 0x110000
    return m[0] if fine else "&amp;" + m[0][1:]


def mend(text: str) -> str:
    """References that XML does not know stay as text, outside CDATA sections."""
    if "&" not in text:
        return text
    parts = re.split(r"(<!\[CDATA\[.*?\]\]>)", text, flags=re.DOTALL) if "<![CDATA[" in text else [text]
    parts[::2] = [_REFERENCE.sub(_allowed, _LOOSE.sub("&amp;", p)) for p in parts[::2]]
    return "".join(parts)


class Handler:
    """What a part's reader does at elements and text; names come without prefix."""

    def start(self, name: str, attributes: dict[str, str]) -> None: ...
    def end(self, name: str) -> None: ...
    def text(self, data: str) -> None: ...


class _Stop(Exception):
    pass


def stop() -> None:
    """Called in a handler: no more of the part is needed."""
    raise _Stop


def _local(name: str) -> str:
    return name.rpartition(":")[2]


class Feeder:
    """Feeds decoded text to a handler, piece by piece."""

    def __init__(self, handler: Handler, limits: Limits):
        self.handler, self.limits, self.depth, self.run, self.held = handler, limits, 0, 0, ""
        p = self.parser = expat.ParserCreate()
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._text
        p.StartDoctypeDeclHandler = self._doctype

    def _doctype(self, *_):
        raise SheetError("XML_DOCTYPE", "a part declares a document type")

    def _start(self, name, attributes):
        self.depth, self.run = self.depth + 1, 0
        if self.depth > self.limits.depth:
            raise SheetError("LIMIT_EXCEEDED", "elements are nested too deeply", limit="depth")
        self.handler.start(_local(name), {_local(k): v for k, v in attributes.items()} if any(":" in k for k in attributes) else attributes)

    def _end(self, name):
        self.depth, self.run = self.depth - 1, 0
        self.handler.end(_local(name))

    def _text(self, data):
        self.run += len(data)
        if self.run > self.limits.text:
            raise SheetError("LIMIT_EXCEEDED", "a text is too long", limit="text")
        self.handler.text(data)

    def feed(self, text: str, last: bool = False) -> None:
        text = self.held + text
        # A reference or section that may go on in the next piece waits for it.
        cut = len(text)
        if not last:
            amp = text.rfind("&", max(0, cut - 12))
            if amp >= 0 and ";" not in text[amp:]:
                cut = amp
            opened = text.rfind("<![CDATA[", 0, cut)
            if opened >= 0 and "]]>" not in text[opened:cut] and cut - opened < 1 << 20:
                cut = opened
        self.held, text = text[cut:], text[:cut]
        try:
            self.parser.Parse(mend(text), last)
        except expat.ExpatError as e:
            raise SheetError("XML_MALFORMED", str(e)) from e


def decoded(chunks: Iterable[bytes]) -> Iterable[str]:
    """UTF-8 (or UTF-16, by its mark) text of byte chunks, without a byte order mark."""
    decoder, first = None, True
    for chunk in chunks:
        if decoder is None:
            kind = "utf-16" if chunk[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8"
            decoder = codecs.getincrementaldecoder(kind)("replace")
        text = decoder.decode(chunk)
        if first and text:
            text, first = re.sub(r"^﻿?(\s*<\?xml[^>]*\?>)?", "", text, count=1), False
        yield text


def parse(chunks: Iterable[bytes], handler: Handler, limits: Limits) -> None:
    feeder = Feeder(handler, limits)
    try:
        for text in decoded(chunks):
            feeder.feed(text)
        feeder.feed("", True)
    except _Stop:
        return
