"""What kind of file the first bytes are."""

from __future__ import annotations

import re

from ..errors import SheetError

SNIFF_BYTES = 65_536
_OLE = bytes.fromhex("D0CF11E0A1B11AE1")


def sniff(head: bytes) -> str:
    """zip, empty-zip, encrypted, xls, xml, html, text, empty or unknown."""
    if not head:
        return "empty"
    if head[:4] == b"PK\x03\x04":
        return "zip"
    if head[:4] in (b"PK\x05\x06", b"PK\x07\x08"):
        return "empty-zip"
    if head[:8] == _OLE:
        return "encrypted" if "EncryptedPackage".encode("utf-16-le") in head else "xls"
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = head[: len(head) // 2 * 2].decode("utf-16", "replace")
    else:
        body = head[3:] if head[:3] == b"\xef\xbb\xbf" else head
        try:
            text = body.decode("utf-8")
        except UnicodeDecodeError as e:
            text = body[: e.start].decode("utf-8") if e.start > len(body) - 4 and len(body) >= SNIFF_BYTES - 4 else None
        if text is None:
            controls = sum(b < 32 and b not in (9, 10, 12, 13) for b in body)
            return "text" if b"\0" not in body and controls <= 0.02 * len(body) else "unknown"
    start = text.lstrip("﻿ \t\r\n")
    if re.match(r"<!doctype html|<html", start, re.IGNORECASE):
        return "html"
    if start.startswith("<?xml") or re.match(r"<[A-Za-z_][\w:.-]*[\s/>]", start):
        return "html" if re.search(r"<html[\s>]", start[:2000], re.IGNORECASE) else "xml"
    printable = sum(c.isprintable() or c in "\t\r\n\f" for c in text)
    return "text" if text and "\0" not in text and printable >= 0.9 * len(text) else "unknown"


def reject(kind: str) -> None:
    """Raises for every kind that can't be a workbook."""
    if kind == "encrypted":
        raise SheetError("ENCRYPTED", "this workbook is password-protected")
    if kind == "xls":
        raise SheetError("LEGACY_XLS", "this is a legacy binary workbook")
    if kind == "empty-zip":
        raise SheetError("NOT_XLSX", "this archive is empty", format="zip")
    if kind != "zip":
        raise SheetError("NOT_XLSX", f"this is no workbook but {kind}", format=kind)
