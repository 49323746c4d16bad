"""The error that every part of the library raises, with a code that says what went wrong."""

from __future__ import annotations

# The codes of errors.
CODES = (
    "NOT_XLSX", "ENCRYPTED", "LEGACY_XLS", "XLSB", "ODS", "ZIP_TRUNCATED", "ZIP_BOMB", "ZIP_DUPLICATE_ENTRY", "ZIP_UNSUPPORTED", "ZIP_CRC_MISMATCH", "XML_DOCTYPE",
    "XML_MALFORMED", "LIMIT_EXCEEDED", "SHEET_NOT_FOUND", "INVALID_SHEET_NAME", "ROW_OUT_OF_RANGE", "CELL_TOO_LONG", "ENTRY_TOO_LARGE", "WRITER_STATE", "ABORTED", "IO_ERROR", "UNSUPPORTED_ENVIRONMENT", "TYPE_MISMATCH",
)


class SheetError(Exception):
    """``code`` is one of CODES; ``detail`` holds what a caller may act on."""

    def __init__(self, code: str, message: str, **detail):
        assert code in CODES
        super().__init__(f"[{code}] {message}")
        self.code, self.message, self.detail = code, message, detail

    def __reduce__(self):
        return _rebuild, (self.code, self.message, self.detail)


def _rebuild(code: str, message: str, detail: dict) -> SheetError:
    return SheetError(code, message, **detail)


def error_code(error: BaseException) -> str | None:
    """The code of an error raised here, or of one that came back from a Spark task as text."""
    if isinstance(error, SheetError):
        return error.code
    text = str(error)
    return next((c for c in CODES if f"[{c}]" in text), None)
