"""The ZIP container of a workbook: entries located by range reads, inflated in bounded chunks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..errors import SheetError

CHUNK = 1 << 18
WHOLE_PART = 32 << 20
SLACK = 4096


@dataclass(frozen=True)
class Limits:
    """What a reader accepts before it stops with LIMIT_EXCEEDED or ZIP_BOMB."""

    inflated_bytes: int = 1 << 30
    shared_chars: int = 256 << 20
    entries: int = 10_000
    depth: int = 256
    text: int = 1 << 20
    row_chars: int = 64 << 20
    columns: int = 16_384
    cell_formats: int = 65_490


@dataclass(frozen=True)
class Entry:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    offset: int


@dataclass
class Container:
    """Directory of a ZIP file on a seekable binary file."""

    source: object
    limits: Limits = field(default_factory=Limits)

    def __post_init__(self):
        self.source.seek(0, 2)
        self.length = self.source.tell()
        self.entries: dict[str, Entry] = {}
        for entry in self._directory():
            if entry.name in self.entries:
                raise SheetError("ZIP_DUPLICATE_ENTRY", f"{entry.name} is there twice", name=entry.name)
            self.entries[entry.name] = entry
        self.folded: dict[str, str] = {}
        for name in self.entries:
            self.folded.setdefault(_fold(name), name)

    def _span(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.length:
            raise SheetError("ZIP_TRUNCATED", "a range lies outside the file")
        self.source.seek(at)
        return self.source.read(n)

    def _directory(self) -> Iterator[Entry]:
        begin = max(0, self.length - 22 - 0xFFFF)
        tail = self._span(begin, self.length - begin)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0 or end + 22 > len(tail):
            raise SheetError("ZIP_TRUNCATED", "the archive has no end record")
        count, size, start = struct.unpack_from("<H2I", tail, end + 10)
        at = begin + end - 20
        if (count == 0xFFFF or 0xFFFFFFFF in (size, start)) and at >= 0 and self._span(at, 4) == b"PK\x06\x07":
            record = self._span(struct.unpack("<Q", self._span(at + 8, 8))[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise SheetError("ZIP_TRUNCATED", "the ZIP64 end record is missing")
            count, size, start = struct.unpack_from("<3Q", record, 32)
        if count > self.limits.entries:
            raise SheetError("LIMIT_EXCEEDED", f"{count} entries", limit="entries")
        listing, at = self._span(start, size), 0
        for _ in range(count):
            if listing[at : at + 4] != b"PK\x01\x02" or at + 46 > len(listing):
                raise SheetError("ZIP_TRUNCATED", "the central directory is cut short")
            flags, method = struct.unpack_from("<2H", listing, at + 8)
            crc, packed, plain, n, m, k = struct.unpack_from("<3I3H", listing, at + 16)
            offset = struct.unpack_from("<I", listing, at + 42)[0]
            raw, extra = listing[at + 46 : at + 46 + n], listing[at + 46 + n : at + 46 + n + m]
            wide = [plain, packed, offset]
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<2H", extra)
                if kind == 1:
                    values = iter(struct.unpack_from(f"<{min(length, len(extra) - 4) // 8}Q", extra, 4))
                    wide = [next(values, v) if v == 0xFFFFFFFF else v for v in wide]
                extra = extra[4 + length :]
            at += 46 + n + m + k
            name = raw.decode("utf-8" if flags & 0x800 else "cp437", "replace").replace("\\", "/").lstrip("/")
            if name.endswith("/"):
                continue
            if flags & 1 or method not in (0, 8):
                raise SheetError("ZIP_UNSUPPORTED", f"{name} is encrypted or packed by method {method}", name=name)
            yield Entry(name, method, crc, wide[1], wide[0], wide[2])

    def find(self, name: str) -> str | None:
        """The entry of that name, or the first that differs in ASCII case only."""
        name = name.lstrip("/")
        return name if name in self.entries else self.folded.get(_fold(name))

    def stream(self, name: str) -> Iterator[bytes]:
        """The entry's bytes in chunks; sizes are capped as they come, the checksum is verified last."""
        found = self.find(name)
        if found is None:
            raise SheetError("NOT_XLSX", f"the part {name} is missing", name=name)
        entry = self.entries[found]
        header = self._span(entry.offset, 30)
        if header[:4] != b"PK\x03\x04":
            raise SheetError("ZIP_TRUNCATED", f"{found} has no local header")
        n, m = struct.unpack_from("<2H", header, 26)
        at, left, crc, total = entry.offset + 30 + n + m, entry.packed, 0, 0
        cap = min(self.limits.inflated_bytes, entry.size + SLACK)
        inflate = zlib.decompressobj(-15) if entry.method == 8 else None
        while left:
            packed = self._span(at, min(CHUNK, left))
            at, left = at + len(packed), left - len(packed)
            while packed:
                try:
                    chunk = inflate.decompress(packed, CHUNK * 4) if inflate else packed
                except zlib.error as e:
                    raise SheetError("ZIP_TRUNCATED", f"{found} does not inflate: {e}") from e
                packed = inflate.unconsumed_tail if inflate else b""
                total += len(chunk)
                if total > cap:
                    raise SheetError("ZIP_BOMB", f"{found} inflates to more than {cap} bytes", name=found)
                crc = zlib.crc32(chunk, crc)
                if chunk:
                    yield chunk
        if inflate and not inflate.eof:
            raise SheetError("ZIP_TRUNCATED", f"{found} ends early")
        if crc != entry.crc:
            raise SheetError("ZIP_CRC_MISMATCH", f"{found} differs from its checksum", name=found)

    def read(self, name: str) -> bytes:
        """A whole part; only small ones are read like this."""
        out, size = [], 0
        for chunk in self.stream(name):
            size += len(chunk)
            if size > WHOLE_PART:
                raise SheetError("LIMIT_EXCEEDED", f"{name} is larger than {WHOLE_PART} bytes", limit="part")
            out.append(chunk)
        return b"".join(out)


def _fold(name: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in name)


@dataclass
class Packed:
    """Deflated bytes with what a directory needs to know of them."""

    crc: int
    packed: int
    size: int


class PartPacker:
    """Deflates a part in pieces."""

    def __init__(self, write, level: int = 6):
        self.write, self.stored = write, level == 0
        self.coder = None if self.stored else zlib.compressobj(level, zlib.DEFLATED, -15)
        self.made = Packed(0, 0, 0)

    def add(self, data: bytes) -> None:
        self.made.crc = zlib.crc32(data, self.made.crc)
        self.made.size += len(data)
        self._put(data if self.stored else self.coder.compress(data))

    def flush(self, last: bool) -> Packed:
        """Ends a segment: at a byte border, so that others may follow, or for good."""
        if not self.stored:
            self._put(self.coder.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH))
        return self.made

    def _put(self, data: bytes) -> None:
        self.made.packed += len(data)
        if data:
            self.write(data)


def combine_crc(a: int, b: int, length: int) -> int:
    """The checksum of two byte strings, one after the other, from theirs and the second's length.

    Appending zero bits multiplies by powers of x modulo the polynomial; the power comes by squaring.
    """
    def times(p: int, q: int) -> int:
        out = 0
        for bit in range(31, -1, -1):
            if q >> bit & 1:
                out ^= p
            p = p >> 1 ^ (0xEDB88320 if p & 1 else 0)
        return out

    power, base, n = 1 << 31, 1 << 30, 8 * length
    while n:
        if n & 1:
            power = times(base, power)
        base, n = times(base, base), n >> 1
    return times(power, a) ^ b


class ZipOut:
    """Writes entries one after another; sizes follow the data, in ZIP64 form if asked for."""

    def __init__(self, write, zip64: bool = False, stamp: tuple[int, int] = (0, 0x5C21)):
        self.write, self.zip64, self.stamp, self.at, self.done = write, zip64, stamp, 0, []

    def _put(self, data: bytes) -> None:
        self.at += len(data)
        self.write(data)

    def begin(self, name: str, level: int = 6) -> PartPacker:
        raw, self.level = name.encode(), level
        self.done.append([raw, self.at, 0 if level == 0 else 8])
        self._put(struct.pack("<4s5H3I2H", b"PK\x03\x04", 45 if self.zip64 else 20, 0x808, self.done[-1][2], *self.stamp, 0, 0, 0, len(raw), 0) + raw)
        return PartPacker(self._put, level)

    def copy(self, data: bytes) -> None:
        """Bytes that are packed already."""
        self._put(data)

    def end(self, made: Packed) -> None:
        if not self.zip64 and max(made.size, made.packed, self.at) > 0xFFFFFFFE:
            raise SheetError("ENTRY_TOO_LARGE", "an entry of 4 GiB needs ZIP64")
        self._put(struct.pack("<4sI2Q" if self.zip64 else "<4s3I", b"PK\x07\x08", made.crc, made.packed, made.size))
        self.done[-1].append(made)

    def whole(self, name: str, data: bytes, level: int = 6) -> None:
        part = self.begin(name, level)
        part.add(data)
        self.end(part.flush(True))

    def close(self) -> int:
        start, full = self.at, 0xFFFFFFFF
        for raw, place, method, made in self.done:
            extra = struct.pack("<2H3Q", 1, 24, made.size, made.packed, place) if self.zip64 else b""
            sizes = (full, full) if self.zip64 else (made.packed, made.size)
            self._put(struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45 if self.zip64 else 20, 0x808, method, *self.stamp, made.crc, *sizes, len(raw),
                len(extra), 0, 0, 0, 0, full if self.zip64 else place) + raw + extra)
        size, n = self.at - start, len(self.done)
        if self.zip64:
            at = self.at
            self._put(struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<4sIQI", b"PK\x06\x07", 0, at, 1))
        self._put(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, *((0xFFFF, 0xFFFF, full, full) if self.zip64 else (n, n, size, start)), 0))
        return self.at
