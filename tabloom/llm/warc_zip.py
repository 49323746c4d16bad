"""WARC records in ZIP-packaged archives, written by range of page id and read without extraction.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz``, a gzip member for each
record, and ``indexes/index.cdxj``, a CDXJ line for each record (sort key of the URL, time, JSON with the
record's file, offset and length), in the order of the lines.  The reader parses the end record, the
ZIP64 records where sizes ask for them, and the central directory; it takes every index and every
WARC member that it finds there and reads each record by its byte range.  Index lines may also be
bare JSON; indexes may be gzipped.

Html is shuffled once, by range of page id.  Which digests come more than once is found on narrow rows;
a tag for each page that revisits another goes along in that shuffle and stands before its page.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import arrow_filesystem, cut, discard, join_hot, put_file, shared_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LEAST_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
ARCHIVE_ROWS = 50_000
PARTITION_BYTES = 256 << 20
PARTITION_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"
_INDEXES = re.compile(r"indexes/.*\.(?:cdxj?|cdxj?\.gz)")
_WARCS = re.compile(r"archive/.*\.warc(?:\.gz)?")
_U32, _U16 = 0xFFFFFFFF, 0xFFFF


class ArchiveError(ValueError):
    """The bytes are not a ZIP archive that can be read by range."""


def _member(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _clean(value: str | None) -> str:
    """A header value on one line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of ``refers_to``; a revisit's block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_member(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_member(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def sort_key(url: str) -> str:
    """The URL with its host's labels turned round, lower-cased, as CDXJ lines begin with it."""
    try:
        parts = urlsplit(url.lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        parts, host, port = None, "", None
    if not host:
        return url.lower().replace(" ", "%20") or "-"
    labels = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{labels}{f':{port}' if port else ''}){parts.path or '/'}{f'?{parts.query}' if parts.query else ''}".replace(" ", "%20")


def index_line(url: str, digest: str, revisit: bool, offset: int, length: int) -> str:
    """The CDXJ line of a record."""
    url = _clean(url)
    entry = {"url": url, "mime": "warc/revisit" if revisit else "text/html", "status": "200", "digest": f"sha256:{digest}", "length": str(length),
        "offset": str(offset), "filename": DATA.rpartition("/")[2]}
    return f"{sort_key(url)} {re.sub(r'[^0-9]', '', DATE)} {json.dumps(entry)}"


def parse_headers(data: bytes) -> dict:
    """The headers of a record."""
    head = data[: data.index(b"\r\n\r\n")] if b"\r\n\r\n" in data else data
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ArchiveError("not a WARC record")
    return {k: v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if ":" in line)}


def parse_record(data: bytes) -> dict:
    """Headers, and the payload of a response, of one record."""
    headers = parse_headers(data)
    rest = data[data.index(b"\r\n\r\n") + 4 :]
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    headers["http"] = dict(line.split(": ", 1) for line in http.decode("latin-1").split("\r\n")[1:] if ": " in line)
    headers["payload"] = payload
    return headers


def _local(name: str, zip64: bool) -> bytes:
    raw = name.encode()
    return struct.pack("<4s5H3L2H", b"PK\x03\x04", 45 if zip64 else 20, 0x0808, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw


def archive_bytes(records: Iterator[tuple[int | None, bytes]], zip64: bool = True) -> Iterator[bytes]:
    """The chunks of an archive; sizes follow the members, so nothing is held but the index."""
    index, members, at = [], [], 0

    def begin(name: str) -> Iterator[bytes]:
        nonlocal at
        members.append([name, at, 0, 0])
        header = _local(name, zip64)
        at += len(header)
        yield header

    def body(chunk: bytes) -> bytes:
        nonlocal at
        members[-1][2] += len(chunk)
        members[-1][3] = zlib.crc32(chunk, members[-1][3])
        at += len(chunk)
        return chunk

    def end() -> Iterator[bytes]:
        nonlocal at
        _, _, size, crc = members[-1]
        tail = struct.pack("<4sL2Q" if zip64 else "<4s3L", b"PK\x07\x08", crc, size, size)
        at += len(tail)
        yield tail

    yield from begin(DATA)
    for _, record in records:
        packed = gzip.compress(record, 6, mtime=0)
        headers = parse_headers(record)
        index.append(index_line(headers["WARC-Target-URI"], headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"] == "revisit",
            members[-1][2], len(packed)))
        yield body(packed)
    yield from end()
    yield from begin(INDEX)
    yield body("".join(f"{line}\n" for line in sorted(index)).encode())
    yield from end()
    start = at
    for name, place, size, crc in members:
        raw = name.encode()
        extra = struct.pack("<2H3Q", 1, 24, size, size, place) if zip64 else b""
        sizes = (_U32, _U32) if zip64 else (size, size)
        entry = struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45 if zip64 else 20, 0x0808, 0, 0, 0x21, crc, *sizes, len(raw), len(extra), 0, 0, 0, 0,
            _U32 if zip64 else place) + raw + extra
        at += len(entry)
        yield entry
    if zip64:
        yield struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, len(members), len(members), at - start, start)
        yield struct.pack("<4sLQL", b"PK\x06\x07", 0, at, 1)
        yield struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, _U16, _U16, _U32, _U32, 0)
    else:
        yield struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, len(members), len(members), at - start, start, 0)


class Archive:
    """A ZIP archive on a seekable file, of which only byte ranges are read."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        self.size = source.tell()
        self.members = dict(self._directory())

    def span(self, at: int, length: int) -> bytes:
        if at < 0 or length < 0 or at + length > self.size:
            raise ArchiveError("a range lies outside the archive")
        self.source.seek(at)
        return self.source.read(length)

    def _directory(self) -> Iterator[tuple[str, tuple[int, int, int, int]]]:
        tail_at = max(0, self.size - 22 - _U16)
        tail = self.span(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] > len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ArchiveError("no end record")
        count, size, start = struct.unpack_from("<H2L", tail, end + 10)
        locator = tail_at + end - 20
        if (count == _U16 or size == _U32 or start == _U32) and locator >= 0:
            mark, _, place, _ = struct.unpack("<4sLQL", self.span(locator, 20))
            if mark == b"PK\x06\x07":
                record = self.span(place, 56)
                if record[:4] != b"PK\x06\x06":
                    raise ArchiveError("no ZIP64 end record")
                count, size, start = struct.unpack_from("<3Q", record, 32)
        listing, at = self.span(start, size), 0
        for _ in range(count):
            if listing[at : at + 4] != b"PK\x01\x02" or at + 46 > len(listing):
                raise ArchiveError("the directory is damaged")
            flags, method = struct.unpack_from("<2H", listing, at + 8)
            crc, packed, plain, n, m, k = struct.unpack_from("<3L3H", listing, at + 16)
            place = struct.unpack_from("<L", listing, at + 42)[0]
            name = listing[at + 46 : at + 46 + n].decode("utf-8", "replace")
            extra = listing[at + 46 + n : at + 46 + n + m]
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<2H", extra)
                if kind == 1:
                    values = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                    plain = next(values) if plain == _U32 else plain
                    packed = next(values) if packed == _U32 else packed
                    place = next(values) if place == _U32 else place
                extra = extra[4 + length :]
            at += 46 + n + m + k
            yield name, (method if not flags & 1 else -1, place, packed, crc)

    def stored(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member begin, and how many they are."""
        if name not in self.members:
            raise ArchiveError(f"no member {name}")
        method, place, size, _ = self.members[name]
        if method != 0:
            raise ArchiveError(f"{name} is not stored")
        header = self.span(place, 30)
        if header[:4] != b"PK\x03\x04":
            raise ArchiveError(f"no local header of {name}")
        n, m = struct.unpack_from("<2H", header, 26)
        return place + 30 + n + m, size

    def _index(self, name: str) -> Iterator[dict]:
        begin, size = self.stored(name)
        lines = self.span(begin, size)
        if zlib.crc32(lines) != self.members[name][3]:
            raise ArchiveError("the index is damaged")
        if lines[:2] == b"\x1f\x8b":
            lines = gzip.decompress(lines)
        for line in lines.decode().split("\n"):
            if "{" in line and not line.startswith("!"):
                yield json.loads(line[line.index("{") :])

    def records(self) -> Iterator[dict]:
        """Every record that the indexes list, each by its own range, in the order of the archive."""
        indexes = [n for n in self.members if _INDEXES.fullmatch(n)]
        warcs = {n.rpartition("/")[2]: self.stored(n) for n in self.members if _WARCS.fullmatch(n)}
        if not indexes or not warcs:
            raise ArchiveError("no index" if warcs else "no WARC member")
        found = []
        for entry in (e for n in indexes for e in self._index(n)):
            name = entry.get("filename") or DATA.rpartition("/")[2]
            name = name.rpartition("/")[2]
            if name not in warcs:
                raise ArchiveError(f"the index names {name}, which isn't there")
            found.append((name, int(entry["offset"]), int(entry["length"])))
        for name, offset, length in sorted(found):
            begin, size = warcs[name]
            if offset + length > size:
                raise ArchiveError("the index points outside its member")
            data = self.span(begin + offset, length)
            yield parse_record(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)


_MADE = pa.schema([("part", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def _write_task(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages come by id; a tag with the page that is revisited comes before the pages of its id and digest."""
        part, number, tag = TaskContext.get().partitionId(), 0, None

        def pages() -> Iterator[tuple[int | None, bytes, int]]:
            nonlocal tag
            for batch in batches:
                ids, digests, first = (batch.column(c).to_pylist() for c in ("page_id", "digest", "refers_to"))
                kinds = batch.column("kind").to_pylist()
                for k, (page_id, digest) in enumerate(zip(ids, digests)):
                    if kinds[k] == 0:
                        tag = page_id, digest, first[k]
                        continue
                    html = batch.column("html")[k].as_py()
                    payload = html.encode("utf-8", "surrogatepass") if html else b""
                    refers = tag[2] if tag is not None and tag[:2] == (page_id, digest) else None
                    yield page_id, warc_record(page_id, batch.column("url")[k].as_py(), payload, digest, refers), len(payload)

        source = pages()
        following = next(source, None)
        while following is not None:
            count = held = 0

            def archive() -> Iterator[tuple[int | None, bytes]]:
                nonlocal following, count, held
                while following is not None and held < ARCHIVE_BYTES and count < ARCHIVE_ROWS:
                    page_id, record, size = following
                    count, held = count + 1, held + size
                    yield page_id, record
                    following = next(source, None)

            file = f"pages-{part:06d}-{number:04d}.wacz"
            size = put_file(f"{folder}/{file}", archive_bytes(archive()))
            yield pa.RecordBatch.from_pylist([{"part": part, "file": file, "records": count, "bytes": size}], _MADE)
            number += 1

    return write


def _page(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else int(value)


def read_archive(uri: str) -> Iterator[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive's records."""
    store, path = arrow_filesystem(uri)
    with store.open_input_file(path) as source:
        for r in Archive(source).records():
            kind, digest = r["WARC-Type"], r["WARC-Payload-Digest"].removeprefix("sha256:")
            if kind == "response" and hashlib.sha256(r["payload"]).hexdigest() != digest:
                raise ArchiveError("a payload differs from its digest")
            yield _page(r["WARC-Record-ID"]), int(r["http"]["Content-Length"]), digest, kind, _page(r["WARC-Refers-To"]) if kind == "revisit" else None


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read_task(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in (f for b in batches for f in b.column(0).to_pylist()):
            rows = [*read_archive(f"{folder}/{file}")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)

    return read


def write_archives(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write ``pages`` (page_id, url, html); returns the folder and (part, file, records, bytes) per archive.

    Of records with equal payloads of at least LEAST_REVISIT bytes, that with the smallest page_id
    is a response and the others revisit it; if rows share that page_id, they are all responses.
    Smaller payloads are responses.  A null html is an empty payload, a null url an empty one; a null
    page_id stands after all others of its payload.  Other columns aren't looked at.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/archives"
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    narrow = cut(d.select("page_id", "digest", F.octet_length("html").cast("long").alias("size")), "digests")
    total = narrow.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    # Only digests that are there twice are joined, on narrow rows; small payloads never are.
    large = narrow.where(F.col("size") >= LEAST_REVISIT)
    again = cut(large.groupBy("digest").agg(F.count("*").alias("c"), F.min("page_id").alias("first")).where("c > 1 and first is not null"), "again")
    tags = join_hot(large.select("page_id", "digest"), again, "digest", "c").where("not (page_id <=> first)").select("page_id", "digest", "first").distinct()
    none = F.lit(None).cast("string")
    tags = tags.select("page_id", "digest", F.lit(0).alias("kind"), F.col("first").alias("refers_to"), none.alias("url"), none.alias("html"))
    rows = d.select("page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "html")
    parts = max(spark.sparkContext.defaultParallelism, (total["b"] or 0) // PARTITION_BYTES + 1, total["n"] // PARTITION_ROWS + 1)
    by = [F.col("page_id").asc_nulls_first(), F.col("digest")]  # a tag and its pages have one key, so one partition
    placed = rows.unionByName(tags).repartitionByRange(int(parts), *by).sortWithinPartitions(*by, "kind")
    manifest = cut(placed.mapInArrow(_write_task(folder), "part int, file string, records long, bytes long"), "manifest")
    discard(narrow, again)
    return folder, manifest


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) read back from archives of ``pages``."""
    folder, manifest = write_archives(pages)
    spread = manifest.select("file").repartition(max(1, min(10_000, manifest.count())), "file")
    return spread.mapInArrow(_read_task(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
