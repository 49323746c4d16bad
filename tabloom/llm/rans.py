"""Static range asymmetric numeral system over token ids, and its shard file format.

One frequency table, quantised to 2**18 and shared by all shards, drives the coder; it has a file
of its own beside them, and every shard holds its checksum.  Ids are cut into blocks; a block has LANES interleaved states that are independent of each other and of
every other block, so any block can be decoded alone.  Many blocks are coded at once with numpy.

A shard file: the magic; the blocks; a footer (JSON, zlib); its length and crc32 (8 bytes); the
magic again.  The footer lists documents (names and token counts) and blocks: offset, bytes, ids, crc32,
the document and the place in it where the block begins (the checkpoint for parallel decoding).
The table's file: its magic, the crc32 of the frequencies, and those (u32, zlib).  A block: LANES final states (u64), LANES word counts (u32), then each lane's 32-bit words.
"""

from __future__ import annotations

import bisect
import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"RANSTOK2"
TABLE_MAGIC = b"RANSTAB1"
SCALE_BITS = 18
LANES = 32
BLOCK = 1 << 15
LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_MASK32 = np.uint64(0xFFFFFFFF)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE_BITS, at least 1 for every id, in proportion to the counts."""
    counts = np.asarray(counts, np.float64)
    total = 1 << SCALE_BITS
    if len(counts) >= total:
        raise ValueError("too many ids for the table")
    spare = total - len(counts)
    share = counts / counts.sum() * spare if counts.sum() else np.full(len(counts), spare / len(counts))
    whole = np.floor(share).astype(np.int64)
    left = spare - int(whole.sum())
    whole[np.argsort(-(share - whole), kind="stable")[:left]] += 1
    return (whole + 1).astype(np.uint32)


class Table:
    """What encoder and decoder derive from the frequencies."""

    def __init__(self, freq: np.ndarray):
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq, dtype=np.uint64)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.uint32), freq)


def table_bytes(freq: np.ndarray) -> bytes:
    raw = freq.astype("<u4").tobytes()
    return TABLE_MAGIC + struct.pack("<I", zlib.crc32(raw)) + zlib.compress(raw)


def read_table(data: bytes) -> Table:
    if data[:8] != TABLE_MAGIC:
        raise ValueError("not a frequency table")
    try:
        raw = zlib.decompress(data[12:])
    except zlib.error as e:
        raise ValueError("the frequency table is damaged") from e
    if zlib.crc32(raw) != struct.unpack_from("<I", data, 8)[0]:
        raise ValueError("the frequency table is damaged")
    return Table(np.frombuffer(raw, "<u4"))


def _steps(ids: np.ndarray, blocks: int) -> np.ndarray:
    """(step, block, lane) view of padded ids."""
    return ids.reshape(blocks, -1, LANES).transpose(1, 0, 2)


def encode_blocks(ids: np.ndarray, table: Table) -> list[bytes]:
    """The payloads of the blocks of ``ids``, in order.  Id i of a block goes to lane i mod LANES."""
    out: list[bytes] = []
    for at in range(0, len(ids), BLOCK * 128):
        part = ids[at : at + BLOCK * 128]
        blocks = -(-len(part) // BLOCK)
        sizes = np.full(blocks, BLOCK)
        sizes[-1] = len(part) - BLOCK * (blocks - 1)
        width = BLOCK if blocks > 1 else -(-len(part) // LANES) * LANES
        padded = np.zeros(blocks * width, np.uint32)
        padded[: len(part)] = part
        steps = _steps(padded, blocks)
        states = np.full((blocks, LANES), LOW, np.uint64)
        words = np.zeros((steps.shape[0], blocks, LANES), np.uint32)
        used = np.zeros((steps.shape[0], blocks, LANES), bool)
        lane = np.arange(LANES)[None, :]
        full = sizes // LANES
        over = sizes % LANES
        for k in range(steps.shape[0] - 1, -1, -1):
            s = steps[k]
            f = table.freq[s]
            live = None
            if k >= full.min():
                live = (k < full)[:, None] | ((k == full)[:, None] & (lane < over[:, None]))
            spill = states >= (f << np.uint64(63 - SCALE_BITS))
            if live is not None:
                spill &= live
            words[k] = (states & _MASK32).astype(np.uint32)
            used[k] = spill
            x = np.where(spill, states >> _32, states)
            q = x // f
            x = (q << np.uint64(SCALE_BITS)) + (x - q * f) + table.start[s]
            states = x if live is None else np.where(live, x, states)
        for b in range(blocks):
            counts = used[:, b, :].sum(axis=0).astype("<u4")
            # The decoder reads words in the order of its steps, which is that of k.
            lanes = [words[:, b, j][used[:, b, j]] for j in range(LANES)]
            out.append(states[b].astype("<u8").tobytes() + counts.tobytes() + np.concatenate(lanes).astype("<u4").tobytes())
    return out


def decode_blocks(payloads: list[bytes], sizes: list[int], table: Table) -> list[np.ndarray]:
    """The ids of blocks, many at once."""
    out: list[np.ndarray] = []
    for at in range(0, len(payloads), 128):
        group, lengths = payloads[at : at + 128], np.array(sizes[at : at + 128])
        blocks = len(group)
        states = np.stack([np.frombuffer(p, "<u8", LANES) for p in group]).astype(np.uint64)
        counts = np.stack([np.frombuffer(p, "<u4", LANES, 8 * LANES) for p in group]).astype(np.int64)
        stream = np.concatenate([np.frombuffer(p, "<u4", -1, 12 * LANES) for p in group] + [np.zeros(1, np.uint32)]).astype(np.uint64)
        place = np.concatenate([[0], np.cumsum(counts.ravel())[:-1]]).reshape(blocks, LANES)
        depth = int(-(-lengths.max() // LANES))
        ids = np.zeros((depth, blocks, LANES), np.uint32)
        full, over, lane = lengths // LANES, lengths % LANES, np.arange(LANES)[None, :]
        mask = np.uint64((1 << SCALE_BITS) - 1)
        for k in range(depth):
            slot = states & mask
            s = table.symbol[slot]
            ids[k] = s
            x = table.freq[s] * (states >> np.uint64(SCALE_BITS)) + slot - table.start[s]
            need = x < LOW
            live = None
            if k >= full.min():
                live = (k < full)[:, None] | ((k == full)[:, None] & (lane < over[:, None]))
                need &= live
            x = np.where(need, (x << _32) | stream[np.where(need, place, 0)], x)
            place += need
            states = x if live is None else np.where(live, x, states)
        if (states != LOW).any():
            raise ValueError("a block does not decode to its beginning")
        flat = ids.transpose(1, 0, 2).reshape(blocks, -1)
        out += [flat[b, :n] for b, n in enumerate(lengths)]
    return out


def shard_bytes(lengths: list[int], ids: np.ndarray, table: Table, names: list[int | None] | None = None):
    """The chunks of a shard file: ``lengths`` ids for each document, one after another in ``ids``; ``names``
    are the documents' ids, their places in the shard unless told."""
    yield MAGIC
    at, index, ends, done = len(MAGIC), [], np.cumsum(lengths) if len(lengths) else np.zeros(0, np.int64), 0
    for payload in encode_blocks(ids, table):
        n = min(BLOCK, len(ids) - done)
        doc = int(np.searchsorted(ends, done, side="right"))
        into = done - (int(ends[doc - 1]) if doc else 0)
        index.append([at, len(payload), n, zlib.crc32(payload), doc, into])
        at, done = at + len(payload), done + n
        yield payload
    footer = zlib.compress(json.dumps({"lanes": LANES, "block": BLOCK, "scale_bits": SCALE_BITS, "table": table.crc,
        "names": [*range(len(lengths))] if names is None else names, "documents": [int(x) for x in lengths], "blocks": index}).encode())
    yield footer + struct.pack("<II", len(footer), zlib.crc32(footer)) + MAGIC


def read_footer(source: io.RawIOBase) -> dict:
    source.seek(0, 2)
    size = source.tell()
    source.seek(size - 16)
    length, crc, magic = struct.unpack("<II8s", source.read(16))
    if magic != MAGIC:
        raise ValueError("not a token shard")
    source.seek(size - 16 - length)
    footer = source.read(length)
    if zlib.crc32(footer) != crc:
        raise ValueError("the footer is damaged")
    return json.loads(zlib.decompress(footer))


def read_blocks(source: io.RawIOBase, footer: dict, table: Table, first: int = 0, last: int | None = None) -> list[np.ndarray]:
    """The ids of blocks first..last, by range reads; each block's checksum is verified."""
    wanted = footer["blocks"][first:last]
    payloads = []
    for at, length, _, crc, _, _ in wanted:
        source.seek(at)
        payload = source.read(length)
        if zlib.crc32(payload) != crc:
            raise ValueError("a block is damaged")
        payloads.append(payload)
    return decode_blocks(payloads, [b[2] for b in wanted], table)


def read_documents(source: io.RawIOBase, table: Table, first: int = 0, last: int | None = None, step: int = 64) -> Iterator[tuple[int | None, np.ndarray]]:
    """(name, ids) of the shard's documents first..last, decoded from the checkpoint before the first of them."""
    footer = read_footer(source)
    if footer["table"] != table.crc:
        raise ValueError("the shard was written with another frequency table")
    lengths, blocks = footer["documents"], footer["blocks"]
    if not blocks:
        yield from ((name, np.empty(0, np.uint32)) for name in footer["names"][first:last])
        return
    at = max(0, bisect.bisect_right([(b[4], b[5]) for b in blocks], (first, 0)) - 1)
    doc, into = blocks[at][4:]
    skip = lengths[doc] - into + sum(lengths[doc + 1 : first]) if doc < first else 0
    held: np.ndarray = np.empty(0, np.uint32)
    for name, n in zip(footer["names"][first:last], lengths[first:last]):
        parts, have = [held], len(held)
        while have < skip + n:
            got = read_blocks(source, footer, table, at, at + step)
            at += step
            parts += got
            have += sum(map(len, got))
        held = parts[0] if len(parts) == 1 else np.concatenate(parts)
        yield name, held[skip : skip + n]
        held, skip = held[skip + n :], 0
