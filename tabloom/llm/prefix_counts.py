"""Token counts by prefix dynamic programming.

For a byte-level BPE, the encoding of a prefix of a pre-token is the encoding of a shorter prefix
plus one last token, and two neighbouring tokens may stand side by side if and only if their joint
bytes encode to just those two.  So for every prefix the programme looks, shortest first, for a
vocabulary token that ends there and may follow the last token of the prefix before it:
count[i] = count[i - len(token)] + 1.  Each pre-token is scanned once and every prefix of it is
answered.

A document's table is the string of count differences from one code point to the next, one signed
byte each (a difference that doesn't fit one is an OverflowError; the longest tokens of public
vocabularies are far too short for that), so that budgets and truncations are sums over it.  Chunks
between single spaces repeat a lot; their tables are kept in a memo bounded by bytes.

The tables are written to the shared folder once; every question about counts, budgets and
truncation is answered from them, without the texts.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .bpe_ids import byte_alphabet, chunkwise, grouped
from .common import TwoGenerations, cut

MEMO_CHUNKS = 192 << 20
MEMO_PIECES = 64 << 20
MEMO_PAIRS = 600_000  # pairs of tokens, which are short
_CONTRACTED = {"'re", "'ve", "'ll"}


class PrefixCounter:
    """Count tables of one byte-level BPE tokenizer file."""

    def __init__(self, path: str, pattern: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model, first = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("the prefix programme is for byte-level BPE files without a normalizer")
        back = {c: b for b, c in byte_alphabet().items()}
        raw = lambda token: bytes(back[c] for c in token)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.tokens = {raw(t) for t in model["vocab"] if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        self.made = {bytes([k]): (-1, b"", b"") for k in range(256)}
        for (a, b), k in self.ranks.items():
            self.made.setdefault(a + b, (k, a, b))
        # 0: only the end of some token; 2: a token that its own bytes encode to; 1: another token.
        self.endings = {t[k:]: 0 for t in self.tokens for k in range(1, len(t))}
        self.endings.update((t, 2 if self.bpe(t) == [t] else 1) for t in self.tokens)
        self.special = sorted(special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if special else None
        self.split = regex.compile(pattern).findall
        self.unit = regex.compile(r"(?:\s*[^\S ])?(?:'s|'t|'re|'ve|'m|'ll|'d)|\s*(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+").findall
        self.space = regex.compile(r"\s*").match
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.pieces = TwoGenerations(self._piece, MEMO_PIECES)
        self.chunks = TwoGenerations(self._chunk, MEMO_CHUNKS)

    def bpe(self, word: bytes) -> list[bytes]:
        """Merges by rank, straight from the definition."""
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 1:
            rank, k = min((self.ranks.get((a, b), len(self.ranks)), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def may_follow(self, a: bytes, b: bytes) -> bool:
        """Whether the tokens stay apart when their joint bytes are encoded.

        Goes back in time from the end: the tokens at the border are undone, the later-made one
        first.  Had the two at the border a merge of their own before the moment at which one of
        them went into the next, that merge would have been made instead.  Merges of one rank are
        made from left to right.
        """
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        x, y, until, made, joins = a, b, len(self.ranks), self.made, self.ranks
        while True:
            rank = joins.get((x, y))
            if rank is not None and rank < until:
                known = False
                break
            x_rank, y_rank = made[x][0], made[y][0]
            if x_rank > y_rank:
                until, x = x_rank, made[x][2]
            elif y_rank >= 0:
                until, y = y_rank + 1, made[y][1]
            else:
                known = True
                break
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = known
        return known

    def byte_counts(self, word: bytes) -> list[int]:
        """Tokens of each prefix of a pre-token; entry 0 is that of the empty prefix."""
        counts, last, endings, follows, pairs = [0], [b""], self.endings, self.may_follow, self.pairs
        for end in range(1, len(word) + 1):
            for begin in range(end - 1, -1, -1):
                token = word[begin:end]
                kind = endings.get(token)
                if kind is None:  # no token ends with these bytes, nor with more
                    raise ValueError("the vocabulary lacks a byte")
                if not kind:
                    continue
                before = last[begin]
                if before:
                    fits = pairs.get((before, token))
                    if fits is None:
                        fits = follows(before, token)
                else:
                    fits = kind == 2
                if fits:
                    counts.append(counts[begin] + 1)
                    last.append(token)
                    break
        return counts

    def char_counts(self, piece: str) -> list[int]:
        """Tokens of each code-point prefix of a pre-token, from the first character on."""
        if piece in _CONTRACTED:  # cut short, these are a mark and a letter
            return [1, 2, self.byte_counts(piece.encode())[-1]]
        counts = self.byte_counts(piece.encode("utf-8"))
        if piece.isascii():
            return counts[1:]
        ends = np.cumsum([len(c.encode("utf-8")) for c in piece])
        return [counts[e] for e in ends]

    @staticmethod
    def _steps(counts: list[int]) -> bytes:
        return array("b", [b - a for a, b in zip([0, *counts], counts)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._steps(self.char_counts(piece))

    def _chunk(self, chunk: str) -> bytes:
        """A chunk with the space before it, where neither side of that space is white space."""
        if chunk.isalpha():
            return self._piece(" " + chunk)
        stem = chunk[:-1]
        if stem.isalpha() and chunk[-1] in ".,!?;:":
            return (self.chunks.known(stem) or self._piece(" " + stem)) + self.pieces[chunk[-1]]
        return self._general(" " + chunk)

    def _unit(self, unit: str) -> bytes:
        """White space and what follows it: the run loses its last character to what follows."""
        run = self.space(unit).group()
        body = unit[len(run) :]
        if len(run) < 2 and (not run or run == " " and body):
            return self.pieces[unit]
        alone = self.char_counts(run)
        if not body:
            return self._steps(alone)
        base = alone[-2] if len(run) > 1 else 0
        if run[-1] == " ":
            tail = [base + c for c in self.char_counts(" " + body)][1:]
        else:
            tail = [base + self.char_counts(run[-1])[0] + c for c in self.char_counts(body)]
        return self._steps(alone + tail)

    def _general(self, text: str) -> bytes:
        return b"".join([self._unit(u) for u in self.unit(text)])

    def _plain(self, text: str) -> bytes:
        """A text without special strings."""
        if not text:
            return b""
        if len(text.split()) != text.count(" ") + text.count("\n") + 1:
            return self._general(text)
        first, space, rest = text.partition(" ")
        head = self._general(first)
        return head + b"".join(map(self.chunks.__getitem__, rest.split(" "))) if space else head

    def forget(self) -> None:
        """At a task's end: what the memos and array operations hold."""
        self.chunks.forget()
        self.pieces.forget()
        pa.default_memory_pool().release_unused()

    def tables(self, texts: pa.Array) -> pa.Array:
        """``table`` of many texts."""
        return chunkwise(texts, self.special, self._general, self.chunks, self.table)

    def table(self, text: str | None) -> bytes:
        """The count differences of all prefixes of the text, one signed byte a code point."""
        if not text:
            return b""
        if not self.cut or not any(s in text for s in self.special):
            return self._plain(text)
        out, before = [], ""
        for k, part in enumerate(self.cut(text)):
            if k % 2 == 0:
                out.append(self._plain(part))
                before = part
                continue
            # Within a special string a prefix is ordinary text; at its end it is one token.
            whole = count_at(self._general(before))
            counts = np.cumsum(np.frombuffer(self._general(before + part[:-1]), np.int8).astype(np.int64))[len(before) :] - whole
            out.append(self._steps([*counts.tolist(), 1]))
        return b"".join(out)


@functools.cache
def counter(path: str, pattern: str) -> PrefixCounter:
    return PrefixCounter(path, pattern)


def count_at(table: bytes, chars: int | None = None) -> int:
    """Tokens of the prefix of ``chars`` code points (None: of the whole text)."""
    return int(np.frombuffer(table, np.int8)[:chars].sum(dtype=np.int64))


def longest_within(table: bytes, budget: int) -> int:
    """The longest prefix, in code points, that takes at most ``budget`` tokens."""
    counts = np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def _table_task(path: str, pattern: str):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        programme = counter(path, pattern)
        for batch in grouped(batches):
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, programme.tables(texts)], ["doc_id", "n_bytes", "prefix_steps"])
        programme.forget()

    return build


def prefix_tables(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_bytes, prefix_steps) per row of ``docs``: the count differences of all prefixes, a byte a
    code point."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_table_task(path, pattern), "doc_id long, n_bytes long, prefix_steps binary")


def _answer_task(limit: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [t.as_py() for t in batch.column("prefix_steps")]
            counts, chars = pa.array([count_at(t) for t in tables], pa.int64()), pa.array([longest_within(t, limit) for t in tables], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts, chars], [*batch.schema.names, "n_tokens", "limit_chars"])

    return answer


def prefix_token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512, keep_table: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, limit_chars[, prefix_steps]) per row of ``docs``, answered from
    the stored tables.

    ``limit_chars`` is the longest prefix, in code points, of at most ``limit`` tokens.  A null or
    empty text has 0 of everything.  Every row gives a row, also if doc_id is null or repeated; other
    columns aren't looked at.  Special strings in a text count as one token, as in the library.
    """
    stored = cut(prefix_tables(docs, path, pattern), "prefixes")
    out = stored.mapInArrow(_answer_task(limit), "doc_id long, n_bytes long, prefix_steps binary, n_tokens long, limit_chars long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "limit_chars", *["prefix_steps"] * keep_table)
