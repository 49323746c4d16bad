"""Whole-text encoding with the tokenizers library, memoised by space-delimited chunk.

A byte-level BPE never merges across pre-tokens, and a single space between two other
characters always begins a pre-token.  Texts whose white space is single spaces and line ends
are therefore cut at their spaces, and each chunk's ids come from a bounded memo or else from the
library's BPE model; any other text goes to the library whole.  The ids are the library's own
either way (tests compare them with it).

Texts are cut many at a time: a group's distinct chunks are found by array operations, each is looked up
once, and its bytes are dealt out to where it stands.  The encoder cuts texts at line ends, too, and marks off the
ends of chunks; words that no memo holds are called for in one go.
"""

from __future__ import annotations

import functools
import json
import os
import sys
from array import array
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import TwoGenerations

MEMO_CHUNKS = 192 << 20
MEMO_PIECES = 64 << 20
GROUP_BYTES = 4 << 20
LONG_BYTES = 64 << 20
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_NOT_PLAIN = rf"[{_SPACES}]|[ \n][ \n]|\A[ \n]|[ \n]\z|\A\z"
#: Marks that are cut off the ends of chunks (contractions begin with an apostrophe), and letters and digits
#: behind which a run of them is a pre-token of its own.
_MARKS, _BEFORE_MARKS = '.,!?;:#$%&*"()-', r"[A-Za-z0-9À-ÖØ-öø-ž]\z"
_CALLS = 1_000


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to about GROUP_BYTES."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GROUP_BYTES:
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held, size = [], 0
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def apart(texts: pa.Array, special: Sequence[str], plain: Callable[[pa.Array], pa.Array], other: Callable[[str], bytes]) -> pa.Array:
    """For each text the bytes that ``plain`` gives for many of them.  Null texts are empty.  Texts with other white
    space than single spaces and line ends, or with a special string, and very long ones, are ``other``'s, one by one.
    """
    texts = texts.cast(pa.string()).fill_null("")
    odd = pc.or_(pc.match_substring_regex(texts, _NOT_PLAIN), pc.greater(pc.binary_length(texts), LONG_BYTES))
    for s in special:
        odd = pc.or_(odd, pc.match_substring(texts, s))
    odd = odd.to_numpy(zero_copy_only=False)
    done = plain(texts.filter(pa.array(~odd)))
    if not odd.any():
        return done
    rest = pa.array([other(t.as_py()) for t in texts.filter(pa.array(odd))], pa.binary())
    place = np.where(odd, len(done) + np.cumsum(odd) - 1, np.cumsum(~odd) - 1)
    return pa.concat_arrays([done, rest]).take(pa.array(place))


def dealt(values: pa.Array, at: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The values at the places ``at`` joined to one for each stretch between ``offsets``."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), values.take(pa.array(at))), b"")


def chunkwise(texts: pa.Array, special: Sequence[str], first: Callable[[str], bytes], chunks: Mapping[str, bytes], other: Callable[[str], bytes]) -> pa.Array:
    """For each text the bytes of its first chunk and those of all others, which stand behind a space each;
    or ``other``'s (see ``apart``)."""
    def plain(texts: pa.Array) -> pa.Array:
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy()
        words = lists.flatten().dictionary_encode()
        at = words.indices.to_numpy().astype(np.int64)
        begins = offsets[:-1] - offsets[0]
        later = np.ones(len(at), bool)
        later[begins] = False
        used = np.bincount(at[later], minlength=len(words.dictionary)) > 0
        names = words.dictionary.to_pylist()
        values = [chunks[w] if u else b"" for w, u in zip(names, used.tolist())]
        heads, which = np.unique(at[begins], return_inverse=True)
        at[begins] = len(values) + which
        values += [first(names[k]) for k in heads.tolist()]
        return dealt(pa.array(values, pa.binary()), at, offsets)

    return apart(texts, special, plain, other)


def strings(data: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Bytes, one after another, as an array of strings of these sizes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def without_marks(chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Chunks without the marks behind their last letter or digit, and those marks; other chunks stay whole."""
    stems = pc.ascii_rtrim(chunks, _MARKS)
    stems = pc.if_else(pc.match_substring_regex(stems, _BEFORE_MARKS), stems, chunks)
    sizes = pc.subtract(pc.binary_length(chunks), pc.binary_length(stems)).to_numpy().astype(np.int64)
    ends = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset + 1 : chunks.offset + len(chunks) + 1]
    places = np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
    return stems, strings(np.frombuffer(chunks.buffers()[2], np.uint8)[places], sizes, pa.string())


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    return out | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in out)}


class ChunkEncoder:
    """Encodes texts of one byte-level BPE tokenizer file to little-endian ids (16 bit, if they fit)."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        spec = json.loads(open(path, encoding="utf-8").read())
        first = spec.get("pre_tokenizer") or {}
        self.plain = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex",
            True) and not spec.get("normalizer") and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 0x10000 else "<u4")
        self.split = regex.compile(pattern).findall
        alphabet = byte_alphabet()
        self.table, self.space = str.maketrans({chr(b): c for b, c in alphabet.items()}), alphabet[0x20]
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.pieces = TwoGenerations(self._piece, MEMO_PIECES)
        self.chunks = TwoGenerations(self._chunk, MEMO_CHUNKS)
        self.lines, self.line_end = alphabet[0x0A], self._piece("\n")
        self._forget_words()

    def _pack(self, ids) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder != "little":
            out.byteswap()
        return out.tobytes()

    def _piece(self, piece: str) -> bytes:
        mapped = piece.encode("utf-8").decode("latin-1").translate(self.table)
        return self._pack([t.id for t in self.model.tokenize(mapped)])

    def _word(self, word: str) -> bytes:
        """Letters after a space."""
        if word.isascii():  # ASCII letters stand for themselves
            return self._pack([t.id for t in self.model.tokenize(self.space + word)])
        return self._piece(" " + word)

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a chunk with the space before it."""
        if chunk.isalpha():
            return self._word(chunk)
        stem = chunk[:-1]
        if stem.isalpha() and chunk[-1] in ".,!?;:":
            return (self.chunks.known(stem) or self._word(stem)) + self.pieces[chunk[-1]]
        return b"".join([self.pieces[p] for p in self.split(" " + chunk)])

    def forget(self) -> None:
        """At a task's end: what the memos and array operations hold."""
        self.chunks.forget()
        self.pieces.forget()
        self._forget_words()
        pa.default_memory_pool().release_unused()

    def first(self, chunk: str) -> bytes:
        """The ids of a chunk that begins a text."""
        return b"".join([self.pieces[p] for p in self.split(chunk)])

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """``encode`` of many texts."""
        if not self.plain:
            return pa.array([self.encode(t.as_py()) for t in texts], pa.binary())
        return apart(texts, self.special, self._plain, self.encode)

    def _plain(self, texts: pa.Array) -> pa.Array:
        """The ids of texts without odd white space.  A chunk that begins with a line end has no space before it."""
        if not len(texts):
            return pa.array([], pa.binary())
        lists = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        chunks = lists.flatten().dictionary_encode()
        stems, marks = (x.dictionary_encode() for x in without_marks(chunks.dictionary))
        ends = pa.array([self.pieces[m] if m else b"" for m in marks.dictionary.to_pylist()], pa.binary())
        values = pc.binary_join_element_wise(self._words(stems.dictionary).take(stems.indices), ends.take(marks.indices), b"")
        # The line end that each text was given to begin with goes again.
        at, offsets = chunks.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy()
        begins = offsets[:-1] - offsets[0]
        heads, which = np.unique(at[begins], return_inverse=True)
        at[begins] = len(values) + which
        firsts = [v[len(self.line_end) :] for v in values.take(pa.array(heads)).to_pylist()]
        return dealt(pa.concat_arrays([values, pa.array(firsts, pa.binary())]), at, offsets)

    def _forget_words(self) -> None:
        self.rows, self.made, self.used = {}, pa.array([], pa.binary()), 0

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words with the space or line end before them, from the memo or else made."""
        if self.used >= MEMO_CHUNKS:
            self._forget_words()
        names = words.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in names if w not in self.rows]
        if new:
            letters, odd = [w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]
            new = letters + odd
            made = pa.concat_arrays([self._letters(letters), pa.array([*map(self._odd_word, odd)], pa.binary())])
            self.rows.update(zip(new, range(len(self.made), len(self.made) + len(new))))
            self.made = pa.concat_arrays([self.made, made])
            self.used += sum(map(len, new)) + made.nbytes + TwoGenerations.ENTRY * len(new)
        return self.made.take(pa.array(np.fromiter(map(self.rows.__getitem__, names), np.int64, len(names))))

    def _odd_word(self, word: str) -> bytes:
        if word[0] != "\n":
            return b"".join([self.pieces[p] for p in self.split(" " + word)])
        return self.line_end + (self.pieces[word[1:]] if word[1:].isalpha() else self.first(word[1:]))

    def _letters(self, words: list[str]) -> pa.Array:
        """The ids of words of letters with the space before them: one pre-token each, put to the model one after another."""
        others = iter("\n".join([" " + w for w in words if not w.isascii()]).encode("utf-8").decode("latin-1").translate(self.table).split(self.lines))
        mapped, sizes, ids, id_of = [self.space + w if w.isascii() else next(others) for w in words], array("q"), array(self.code), attrgetter("id")
        for at in range(0, len(mapped), _CALLS):
            tokens = list(map(self.model.tokenize, mapped[at : at + _CALLS]))
            sizes.extend(map(len, tokens))
            ids.extend(map(id_of, chain.from_iterable(tokens)))
        return strings(np.array(ids, self.dtype).view(np.uint8), np.array(sizes, np.int64) * self.dtype.itemsize, pa.binary())

    def encode(self, text: str | None) -> bytes:
        """All ids of the text, as the library gives them without added special tokens."""
        if not text:
            return b""
        spaces = text.count(" ")
        if not self.plain or len(text.split()) != spaces + text.count("\n") + 1 or any(s in text for s in self.special):
            return self._pack(self.whole.encode(text, add_special_tokens=False).ids)
        first, _, rest = text.partition(" ")
        out = self.first(first)
        return out + b"".join(map(self.chunks.__getitem__, rest.split(" "))) if rest or spaces else out


@functools.cache
def encoder(path: str, pattern: str) -> ChunkEncoder:
    """One encoder, with its memo, for each worker process."""
    return ChunkEncoder(path, pattern)
