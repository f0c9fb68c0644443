"""Text columns as flat byte arrays: words, dictionary codes and token ids for whole Arrow batches.

Every function works on the UTF-8 bytes of many rows at once. A word is a run
of bytes other than space, tab, newline, vertical tab, form feed and return.
"""

from __future__ import annotations

import codecs
import ctypes
import os
import re
import sys
import types
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2_500_000


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SPACE = _table(b" \t\n\x0b\x0c\r")
LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)))
LOWER_CASE = np.arange(256, dtype=np.uint8)
LOWER_CASE[65:91] += 32
# ASCII punctuation that no pre-tokenizer pattern joins to a letter before it (the apostrophe does)
STOP = _table(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(sizes)]):
            if b > a:
                yield batch.slice(a, b - a)
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: a reused worker would keep it beside the other one of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; NULL counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The reverse of ``flat``, without a copy."""
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))
    )


def heads(offsets: np.ndarray, size: int) -> np.ndarray:
    """True at the first byte of each row."""
    out = np.zeros(size, bool)
    first = offsets[:-1]
    out[first[first < size]] = True
    return out


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte behind each run of ``inside`` bytes; runs end with their row. Words by default."""
    inside = ~SPACE[data] if inside is None else inside
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = heads(offsets, len(data))
    before = np.concatenate(([False], inside[:-1])) & ~row
    behind = np.concatenate((inside[1:] & ~row[1:], [False]))
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~behind) + 1


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, starts, "right") - 1


def coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Dictionary code of each span, and the distinct strings. Spans lie in order without overlap."""
    delta = np.zeros(len(data) + 1, np.int8)
    delta[starts] += 1
    delta[ends] -= 1
    keep = np.cumsum(delta[:-1], dtype=np.int8).view(bool)
    found = strings(data[keep], np.concatenate(([0], np.cumsum(ends - starts)))).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and dictionary code of each word of a column, and the distinct words."""
    data, offsets = flat(column)
    starts, ends = spans(data, offsets)
    codes, distinct = coded(data, starts, ends)
    return rows_of(starts, offsets), codes, distinct


def hashed(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gathered(values: np.ndarray, first: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[first[c] : first[c] + sizes[c]]`` of all codes in a row, and the size of each."""
    n = sizes[codes]
    total = int(n.sum())
    at = np.repeat(first[codes] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
    return values[at], n


def kept(name: str) -> dict:
    """A dictionary that a reused worker process keeps for its next task; functions travel by value, module globals do not stay."""
    holder = sys.modules.setdefault("_gridloom_worker", types.ModuleType("_gridloom_worker"))
    return holder.__dict__.setdefault(name, {})


WIDE = re.compile("[^\x00-\xff]").search
# the byte alphabet of byte-level files: printable Latin-1 stands for itself, the rest follows from 256
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_KEPT)))}
ALPHABET = "".join(BYTE_CHARS.get(b, chr(b)) for b in range(256))


class Store:
    """Ids (and character spans) of pieces, one after the other."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.begin, self.ids, self.spans = array("q", [0]), array("I"), array("I")

    def add(self, piece: str, ids: list[int]) -> None:
        self.index[piece] = len(self.begin) - 1
        self.ids.extend(ids)
        self.begin.append(len(self.ids))

    def only(self, pieces: list[str]) -> Store:
        """A new store of those of the pieces that this one has."""
        out = Store()
        for piece in pieces:
            at = self.index.get(piece)
            if at is not None:
                a, b = self.begin[at], self.begin[at + 1]
                out.add(piece, self.ids[a:b])
                if self.spans:
                    out.spans.extend(self.spans[2 * a : 2 * b])
        return out


class Encoder:
    """Token ids of whole texts by a public ``tokenizers`` file.

    Texts are cut only where the file's pre-tokenizer always cuts: before white
    space that follows something else, and between an ASCII letter and ASCII
    punctuation other than an apostrophe. Each distinct piece is encoded once
    per task, so the ids equal those of the whole text. Strings of special
    tokens in a text are ordinary text.
    """

    CACHE = 400_000

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.lower = self.tokenizer.normalizer is not None
        self.path, self.cache = path, cache

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Offsets of the pieces, and of the rows."""
        space = SPACE[data]
        before = np.concatenate(([False], space[:-1]))
        start = space & ~before
        start[1:] |= LETTER[data[:-1]] & STOP[data[1:]]
        at = np.flatnonzero(start)
        wide = at[(at > 1) & (data[at - 1] >= 0x80)]
        if len(wide):  # no cut behind white space beyond ASCII
            p1, p2, p3 = data[wide - 1], data[wide - 2], data[np.maximum(wide - 3, 0)]
            blank = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
            blank |= (p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)
            blank |= (p3 == 0xE2) & (p2 == 0x80) & ((p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF))
            blank |= (p3 == 0xE2) & (p2 == 0x81) & (p1 == 0x9F)
            blank |= (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)
            start[wide[blank]] = False
        first = offsets[:-1]
        start[first[first < len(data)]] = True
        return np.append(np.flatnonzero(start), len(data))

    def _learn(self, store: Store, new: list[str], with_spans: bool) -> None:
        plain, hard = [], []
        for piece in new:
            body = piece if self.lower or piece[:1] != " " else piece[1:]
            easy = not with_spans and body.isalpha() and (body.isascii() or not WIDE(body))
            (plain if easy else hard).append(piece)
        # one run of letters is one pre-token: the model itself takes it, in its byte alphabet
        tokenize, add, blank = self.tokenizer.model.tokenize, store.add, BYTE_CHARS[32]
        for piece in plain:
            part = piece.lower() if self.lower else piece
            if not part.isascii():
                part = codecs.charmap_decode(part.encode(), "strict", ALPHABET)[0]
            elif part[0] == " ":
                part = blank + part[1:]
            add(piece, [t.id for t in tokenize(part)])
        encode = self.tokenizer.encode_batch if with_spans else self.tokenizer.encode_batch_fast
        for piece, found in zip(hard, encode(hard, add_special_tokens=False)):
            store.add(piece, found.ids)
            if with_spans:
                store.spans.extend(chain.from_iterable(found.offsets))

    def __call__(self, column: pa.Array, with_spans: bool = False):
        """Ids of all rows in a row and the offsets of the rows in them.

        ``with_spans`` adds first character and character behind each token, counted from the row's start.
        """
        memory = kept(f"pieces {self.path} {with_spans}")
        store = memory.setdefault("store", Store())
        data, offsets = flat(column)
        cuts = self.cuts(data, offsets) if len(data) else np.zeros(1, np.int64)
        body, at = data, cuts
        if self.lower and not with_spans:  # such a file drops white space and case, so fewer pieces differ without them
            inside = ~SPACE[data]
            at = np.concatenate(([0], np.cumsum(inside)))[cuts]
            body = LOWER_CASE[data][inside]
        found = strings(body, at).dictionary_encode()
        codes, distinct = found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(store.index) > self.cache:
            store = memory["store"] = store.only(distinct)
        places = np.fromiter(map(store.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(places < 0)
        if len(unknown):
            new = [distinct[i] for i in unknown.tolist()]
            self._learn(store, new, with_spans)
            places[unknown] = list(map(store.index.get, new))
        begin = np.frombuffer(store.begin, np.int64)
        first, sizes = begin[places], begin[places + 1] - begin[places]
        ids, n = gathered(np.frombuffer(store.ids, np.uint32), first, sizes, codes)
        upto = np.concatenate(([0], np.cumsum(n)))
        rows = upto[np.searchsorted(cuts[:-1], offsets)]
        if not with_spans:
            return ids, rows
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        row = rows_of(cuts[:-1], offsets)
        base = np.repeat(chars[cuts[:-1]] - chars[offsets[row]], n)
        where = np.frombuffer(store.spans, np.uint32).reshape(-1, 2)
        at, _ = gathered(np.arange(len(where)), first, sizes, codes)
        return ids, rows, base + where[at, 0], base + where[at, 1]
