"""Vectorised word splitting and Rabin-Karp hashing of Arrow text columns.

Everything works on the UTF-8 bytes of a slice of documents at once, so no Python loop runs per
document or per word. A polynomial hash of any byte or word range is the difference of two prefix
sums modulo 2**64, divided by a power of the (odd, hence invertible) base.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; a longer document forms a slice of its own.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)

#: Bytes that end a word: space and \x09-\x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_powers: dict[str, np.ndarray] = {}

#: Bytes that are hashed at once, unless a word is longer; the kept tables of powers are as long.
_HASH_BYTES = 1 << 20


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); kept, as every slice needs them."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, _HASH_BYTES + 1), base, np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if len(have) == _HASH_BYTES + 1:
            _powers[name] = have
    return have[:n]


try:
    _trim = ctypes.CDLL(None).malloc_trim
    # large arrays are mapped one by one, so freeing them gives the memory back at once (M_MMAP_THRESHOLD is -3)
    ctypes.CDLL(None).mallopt(-3, 4 << 20)
except (OSError, AttributeError, TypeError):  # another C library
    _trim = None


def give_back() -> None:
    """Returns free memory to the system, as workers live on with other operators."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def thrifty(run):
    """run (of a group's tables), and what it took is given back before the next group."""

    @wraps(run)
    def work(*tables: pa.Table) -> pa.Table:
        out = run(*tables)
        give_back()
        return out

    # Spark counts the arguments to tell whether the key is wanted too
    work.__signature__ = inspect.signature(run)
    return work


def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; memory that one of them took is given back before the next."""
    for batch in batches:
        yield batch
        del batch
        give_back()


@dataclass
class Slice:
    """Some consecutive documents: bytes, document bounds in them, and the words."""

    first: int  # row of the batch that the slice begins with
    data: np.ndarray  # uint8
    bounds: np.ndarray  # int64, n + 1
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    word_bounds: np.ndarray  # int64, n + 1: words of document i are word_bounds[i]:word_bounds[i + 1]

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.word_bounds))

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of the bytes of each word."""
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            first = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, first + _HASH_BYTES, side="right")))
            codes = _BYTE_CODES[self.data[first : self.ends[j - 1]]]
            codes *= _power("byte", _BASE, len(codes))
            total = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(codes, out=total[1:])
            starts, ends = self.starts[i:j] - first, self.ends[i:j] - first
            found = total[ends] - total[starts]
            found *= _power("inverse", _BASE_INVERSE, len(codes) + 1)[starts]
            out[i:j] = mix(found + (ends - starts).astype(np.uint64))
            i = j
        return out

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hash of each k consecutive words of one document, and the word that it begins with."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rolled = hashes[:n].copy()
        for j in range(1, k):
            rolled *= _WORD_BASE
            rolled += hashes[j : j + n]
        owner = self.owners()
        at = np.flatnonzero(owner[:n] == owner[k - 1 :])
        return mix(rolled[at]), at


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(at) == 0:
        at = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at, raw


def spans(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def split_words(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many words stand before each document."""
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, bounds).astype(np.int64)


def slices(column: pa.Array, lower: bool = False, separators: np.ndarray = SPACES, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The documents of a text column, a few MB at a time; lower turns A-Z into a-z."""
    offsets, raw = text_buffers(column)
    for i, j in spans(offsets, limit):
        data = raw[offsets[i] : offsets[j]]
        if lower:
            data = _LOWER[data]
        bounds = offsets[i : j + 1] - offsets[i]
        yield Slice(i, data, bounds, *split_words(data, bounds, separators))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0] + 1, ... of all the ranges one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)
