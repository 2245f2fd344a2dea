"""Vectorised word hashing over Arrow string columns.

Everything here works on whole column slices with numpy: no Python loop over
documents or words. A slice holds a few megabytes of text, so memory stays
bounded whatever the batch size; a single longer document makes its own slice.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
SLICE_ROWS = 1 << 15

_Q = 0xC2B2AE3D27D4EB4F
_SHINGLE_BITS = 48


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_place = np.zeros(0, dtype=np.uint64)


def string_hashes(body: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each string; the strings lie in `body` one after another, from `first` on, `size` bytes each.

    The sum over the bytes of a random number of the byte times one of its place
    in the string: unlike the powers of a base, places have no structure that
    some text could cancel.
    """
    global _place
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    longest = int(size.max())
    if len(_place) < longest:
        _place = mix64(np.arange(2 * longest + 64, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
    at = np.arange(len(body)) - np.repeat(first, size)
    value = _BYTE[body]
    value *= _place[at]
    h = np.add.reduceat(value, first)
    h ^= size.astype(np.uint64) * np.uint64(_Q)
    return mix64(h)


def _lut(separators) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[list(separators)] = False
    return t


#: Bytes of words, as the contracts state them.
WHITESPACE_WORDS = _lut([0x20, *range(0x09, 0x0E)])
ALNUM_WORDS = _lut([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def trimmed(run):
    """A pass over batches that gives memory back to the machine when its task ends: workers are used again by later stages."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return whole


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def _trim() -> None:
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


@dataclass
class TextSlice:
    """Consecutive rows of a column: `data` holds their UTF-8 bytes, row i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[TextSlice]:
    """Cut a string column into slices of about `limit` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return
    raw = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(raw, raw[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), at + SLICE_ROWS, len(column))
        yield TextSlice(at, to - at, whole[raw[at] : raw[to]], raw[at : to + 1] - raw[at])
        at = to


@dataclass
class Words:
    """Words of a slice: hash, first and last byte, and the row they belong to; row i has words[first[i]:first[i + 1]]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray


def words(s: TextSlice, is_word: np.ndarray = WHITESPACE_WORDS, lower: bool = False) -> Words:
    data = _LOWER[s.data] if lower else s.data
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = is_word[data]
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    cuts = s.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    if len(cuts):
        begins[cuts] |= inside[1:-1][cuts]
        stops[cuts - 1] |= inside[1:-1][cuts - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(stops) + 1
    size = end - start
    h = string_hashes(data[inside[1:-1]], np.cumsum(size) - size, size)
    first = np.searchsorted(start, s.offsets)
    row = np.repeat(np.arange(s.n), np.diff(first))
    return Words(h, start, end, row, first)


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; element i covers words i..i+k-1 (len(h) - k + 1 elements)."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        parts, size, grown = [], 1, h
        rest = k
        while rest:
            if rest & 1:
                parts.append((size, grown))
            rest >>= 1
            if rest:
                grown = grown[: len(grown) - size] * np.uint64(pow(_Q | 1, size, 1 << 64)) + grown[size:]
                size *= 2
        n = len(h) - k + 1
        out, at = np.zeros(n, dtype=np.uint64), 0
        for size, x in parts:
            out = out * np.uint64(pow(_Q | 1, size, 1 << 64)) + x[at : at + n]
            at += size
    return mix64(out ^ np.uint64(k))


def window_starts(w: Words, k: int) -> np.ndarray:
    """Indices of words that start k consecutive words of one row."""
    if len(w.hash) < k:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(w.row[: len(w.row) - k + 1] == w.row[k - 1 :])


def shingle_sets(s: TextSlice, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row as 64-bit hashes, ascending within a row.

    A row of fewer words, but not none, has its whole sequence as the only
    shingle. Returns (hashes, row of each, number per row).
    """
    w = words(s, WHITESPACE_WORDS, lower)
    counts = np.diff(w.first)
    at = window_starts(w, k)
    h, rows = ngrams(w.hash, k)[at], w.row[at]
    few = np.flatnonzero((counts > 0) & (counts < k))
    for n in range(1, k):
        some = few[counts[few] == n]
        if len(some):
            grams = ngrams(w.hash, n)[w.first[some]]
            h, rows = np.concatenate([h, mix64(grams ^ np.uint64(0x5851F42D4C957F2D))]), np.concatenate([rows, some])
    # Row and leading bits sort at once; where those bits are equal and the hashes aren't, all bits do.
    key = (rows.astype(np.uint64) << np.uint64(_SHINGLE_BITS)) | (h >> np.uint64(64 - _SHINGLE_BITS))
    order = np.argsort(key)
    key, h = key[order], h[order]
    if ((key[1:] == key[:-1]) & (h[1:] != h[:-1])).any():
        exact = np.lexsort((h, key))
        order, h = order[exact], h[exact]
    rows = rows[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])])
        h, rows = h[new], rows[new]
    return h, rows, np.bincount(rows, minlength=s.n)
