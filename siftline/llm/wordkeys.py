"""Vectorised words, word hashes and n-gram hashes of Arrow text columns.

A word is a run of characters other than space and U+0009..U+000D; those are single bytes in UTF-8, so bytes
suffice. Words are lower-cased for A-Z only. All hashes are 64-bit and depend on nothing but the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_SPAN = 4 << 20
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x + _M3
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls up to a bound."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        step = np.uint64(base)
        while done < size:
            more = min(done, size - done)
            have[done : done + more] = have[:more] * step
            done += more
            step = np.uint64(int(step) * int(step) % (1 << 64))
        if size <= _SPAN + 2:
            _powers[base] = have
    return have[:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text each, or one row where a single text is longer."""
    _, at = column_bytes(column)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, "right")) - 1)
        yield begin, min(end, len(column))
        begin = end


class Words:
    """The words of some texts: ``row``, ``start``, ``end`` (bytes from the slice's begin) of each word.

    ``first[i]:first[i + 1]`` are the words of row i.
    """

    def __init__(self, column: pa.Array, separator: np.ndarray = SEPARATOR):
        self.raw, self.offsets = column_bytes(column)
        self.rows = len(self.offsets) - 1
        inside = ~separator[self.raw]
        edge = np.zeros(len(self.raw) + 1, bool)
        edge[self.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets, "left")
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))

    def hashes(self, lower: bool = True, first_bytes: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its ``first_bytes``; long slices go in spans, so memory stays bounded."""
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + _SPAN, "right")))
            base = self.start[i]
            part = self.raw[base : self.end[j - 1]]
            if lower:
                part = LOWER[part]
            n = len(part)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[part] * powers(_BASE, n), out=total[1:])
            s, e = self.start[i:j] - base, self.end[i:j] - base
            e = e if first_bytes is None else np.minimum(e, s + first_bytes)
            out[i:j] = mix((total[e] - total[s]) * powers(_INVERSE, n)[s] + (e - s).astype(np.uint64))
            i = j
        return out


def runs(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values (len(values) - k + 1 of them, none when there are fewer)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for i in range(0, n, 1 << 20):
        m = min(1 << 20, n - i)
        part = values[i : i + m + k - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(_BASE, len(part)), out=total[1:])
        out[i : i + m] = mix((total[k:] - total[:-k]) * powers(_INVERSE, len(part))[:m] + np.uint64(k))
    return out


def row_runs(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of every k-gram that stays inside its row."""
    grams = runs(hashes, k)
    if not len(grams):
        return np.zeros(0, np.int64), grams
    at = np.flatnonzero(words.row[: len(grams)] == words.row[k - 1 :])
    return at, grams[at]


def shingles(words: Words, hashes: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct k-gram hashes; a row of fewer words has its whole sequence as one."""
    at, grams = row_runs(words, hashes, k)
    bound = np.searchsorted(at, words.first)
    count = np.diff(words.first)
    out = []
    for i in range(words.rows):
        if count[i] >= k:
            out.append(np.unique(grams[bound[i] : bound[i + 1]]))
        elif count[i]:
            out.append(runs(hashes[words.first[i] : words.first[i + 1]], int(count[i])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
