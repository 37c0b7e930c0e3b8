"""Words of many texts at once, as numpy arrays over the texts' UTF-8 bytes.

A word is a longest run of word bytes. Every byte of a character beyond ASCII
is a word byte or none is, so working on bytes gives the same words as working
on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Bytes that are not in a word: white space, or everything in ASCII but a-z and 0-9.
SPACES = np.ones(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

# Odd, so that it can be divided out modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK_BYTES = 1 << 19
# Longer words, in bytes, have another hash.
_LONG = 256


@dataclass
class Words:
    """Words of consecutive texts.

    ``first`` has one entry more than there are texts: text ``i`` holds the words
    ``first[i]`` to ``first[i + 1]``. ``codes`` are 64-bit hashes of the
    lower-cased words; equal words have equal codes, and two different words
    share one with a chance of about 2**-64.
    """

    row: int
    first: np.ndarray
    codes: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), np.diff(self.first))


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, _CHUNK_BYTES + 1)
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if size > 8 * _CHUNK_BYTES:  # for one very long text only
            return table
        _powers[base] = table
    return table


def mix(codes: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, one to one."""
    x = codes ^ (codes >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return offsets.astype(np.int64), np.empty(0, np.uint8)
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8)


def _tokenize(data: np.ndarray, offsets: np.ndarray, row: int, kind: np.ndarray) -> Words:
    n = len(data)
    low = _LOWER[data]
    inside = kind[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(stops) + 1
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n)[:n], out=total[1:])
    codes = mix((total[end] - total[start]) * _power_table(_INVERSE, n)[start])
    # A polynomial modulo 2**64 can be made to collide by words of a thousand letters.
    for i in np.flatnonzero(end - start > _LONG):
        codes[i] = xxhash.xxh64_intdigest(low[start[i] : end[i]].tobytes(), seed=_LONG)
    return Words(row, np.searchsorted(start, offsets), codes)


def words_of(column: pa.Array, kind: np.ndarray) -> Iterator[Words]:
    """Words of a string column, some half a megabyte of whole texts at a time."""
    offsets, data = _buffers(column)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + _CHUNK_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        base = offsets[row]
        yield _tokenize(data[base : offsets[stop]], offsets[row : stop + 1] - base, row, kind)
        row = stop


def among(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which codes are in the sorted ``wanted``: one look at a table of short prefixes
    leaves few to search for."""
    bits = max(10, int(len(wanted)).bit_length() + 4)
    table = np.zeros(1 << bits, dtype=bool)
    shift = np.uint64(64 - bits)
    table[wanted >> shift] = True
    maybe = np.flatnonzero(table[codes >> shift])
    if not len(wanted):
        return maybe
    at = np.minimum(np.searchsorted(wanted, codes[maybe]), len(wanted) - 1)
    return maybe[wanted[at] == codes[maybe]]
