"""Words of whole columns of text at once: numpy over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer document is a chunk of its own.
CHUNK = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A finishing bijection on 64 bits (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 that is False on the bytes that separate words."""
    table = np.ones(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = False
    return table


#: Words are runs without space and \t \n \v \f \r.
SPACED = separators([(0x09, 0x0D), (0x20, 0x20)])


@lru_cache(2)
def _table(fold: bool) -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(20240711)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        values[65:91] = values[97:123]
    return values


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK)
        _POWERS.clear()
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            factors = np.full(size, b, dtype=np.uint64)
            factors[0] = 1
            _POWERS.append(np.cumprod(factors))
    return _POWERS[0], _POWERS[1]


class Words:
    """Words of consecutive documents: word i is data[start[i]:end[i]]; those of document d are first[d] .. first[d + 1] - 1.

    table gives each byte's class; a word is a run of one class other than 0 (or False).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data, self.offsets = data, offsets
        kind = table[data]
        cut = np.ones(len(data) + 1, dtype=bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
        cut[offsets] = True
        inside = kind != 0
        self.start = np.flatnonzero(inside & cut[:-1])
        self.end = np.flatnonzero(inside & cut[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self, fold: bool = True) -> np.ndarray:
        """A 64-bit hash of each word; fold: A-Z count as a-z."""
        up, down = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        x = _table(fold)[self.data]
        x *= up[: len(x)]
        np.cumsum(x, out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64) * _M2)

    def text(self, d: int) -> bytes:
        return self.data[self.offsets[d] : self.offsets[d + 1]].tobytes()


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words; fewer words make one shingle of all of them, none make none."""
    n = len(h)
    if n == 0:
        return h
    k = min(n, size)
    out = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : n - k + 1 + i]
    return mix(out)


def chunks(column: pa.Array | pa.ChunkedArray, table: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """Cuts a text column into pieces of about CHUNK bytes: (first row, row after the last, Words). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    _, offsets, values = column.buffers()
    wide = pa.types.is_large_string(column.type)
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        yield at, to, Words(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at], table)
        at = to
