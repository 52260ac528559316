"""Vectorised reading of text columns: bytes, words and 64-bit word hashes of a block of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))
_BYTES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x`` (a bijection of 64-bit values)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a string or binary column, offsets of its rows); a null row is empty."""
    kind = pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null("" if kind == pa.large_string() else b"")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def sliced(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Words:
    """Words (runs of bytes other than 0x20 and 0x09-0x0D) of consecutive documents.

    ``starts`` and ``ends`` are byte places, ``bounds[d]:bounds[d + 1]`` the words of document d.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _UPPER[data] if lower else data
        solid = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first, last = solid.copy(), solid
        if len(data):
            first[1:] &= ~solid[:-1] | edge[1:-1]
            last = solid.copy()
            last[:-1] &= ~solid[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same wherever the word stands."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[self.data] * powers(_STEP, n), out=sums[1:])
        value = (sums[self.ends] - sums[self.starts]) * powers(_INVERSE, n + 1)[self.starts]
        return mixed(value + (self.ends - self.starts).astype(np.uint64))


def runs_of(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = values[:n].copy()
    for j in range(1, width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += values[j : j + n]
    return mixed(out)
