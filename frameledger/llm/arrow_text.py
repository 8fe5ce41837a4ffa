"""Helpers for Arrow batches of texts inside Spark tasks: bounded slices, UTF-8 views, words and word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The ASCII white space that separates words: space and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z; every other byte stays.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: tuple[np.ndarray, np.ndarray] | None = None


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about `limit` bytes of text each; a row is never cut."""
    size = np.diff(utf8(batch.column(column))[1])
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and where each row starts and the last ends. Null rows are empty."""
    if pa.types.is_null(array.type):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def texts(array: pa.Array) -> list[bytes]:
    """Each row as UTF-8 bytes; null rows are empty."""
    data, at = utf8(array)
    raw = data.tobytes()
    at = at.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (SplitMix64), for hashes whose low bits are weak."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) <= n:
        size = max(n + 1, 5 << 20)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            tables.append(np.multiply.accumulate(p))
        _powers = (tables[0], tables[1])
    return _powers


class Words:
    """The words of a slice of texts, as arrays.

    starts, ends: byte ranges in `data`; first: index of each text's first word, with the total at the end;
    row: the text of each word.
    """

    def __init__(self, array: pa.Array, lower: bool = True):
        self.data, self.at = utf8(array)
        if lower:
            self.data = _LOWER[self.data]
        solid = ~_SPACE[self.data]
        n = len(solid)
        opens, closes = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1]
        closes[:-1] &= ~solid[1:]
        filled = np.diff(self.at) > 0
        heads, tails = self.at[:-1][filled], self.at[1:][filled] - 1
        opens[heads] = solid[heads]
        closes[tails] = solid[tails]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.at)
        self.row = np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))
        self._n = n

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in its bytes, from running sums, then mixed."""
        up, down = _power_table(self._n)
        sums = np.zeros(self._n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: self._n], out=sums[1:])
        return mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of the `width` words from each word on; the last width - 1 places of the array are left out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out + hashes[i : i + n]) * np.uint64(_BASE)
        out ^= out >> np.uint64(29)
    return mixed(out)
