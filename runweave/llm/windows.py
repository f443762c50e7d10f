"""Rolling hashes of windows over words or bytes, for many documents of a batch at once.

A unit (byte or word) is a 64-bit number; the hash of units s..e-1 is the mixed value of
sum(unit[i] * B**(i - s)) modulo 2**64, taken from prefix sums. Winnowing picks, of every run of
window - seed + 1 seeds, those with the least hash, so two equal windows hold an equal anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are worked on at once; a longer text is taken alone.
PIECE_BYTES = 1 << 20
_power, _inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and its inverses modulo 2**64, for i below n at least."""
    global _power, _inverse
    if len(_power) < n:
        size = max(n, PIECE_BYTES + 1, 2 * len(_power))
        _power = np.cumprod(np.append(_U(1), np.full(size - 1, _BASE, np.uint64)), dtype=np.uint64)
        _inverse = np.cumprod(np.append(_U(1), np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64)), dtype=np.uint64)
    return _power, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix(units: np.ndarray) -> np.ndarray:
    power, _ = powers(len(units) + 1)
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * power[: len(units)], out=out[1:])
    return out


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets): runs of rows of a binary column without nulls,
    at most PIECE_BYTES together or one row."""
    array = batch.column(batch.schema.get_field_index(column))
    wide = pa.types.is_large_binary(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(array):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def byte_units(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: units, starts, ends (in bytes), and each row's first word."""
    n = len(data)
    space = np.ones(n + 2, bool)
    space[1:-1] = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = ~space[1:-1]
    starts = np.flatnonzero(word & (space[:-2] | edge[:-1]))
    ends = np.flatnonzero(word & (space[2:] | edge[1:])) + 1
    return hashes(prefix(_BYTE[data]), starts, ends), starts, ends, np.searchsorted(starts, offsets)


def _sliding(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """``of`` over each run of ``width`` values."""
    at = 1
    while at * 2 <= width:
        x = of(x[:-at], x[at:])
        at *= 2
    return of(x[: len(x) - (width - at)], x[width - at :]) if width > at else x


class Windows:
    """All windows of the documents of a piece. ``first``: each document's first unit, and the end."""

    def __init__(self, units: np.ndarray, first: np.ndarray, window: int, seed: int):
        self.window, self.seed, self.first = window, seed, first
        self.sums = prefix(units)
        sizes = np.diff(first)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        #: whether a window of the document starts at the unit
        self.starts = np.arange(len(units)) + window <= first[1:][self.doc] if len(units) else np.zeros(0, bool)

    def at(self, start: np.ndarray) -> np.ndarray:
        """Hashes of the windows that start at ``start``."""
        return hashes(self.sums, start, start + self.window)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Units at which an anchor starts, and the hash of its seed."""
        n, run = len(self.doc), self.window - self.seed + 1
        if n < self.window or not self.starts.any():
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        start = np.arange(n - self.seed + 1)
        seeds = hashes(self.sums, start, start + self.seed)
        least = _sliding(seeds, run, np.minimum)  # of each window; n - window + 1 values
        least[~self.starts[: len(least)]] = 0
        edge = np.zeros(run - 1, np.uint64)
        most = _sliding(np.concatenate((edge, least, edge)), run, np.maximum)
        at = np.flatnonzero((most == seeds) & (most > 0))
        return at, seeds[at]

    def contexts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of what an anchor and the windows that hold it span."""
        reach, doc = self.window - self.seed, self.doc[at]
        start = np.maximum(at - reach, self.first[doc])
        end = np.minimum(at + self.window, self.first[doc + 1])
        return start, end, mix(hashes(self.sums, start, end) ^ ((at - start) * 4096 + (end - at)).astype(np.uint64))
