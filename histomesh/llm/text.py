"""Vectorised byte and word helpers used inside tasks.

A batch of texts is one uint8 buffer plus offsets. Words are the runs without ASCII white space
(``[^\\x20\\x09-\\x0D]+``) after lower-casing A-Z; each gets a 64-bit hash computed for the whole
buffer at once: random values per byte, times powers of an odd multiplier, summed by prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BYTE_VALUES = np.random.default_rng(20_240_601).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_BYTE_VALUES[65:91] = _BYTE_VALUES[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), _U)
    out[0] = 1
    size, step = 1, base
    while size < n:
        take = min(size, n - size)
        out[size : size + take] = out[:take] * _U(step)
        step = step * step % (1 << 64)
        size += take
    return out


_cache: dict[str, np.ndarray] = {"up": _powers(_MULTIPLIER, 1 << 16), "down": _powers(_INVERSE, 1 << 16)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache["up"]) >= n:
        return _cache["up"], _cache["down"]
    up, down = _powers(_MULTIPLIER, n), _powers(_INVERSE, n)
    if n <= 1 << 21:
        _cache.update(up=up, down=down)
    return up, down


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes together stay near ``size`` (one row at least)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


class SpanHasher:
    """Hashes of any spans of a buffer, A-Z taken as a-z; equal bytes hash alike wherever they stand."""

    def __init__(self, buffer: np.ndarray):
        up, self.down = _power_tables(len(buffer) + 1)
        self.total = np.zeros(len(buffer) + 1, _U)
        np.cumsum(_BYTE_VALUES[buffer] * up[: len(buffer)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts])


def words(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of every word, in order; start and end are byte positions."""
    n = len(buffer)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, _U)
    inside = np.empty(n + 1, bool)
    np.logical_not(SPACE[buffer], out=inside[:n])
    inside[n] = False
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] |= inside[edges]
    starts = np.flatnonzero(begins)
    stops = inside[:n] & ~inside[1:]
    cut = edges[edges > 0] - 1
    stops[cut] |= inside[cut]
    ends = np.flatnonzero(stops) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return rows, starts, ends, SpanHasher(buffer)(starts, ends)


def shingles(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, hash) of the n-word shingles; a shorter row is one shingle as a whole."""
    m = len(hashes)
    if m == 0:
        return rows, np.zeros(0, np.int64), hashes
    value = mix(hashes + _U(n))
    for k in range(1, n):
        nxt = np.zeros(m, _U)
        nxt[: m - k] = hashes[k:]
        value = mix(value * _U(_MULTIPLIER) + nxt)
    whole = np.zeros(m, bool)
    if m >= n:
        whole[: m - n + 1] = rows[: m - n + 1] == rows[n - 1 :]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    count = np.diff(np.r_[first, m])
    short = first[count < n]
    keep = whole.copy()
    keep[short] = True
    for at in short:
        size = count[np.searchsorted(first, at)]
        h = mix(hashes[at : at + 1] + _U(size))
        for k in range(1, size):
            h = mix(h * _U(_MULTIPLIER) + hashes[at + k : at + k + 1])
        value[at] = h[0]
    at = np.flatnonzero(keep)
    return rows[at], at, value[at]
