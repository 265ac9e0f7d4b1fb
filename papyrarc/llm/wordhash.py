"""Vectorised word and shingle hashing over Arrow string buffers."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, applied to each unsigned 64-bit value."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


#: A random value for each byte, so that a word's hash is no polynomial in small numbers.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    with np.errstate(over="ignore"):
        while filled < n:
            take = min(filled, n - filled)
            out[filled : filled + take] = out[:take] * U64(pow(base, filled, 1 << 64))
            filled += take
    return out


def chunks(column: pa.Array, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows with at most `limit` bytes (or one longer row): first row, offsets from 0, bytes."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


def word_hashes(offsets: np.ndarray, data: np.ndarray, separators: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ASCII-lower-cased words between separators (a mark for each byte value), and each word's row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _LOWER[data]
    inside = ~separators[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    size = 1 << max(16, int(n).bit_length())
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data] * _powers(size, _BASE)[:n], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * _powers(size, _INVERSE)[starts]
    return mix(hashes), np.searchsorted(offsets, starts, "right") - 1


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `k` words in a row; a row of fewer words has one, of all its words."""
    n = len(words)
    if not n:
        return words, rows
    with np.errstate(over="ignore"):
        weight = _powers(1 << 16, 0xD1342543DE82EF95)
        full = np.zeros(0, np.uint64)
        full_rows = np.zeros(0, np.int64)
        if n >= k:
            total = np.zeros(n - k + 1, np.uint64)
            for i in range(k):
                total += words[i : n - k + 1 + i] * weight[i + 1]
            same = rows[: n - k + 1] == rows[k - 1 :]
            full, full_rows = total[same], rows[: n - k + 1][same]
        begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        count = np.diff(np.r_[begin, n])
        short = np.flatnonzero(count < k)
        if len(short):
            total = np.zeros(len(short), np.uint64)
            for i in range(k - 1):
                has = count[short] > i
                total[has] += words[begin[short[has]] + i] * weight[i + 1]
            total = total * U64(3) + count[short].astype(np.uint64)
            full = np.r_[full, total]
            full_rows = np.r_[full_rows, rows[begin[short]]]
            order = np.argsort(full_rows, kind="stable")
            full, full_rows = full[order], full_rows[order]
    return mix(full), full_rows
