"""Words, hashes and shingles of UTF-8 texts on whole Arrow batches with numpy.

A word is a run of bytes other than space and \\x09-\\x0D. All of these are single bytes in UTF-8, so texts need no decoding.
Hashes have 64 bits and are the same in every process. A word's hash is a polynomial modulo 2^64 over a table of
random byte values, mixed at the end; folding A-Z to a-z happens in the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000  # text handled at once; a longer single text is a slice of its own
PART_BYTES = 1 << 16
U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _table(key: int, fold: bool) -> np.ndarray:
    values = np.random.Generator(np.random.Philox(key=key)).integers(1, 1 << 63, 256, dtype=np.uint64)
    if fold:
        values[65:91] = values[97:123]
    return values


TABLES = {False: _table(20240229, False), True: _table(20240229, True), None: _table(777, False)}
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to n; kept between calls."""
    global _powers, _inverse
    if len(_powers) <= n:
        size = 1 << int(n + 1).bit_length()
        _powers, _inverse = np.full(size, BASE, dtype=np.uint64), np.full(size, BASE_INVERSE, dtype=np.uint64)
        _powers[0] = _inverse[0] = 1
        np.cumprod(_powers, out=_powers)
        np.cumprod(_inverse, out=_inverse)
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``limit`` bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    if not len(column):
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@dataclass
class Words:
    """Byte range, row and position of each word; ``first`` has for each row its first word, and one more entry."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n, rows = len(data), len(offsets) - 1
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, np.zeros(rows + 1, dtype=np.int64))
    solid = ~WHITE[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    bounds = offsets[(offsets > 0) & (offsets < n)]
    opens[bounds] = solid[bounds]
    closes[bounds - 1] = solid[bounds - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, offsets)
    return Words(starts, ends, np.repeat(np.arange(rows), np.diff(first)), first)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool | None) -> np.ndarray:
    """Hash of data[start:end] for every range; ``fold`` None gives another, independent hash."""
    powers, inverse = _grown(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    for at in range(0, len(data), PART_BYTES):  # else each step has an array of eight times the text
        part = data[at : at + PART_BYTES]
        np.multiply(TABLES[fold][part], powers[at : at + len(part)], out=total[at + 1 : at + 1 + len(part)])
    np.cumsum(total, out=total)
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


STEPS = np.array([pow(0xA0761D6478BD642F, i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)


def windows(hashes: np.ndarray, first: np.ndarray, size: int, whole_short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words that stay in one row, and the first window of each row.

    ``whole_short``: a row of fewer words (but one at least) has its whole sequence as its only window.
    """
    counts = np.diff(first)
    n_windows = np.maximum(counts - size + 1, 0)
    if whole_short:
        short = (counts > 0) & (counts < size)
        n_windows[short] = 1
    at = np.zeros(len(first), dtype=np.int64)
    np.cumsum(n_windows, out=at[1:])
    if not at[-1]:
        return np.zeros(0, dtype=np.uint64), at
    begin = np.repeat(first[:-1] - at[:-1], n_windows) + np.arange(at[-1])
    out = np.zeros(at[-1], dtype=np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, dtype=np.uint64)])
    for i in range(size):
        out += padded[begin + i] * STEPS[i]
    if whole_short:
        for r in np.flatnonzero(short):
            own = hashes[first[r] : first[r + 1]]
            out[at[r]] = np.append(own, U(len(own))) @ np.append(STEPS[: len(own)], STEPS[size])
    return mix(out), at


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for every i."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return h.view(np.int64)
