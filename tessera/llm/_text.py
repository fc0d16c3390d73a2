"""Vectorised text primitives over Arrow string buffers, shared by the operators that use numpy.

A part is a run of whole texts, about ``PART_BYTES`` of UTF-8 (one longer text is a part
of its own), so that temporaries stay small whatever a batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z, leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(0x5EED)
_BYTE_KEY = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def utf8(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string array, without copying; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    if array.null_count:
        array = pc.fill_null(array, "")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = array.buffers()
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    offsets = np.frombuffer(off, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def parts(array: pa.Array, limit: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each part of an array."""
    data, offsets = utf8(array)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` over each text."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``; words of text i are first[i]:first[i+1]."""
    n = len(data)
    white = WHITE[data]
    before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
    before[1:] = np.append(white, True)[:n]
    after[: n - 1] = white[1:] if n else after[: n - 1]
    before[offsets] = True
    last = offsets[offsets > 0] - 1
    after[last] = True
    starts = np.flatnonzero(~white & before[:n])
    ends = np.flatnonzero(~white & after[:n]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, PART_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span: a polynomial in random byte keys, then mixed."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_KEY[data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h
