"""Word shingles of whole texts as 64-bit hashes, computed on UTF-8 bytes without Python strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_RNG = np.random.default_rng(20240607)
#: One random odd 64-bit value per byte; A-Z share those of a-z. 0 marks separators.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n``."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(max(n, 1 << 16), b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash for each word of one text's bytes."""
    sep = SEPARATOR[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], sep, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    p, inv = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * p[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))


def shingle_set(data: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; of the whole sequence if it is shorter."""
    w = word_hashes(data)
    n = len(w)
    if not n:
        return w
    size = min(n, k)
    _, inv = powers(k + 2)
    s = np.full(n - size + 1, _U(size), np.uint64)
    for j in range(size):
        s += w[j : n - size + 1 + j] * inv[j + 1]
    s = np.sort(mix(s))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def text_bytes(column: pa.Array) -> list[np.ndarray]:
    """The UTF-8 bytes of each value; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = column.is_valid().to_pylist() if column.null_count else None
    none = np.empty(0, np.uint8)
    return [d[a:b] if valid is None or valid[i] else none for i, (a, b) in enumerate(zip(o[:-1].tolist(), o[1:].tolist(), strict=True))]
