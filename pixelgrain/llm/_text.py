"""Vectorised token kernels over Arrow buffers: word boundaries, rolling word hashes and shingles, without per-word Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\x0b\x0c\r"
BLOCK = 1 << 20

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _ODD)


def byte_table(separators: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is word byte, value of byte): A-Z are folded when lower is set, nothing else."""
    word = np.ones(256, bool)
    word[np.frombuffer(separators, np.uint8)] = False
    fold = np.arange(256)
    if lower:
        fold[65:91] += 32
    return word, _BYTE[fold]


BY_SPACE = byte_table(SPACES)
BY_ALNUM = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()))

_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _BASE_INV)):
            table = np.full(size, base, _U)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def column_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a binary or string array without nulls, no copy."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    large = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64 if large else np.int32, len(array) + 1, array.offset * (8 if large else 4)).astype(np.int64)
    return offs, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def blocks(array: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about size bytes: (first row, end row, bytes, offsets into those bytes). A longer text is a run alone."""
    offs, data = column_buffers(array)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, table: tuple[np.ndarray, np.ndarray] = BY_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first byte, end byte, index of each document's first word, with an end entry)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), none, none, np.zeros(len(offs), np.int64)
    is_word = table[0][data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.concatenate(([False], is_word[:-1])) & ~edge[:-1]
    after = np.concatenate((is_word[1:], [False])) & ~edge[1:]
    begin = np.flatnonzero(is_word & ~before)
    end = np.flatnonzero(is_word & ~after) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(table[1][data] * power[:n], out=sums[1:])
    h = (sums[end] - sums[begin]) * inverse[begin]
    h = mix(h + (end - begin).astype(_U) * _ODD)
    return h, begin, end, np.searchsorted(begin, offs)


_LANES = mix(np.arange(1001, 1065, dtype=_U))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes, also across documents; callers drop those."""
    if len(h) < k:
        return np.zeros(0, _U)
    n = len(h) - k + 1
    out = np.zeros(n, _U)
    for i in range(k):
        out += h[i : i + n] * _LANES[i]
    return mix(out)


def shingle_sets(h: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document; with fewer words the whole sequence is one shingle."""
    g = grams(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = mix((h[a:b] * _LANES[: b - a]).sum(dtype=_U, keepdims=True) + np.array([b - a], _U) * _ODD)
        else:
            s = g[:0]
        out.append(s)
    return out


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """values dealt out to lists of the given lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))
