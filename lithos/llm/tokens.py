"""Vectorised word, hash and shingle kernels over Arrow string columns.

Every kernel works on slices of a batch (``SLICE_BYTES`` of text, one row at least), so memory
follows the slice and the longest single text, never the batch or the partition. Hashes are the
same on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
U = np.uint64

#: The white space that ends a word (space and \t \n \v \f \r).
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_P = 0xD6E8FEB86659FD93
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; grown by doubling and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U)
        while len(have) < n:
            have = np.concatenate([have, have * U(pow(base, len(have), 1 << 64))])
        if n <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have


@dataclass
class Slice:
    """Rows [first, first + len(starts) - 1) of a batch: their bytes and offsets."""

    first: int
    data: np.ndarray  # uint8
    starts: np.ndarray  # int64, one more than rows
    null: np.ndarray  # bool

    @property
    def rows(self) -> int:
        return len(self.starts) - 1


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is-null) of a string column without copying the text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offs, data = array.buffers()
    n = len(array)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64), np.empty(0, bool)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    null = np.asarray(array.is_null()) if array.null_count else np.zeros(n, bool)
    return b, o, null


def slices(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    data, offs, null = column(array)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield Slice(i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], null[i:j])
        i = j


@dataclass
class Words:
    start: np.ndarray  # byte offsets in the slice
    end: np.ndarray
    first: np.ndarray  # index of each row's first word, one more than rows
    data: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a row's edge: starts, ends, index of each row's first."""
    n = len(inside)
    if n == 0:
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(starts), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    edge = starts[1:-1]
    before[edge[edge < n]] = False
    after[edge[edge > 0] - 1] = False
    s, e = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return s, e, np.searchsorted(s, starts)


_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def tokens(s: Slice) -> Words:
    """Lower-cased runs of ASCII letters, digits and bytes beyond ASCII: words without punctuation."""
    data = _LOWER[s.data]
    a, b, first = runs(_LETTER[data], s.starts)
    return Words(a, b, first, data)


def points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte of UTF-8, and in all."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def words(s: Slice, lower: bool = False) -> Words:
    data = _LOWER[s.data] if lower else s.data
    a, b, first = runs(~_SPACE[data], s.starts)
    return Words(a, b, first, data)


class SpanHasher:
    """64-bit hashes of byte spans; equal bytes have equal hashes wherever they lie."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.empty(n + 1, U)
        self.sums[0] = 0
        np.cumsum(_BYTE[data] * _power(_P, n)[:n], out=self.sums[1:])
        self.back = _power(_P_INV, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(h + (end - start).astype(U) * U(0xA24BAED4963EE407))


def word_hash(w: Words) -> np.ndarray:
    return SpanHasher(w.data)(w.start, w.end)


def _step(j: int) -> U:
    return U((0x9E3779B97F4A7C15 * (2 * j + 3) | 1) & ((1 << 64) - 1))


def shingle_hash(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word windows, and the index of each row's first; a row of 1 to k-1
    words gives one shingle, its whole sequence; a row without words none."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    pos = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    length = np.repeat(np.minimum(n, k), count)
    out = length.astype(U) * U(0xD1B54A32D192ED03)
    hm = [h * _step(j) for j in range(k)] if len(h) else []
    whole = bool((length == k).all())
    for j in range(k if len(h) else 0):
        if whole:
            out += hm[j][pos + j]
        else:
            ok = length > j
            out[ok] += hm[j][pos[ok] + j]
    return mix(out), at


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type, from_pandas=False) for c, t in zip(columns, schema, strict=True)], schema=schema)
