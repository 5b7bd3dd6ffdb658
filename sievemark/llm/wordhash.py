"""Vectorised splitting and hashing of words over Arrow string columns.

Words are runs of bytes other than space and 0x09-0x0D (or other ASCII bytes). Those separators are ASCII, so cutting
the UTF-8 bytes gives the same words as cutting the characters. A string column is handled in
slices of bounded bytes; a single text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 2 << 20
_AT_ONCE, _HASHED = 1 << 18, 1 << 17
_STEP = U(0x9E3779B97F4A7C15)
_BASE = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits; a bijection."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=U) * _STEP)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Also what else is in ASCII neither letter nor digit: words without punctuation.
SPACE_AND_MARKS = SPACE.copy()
SPACE_AND_MARKS[[i for i in range(128) if not chr(i).isalnum()]] = True


@dataclass
class Words:
    """Words of a slice of texts. first[d]:first[d + 1] are the words of text d; start and end are byte places in data."""

    at: int
    texts: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), self.counts())


def _slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def words(column: pa.Array, fold: bool = False, limit: int = SLICE_BYTES, gaps: np.ndarray = SPACE) -> Iterator[Words]:
    """The words of every text, slice by slice; null texts have none. fold: hash A-Z as a-z."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, raw = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    for a, b in _slices(offsets, limit):
        lo, hi = int(offsets[a]), int(offsets[b])
        data, cuts = whole[lo:hi], offsets[a : b + 1] - lo
        solid = ~gaps[data]
        edge = np.empty(len(data) + 1, dtype=bool)  # a text begins here
        edge[:] = False
        edge[cuts] = True
        before = np.empty(len(data), dtype=bool)
        if len(data):
            before[0] = False
            before[1:] = solid[:-1]
        start = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.empty(len(data), dtype=bool)
        if len(data):
            after[-1] = False
            after[:-1] = solid[1:]
        end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        first = np.searchsorted(start, cuts, side="left")
        yield Words(a, b - a, data, start, end, first, _hashes(data, start, end, fold))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    out = np.zeros(len(start), dtype=U)
    size = end - start
    power = np.full(int(size.max(initial=1)), _BASE, dtype=U)
    power[0] = 1
    np.cumprod(power, out=power)
    # Some words at a time: a byte takes about 40 meanwhile.
    for a, b in _slices(np.concatenate([[0], np.cumsum(size)]), _HASHED):
        n = size[a:b]
        heads = np.cumsum(n) - n
        inside = np.arange(n.sum()) - np.repeat(heads, n)
        value = (_FOLDED if fold else _VALUES)[data[inside + np.repeat(start[a:b], n)]] * power[inside]
        out[a:b] = np.add.reduceat(value, heads)
    return mix(out + size.astype(U) * _STEP)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words, over text borders too; len(hashes) - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = np.full(n, U(k), dtype=U)
    for j in range(k):
        out = out * _BASE + hashes[j : j + n]
    return mix(out)


def numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each word; equal ones only for words of equal bytes, whatever the hashes do."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    size = end - start
    same = first[number]
    wrong = size != size[same]
    for lo in range(0, len(start), _AT_ONCE):
        n = np.where(wrong[lo : lo + _AT_ONCE], 0, size[lo : lo + _AT_ONCE])
        heads = np.cumsum(n) - n
        inside = np.arange(n.sum()) - np.repeat(heads, n)
        unlike = data[inside + np.repeat(start[lo : lo + _AT_ONCE], n)] != data[inside + np.repeat(start[same[lo : lo + _AT_ONCE]], n)]
        wrong[lo + np.repeat(np.arange(len(n)), n)[unlike]] = True
    if wrong.any():  # words of one hash
        names: dict[bytes, int] = {}
        number = np.array([names.setdefault(data[a:b].tobytes(), len(names)) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return number.astype(np.int32)


def windows(number: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A name for each window of `width` numbers that begins at one of these places; equal ones only for equal windows."""
    seed = 0
    while True:
        name = runs(mix(number.astype(U) + U(seed)), width)[at] if len(at) else np.zeros(0, U)
        order = np.argsort(name, kind="stable")
        same = np.flatnonzero(name[order][1:] == name[order][:-1])
        for k in range(width):
            if (number[at[order[same]] + k] != number[at[order[same + 1]] + k]).any():
                break
        else:
            return name
        seed += 1 << 32


def planes(values: np.ndarray) -> bytes:
    """Bytes of integers, byte planes apart, so that a shuffle's compression finds the high zero bytes."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(blob: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    flat = np.frombuffer(blob, dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(flat.T).reshape(-1).view(dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as byte planes of their differences."""
    out = values.copy()
    out[1:] = values[1:] - values[:-1]
    return planes(out)


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob, U), dtype=U)
