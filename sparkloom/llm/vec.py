"""Vectorised text kernels over Arrow string buffers: words, word hashes and shingle hashes of a whole batch at once.

Texts stay UTF-8 bytes in one buffer; nothing here makes a Python string for each row.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Bytes of text handled at a time, so that the arrays stay near the caches; a longer document is taken alone.
SLICE_BYTES = 1_000_000
_U = np.uint64


def _own_memory() -> None:
    """For a Python worker, before it reads its first batch: it lives on from stage to stage, so let arrays beyond 4 MB be mapped, and thus go back to the system when they are freed.

    Smaller ones are made and freed over and over; mapping each would cost more than the work on it.
    """
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 22)  # M_MMAP_THRESHOLD, which then stays as it is
        libc.mallopt(-1, 1 << 26)  # M_TRIM_THRESHOLD
        libc.mallopt(-8, 2)  # M_ARENA_MAX
    except AttributeError:  # not glibc
        return
    pa.set_memory_pool(pa.system_memory_pool())


if TaskContext.get() is not None:
    _own_memory()


def trim() -> None:
    """Give freed memory back to the system; in workers only, the driver's memory is its own."""
    if TaskContext.get() is None:
        return
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    trim()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def table(members: bytes | np.ndarray) -> np.ndarray:
    """Boolean table of 256 entries."""
    out = np.zeros(256, bool)
    out[np.frombuffer(bytes(members), np.uint8)] = True
    return out


#: Word bytes of the two word rules: all but ASCII white space; or digits, ASCII letters and bytes beyond ASCII.
NOT_SPACE = ~table(b" \t\n\x0b\x0c\r")
ALNUM = table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64)  # one value for each byte
_BASE = _U(0xD6E8FEB86659FD93)
_INV = _U(pow(int(_BASE), -1, 2**64))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE_BYTES + 64, 1 << (int(n) + 64).bit_length() if n > SLICE_BYTES else 0)
    return _powers(size)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


class Words:
    """Words of rows lo..hi: byte bounds ``start``/``end`` in the slice, ``first`` word of each row, 64-bit hash of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: np.ndarray = LOWER):
        base = int(offsets[0])
        raw = data[base : int(offsets[-1])]
        self.rows = offsets - base
        n = len(raw)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = is_word[raw]
        edge = inside[1:] != inside[:-1]
        cut = self.rows[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        starts, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        joined = cut[inside[cut] & inside[cut + 1]]  # a word may not run on into the next row
        starts[joined] = True
        ends[joined] = True
        del edge
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends)
        up, down = powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[lower[raw]] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + _U(_ODD) * (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, self.rows)
        self.raw = raw

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid): hash of the ``width`` words from each word on; valid where they lie in one row."""
        return shingles(self.hash, self.first, width)


    def rows_of(self, keep: np.ndarray) -> Words:
        """The words of the rows numbered ``keep`` alone: hashes and first words."""
        sizes = np.diff(self.first)[keep]
        out = Words.__new__(Words)
        out.hash = self.hash[spread(self.first[:-1][keep], sizes)]
        out.first = np.concatenate([[0], np.cumsum(sizes)])
        return out

    def without(self, gone: np.ndarray) -> Words:
        """The words that a mask leaves, row by row."""
        out = Words.__new__(Words)
        out.hash = self.hash[~gone]
        out.first = np.concatenate([[0], np.cumsum(~gone)])[self.first]
        return out


def spread(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run of ``sizes`` places, one run after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - sizes), sizes) + np.arange(total)


def passages(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, valid) of the ``width`` words from each word on, at a cost that doesn't grow with ``width``: differences of a running sum."""
    n = len(h)
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=total[1:])
    stop = np.minimum(np.arange(n) + width, n)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return mix((total[stop] - total[:-1]) * down[:n]), left >= width


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(h)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        out[: n - k] += h[k:] * _U((_ODD * (2 * k + 3) ** 3) % 2**64 | 1)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return mix(out), left >= width


def whole(h: np.ndarray) -> np.uint64:
    """Hash of a short sequence of words, kept apart from that of full shingles by its length."""
    with np.errstate(over="ignore"):
        out = _U(len(h))
        for x in h:
            out = mix(np.array([out * _U(_ODD) + x], np.uint64))[0]
    return out


def distinct(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): for each row the sorted distinct shingle hashes; fewer words than ``width`` make one shingle, none an empty set."""
    h, _ = words.shingles(width)
    first, sizes = words.first, np.diff(words.first)
    for r in np.flatnonzero((sizes > 0) & (sizes < width)):
        h[first[r]] = whole(words.hash[first[r] : first[r + 1]])
    count = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    row, x = np.repeat(np.arange(len(sizes)), count), h[spread(first[:-1], count)]
    bits = _U(len(sizes).bit_length())
    packed = (row.astype(np.uint64) << (_U(64) - bits)) | (x >> bits)  # sorts by row and the hash's first bits
    order = np.argsort(packed)
    packed, y = packed[order], x[order]
    equal = y[1:] == y[:-1]
    close = packed[1:] == packed[:-1]
    if (close & ~equal).any():  # hashes that differ in their last bits only
        order = np.lexsort((x, row))
        y = x[order]
        equal, close = y[1:] == y[:-1], row[order][1:] == row[order][:-1]
    keep = np.concatenate([[True], ~(equal & close)])[: len(y)]
    return y[keep], np.concatenate([[0], np.cumsum(np.bincount(row[order][keep], minlength=len(sizes)))])


def sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """The rows of ``distinct``."""
    flat, offsets = distinct(words, width)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield flat[a:b]


def set_keys(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's set, whatever its order, as two columns of longs."""
    keys = []
    for x in (mix(flat + _U(0x1234567)), mix(flat ^ _U(0xA5A5A5A5A5A5A5A5))):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        keys.append(total[offsets[1:]] - total[offsets[:-1]])
    keys[1] += np.diff(offsets).astype(np.uint64)
    return signed(keys[0]), signed(keys[1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """list<int64> of the rows of a flat array of 64 bits."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(flat.view(np.int64), pa.int64()))
