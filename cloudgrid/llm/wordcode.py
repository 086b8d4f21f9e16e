"""Vectorised words, hashes and hash tables over Arrow text columns.

Nothing here knows Spark.  A text column is taken as its UTF-8 bytes; both word
rules used by the operators are decided by single bytes below 0x80, so words are
found with one table lookup per byte and hashed with prefix sums.
Texts go through in slices of whole rows (``slices``), so memory is bounded by
``SLICE_BYTES`` or the longest single text, whichever is larger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U = np.uint64
_P = U(0x9E3779B97F4A7C15 | 1)
_Q = U(0xD6E8FEB86659FD93)
_GOLD = U(0x9E3779B97F4A7C15)


def mix(x):
    """64-bit finaliser (splitmix64), a bijection."""
    x = np.asarray(x, dtype=U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=U) * _GOLD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]

#: bytes of words: not ASCII white space / letters, digits and everything beyond ASCII
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers = {"n": 0}


def _pow(n: int):
    """Powers of _P and of its inverse, grown on demand."""
    if _powers["n"] < n:
        m = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        inv = U(pow(int(_P), -1, 1 << 64))
        with np.errstate(over="ignore"):
            p = np.full(m, _P, dtype=U)
            q = np.full(m, inv, dtype=U)
            p[0] = q[0] = U(1)
            np.multiply.accumulate(p, out=p)
            np.multiply.accumulate(q, out=q)
        if m > 8 * SLICE_BYTES:  # one very long text: don't keep
            return p, q
        _powers.update(n=m, p=p, q=q)
    return _powers["p"], _powers["q"]


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("")
    large = pa.types.is_large_string(col.type)
    if not large and not pa.types.is_string(col.type):
        col, large = col.cast(pa.large_string()), True
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    o = np.frombuffer(off, dtype=np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def slices(offsets: np.ndarray, most: int | None = None):
    """Ranges of rows of at most ``most`` bytes, or of one row."""
    most, i, n = most or SLICE_BYTES, 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


class Words:
    """Words of consecutive texts: ``start``/``end`` (bytes), ``bounds`` (text i has words bounds[i]..bounds[i+1]), ``h`` (64-bit hashes)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray = NON_SPACE, lower: bool = False, hashes: bool = True):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = member[data]
        first, last = inside.copy(), inside.copy()
        if n:
            cut = offsets[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
            before = inside[:-1].copy()
            after = inside[1:].copy()
            before[cut - 1] = False
            after[cut - 1] = False
            first[1:] &= ~before
            last[:-1] &= ~after
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets, side="left")
        if len(self.bounds):
            self.bounds[-1] = len(self.start)
        if hashes:
            self.h = self._hash(_BYTE_LOWER if lower else _BYTE)

    def _hash(self, table):
        if not len(self.start):
            return np.zeros(0, U)
        p, q = _pow(len(self.data) + 1)
        with np.errstate(over="ignore"):
            s = np.zeros(len(self.data) + 1, U)
            np.cumsum(table[self.data] * p[: len(self.data)], out=s[1:])
            return mix((s[self.end] - s[self.start]) * q[self.start] + (self.end - self.start).astype(U))

    @property
    def text(self):
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of the k consecutive items from each position (len - k + 1 of them); texts' borders are the caller's."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        a = h[:n] + U(seed)
        for j in range(1, k):
            a = a * _Q + h[j : j + n]
    return mix(a)


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the items start..end, of any lengths."""
    p, q = _pow(len(h) + 1)
    with np.errstate(over="ignore"):
        s = np.zeros(len(h) + 1, U)
        np.cumsum(mix(h + U(5)) * p[: len(h)], out=s[1:])
        return mix((s[end] - s[start]) * q[start] + (end - start).astype(U))


def gram_starts(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the ``n - k + 1`` positions have k items in one text."""
    m = n - k + 1
    if m <= 0:
        return np.zeros(0, bool)
    ok = np.zeros(n + 1, np.int32)
    b, e = bounds[:-1], np.maximum(bounds[1:] - k + 1, bounds[:-1])
    np.add.at(ok, b, 1)
    np.add.at(ok, e, -1)
    return np.cumsum(ok[:m]) > 0


def counts_between(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` in bounds[i]..bounds[i+1]."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]


def cover(starts: np.ndarray, lengths, n: int) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + lengths, -1)
    return np.cumsum(d[:n]) > 0


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


class Table:
    """Open-addressing map from non-zero 64-bit hashes to int64, looked up and grown in whole arrays."""

    def __init__(self, room: int = 1 << 12):
        self.n = 0
        self._make(room)

    def _make(self, room: int):
        self.bits = max(8, int(room * 1.6).bit_length())
        self.keys = np.zeros(1 << self.bits, U)
        self.vals = np.zeros(1 << self.bits, np.int64)

    def _slot(self, h):
        return (h >> U(64 - self.bits)).astype(np.int64)

    def get(self, h: np.ndarray, missing: int = -1) -> np.ndarray:
        h = np.where(h == 0, U(1), h)
        out = np.full(len(h), missing, np.int64)
        at, todo, mask = self._slot(h), np.arange(len(h)), (1 << self.bits) - 1
        while len(todo):
            k = self.keys[at]
            hit = k == h[todo]
            out[todo[hit]] = self.vals[at[hit]]
            more = ~hit & (k != 0)
            todo, at = todo[more], (at[more] + 1) & mask
        return out

    def put(self, h: np.ndarray, v: np.ndarray):
        """Adds distinct keys that are not in it."""
        if self.n + len(h) > (1 << self.bits) * 0.62:
            old = self.keys != 0
            k, w = self.keys[old], self.vals[old]
            self._make(int((self.n + len(h)) * 1.5))
            self.n = 0
            self.put(k, w)
        h = np.where(h == 0, U(1), h)
        self.n += len(h)
        at, todo, mask = self._slot(h), np.arange(len(h)), (1 << self.bits) - 1
        while len(todo):
            free = self.keys[at] == 0
            _, one = np.unique(at[free], return_index=True)
            win = np.flatnonzero(free)[one]
            self.keys[at[win]] = h[todo[win]]
            self.vals[at[win]] = v[todo[win]]
            rest = np.ones(len(todo), bool)
            rest[win] = False
            todo, at = todo[rest], (at[rest] + 1) & mask


class Bloom:
    """Blocked Bloom filter read from bytes: all bits of a key lie in one block of ``BLOCK_BITS`` bits; a key may have levels."""

    BLOCK_BITS = 1 << 18

    def __init__(self, data: np.ndarray, blocks: int, k: int):
        self.data, self.blocks, self.k = data, blocks, k

    @classmethod
    def block(cls, h: np.ndarray, blocks: int) -> np.ndarray:
        return ((h >> U(32)) * U(blocks) >> U(32)).astype(np.int64)

    @classmethod
    def bit(cls, h: np.ndarray, level, i: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = mix(h + (np.asarray(level).astype(U) * U(2) + U(1)) * _GOLD)
            return (((x >> U(33)) + U(i) * ((x & U(0x7FFFFFFF)) | U(1))) & U(cls.BLOCK_BITS - 1)).astype(np.int64)

    def has(self, h: np.ndarray, level=0) -> np.ndarray:
        if not self.blocks or not len(h):
            return np.zeros(len(h), bool)
        base = self.block(h, self.blocks) * (self.BLOCK_BITS // 8)
        ok = np.ones(len(h), bool)
        for i in range(self.k):
            b = self.bit(h, level, i)
            ok &= (self.data[base + (b >> 3)] >> (b & 7).astype(np.uint8) & 1).astype(bool)
        return ok

    def level(self, h: np.ndarray, most: int = 400) -> np.ndarray:
        """The number of consecutive levels from 1 that are members."""
        out, alive = np.zeros(len(h), np.int64), np.arange(len(h))
        for j in range(1, most + 1):
            if not len(alive):
                break
            alive = alive[self.has(h[alive], j)]
            out[alive] = j
        return out


def i64(x: np.ndarray) -> pa.Array:
    """Hashes as signed Arrow longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def u64(col) -> np.ndarray:
    """Hashes from an Arrow long column."""
    return col.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(U)
