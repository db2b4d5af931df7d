"""Vectorised words, word hashes and hashes of word windows over Arrow text columns.

A word is a maximal run of bytes other than ASCII white space. A null text is treated as an empty one. All arithmetic is
modulo 2**64: a word's hash is a difference of prefix sums of ``table[byte] * base**i``, brought to a common power and
scrambled, so that no Python code runs for a single byte or word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 18
#: Powers are remembered up to so many.
KEPT_POWERS = 1 << 22
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n at least; base is odd."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        m = max(n, SLICE_BYTES + 64)
        known = tuple(np.cumprod(np.append(U64(1), np.full(m - 1, b, np.uint64))) for b in (base, pow(base, -1, 1 << 64)))
        if m <= KEPT_POWERS:
            _powers[base] = known
    return known[0][:n], known[1][:n]


@dataclass
class Words:
    """Words of some consecutive rows: row first+d has the words word_at[d] to word_at[d+1] and the bytes at[d] to at[d+1] of data."""

    first: int
    rows: int
    data: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_at: np.ndarray
    hashes: np.ndarray

    def prefix(self, base: int = _BASE2) -> np.ndarray:
        """Prefix sums of the word hashes, for :meth:`grams`."""
        out = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(self.hashes * powers(base, len(self.hashes))[0], out=out[1:])
        return out

    def grams(self, k: int, base: int = _BASE2) -> np.ndarray:
        """Hashes of k consecutive words from each word on; meaningless where :meth:`whole` is false."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        p = self.prefix(base)
        return mix((p[k:] - p[:-k]) * powers(base, n)[1])

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.word_at))

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in one row, for the first len-k+1 words."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, bool)
        end = np.repeat(self.word_at[1:], np.diff(self.word_at))
        return np.arange(n) + k <= end[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary array; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def split_rows(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def _hashed(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beginnings, ends and hashes of the words of rows that begin at ``at``."""
    ink = np.zeros(len(data) + 1, bool)
    np.logical_not(_SPACE[data], out=ink[:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begin = ink[:-1].copy()
    begin[1:] &= ~ink[:-2] | edge[1:-1]
    final = ink[:-1] & (~ink[1:] | edge[1:])
    starts, ends = np.flatnonzero(begin), np.flatnonzero(final) + 1
    power, inverse = powers(_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * inverse[starts])


def _blocks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of a long text that end at white space."""
    a, most = 0, SLICE_BYTES
    while a < len(data):
        b = min(a + most, len(data))
        if b < len(data):
            space = np.flatnonzero(_SPACE[data[a:b]])
            if not len(space):
                most *= 2
                continue
            b = a + int(space[-1]) + 1
        yield a, b
        a, most = b, SLICE_BYTES


def words_of(column: pa.Array) -> Iterator[Words]:
    """The words of a text column, in slices of rows. A text longer than a slice is hashed block by block."""
    offsets, raw = text_buffers(column)
    for a, b in split_rows(offsets):
        lo, hi = offsets[a], offsets[b]
        data, at = raw[lo:hi], offsets[a : b + 1] - lo
        if len(data) <= 2 * SLICE_BYTES:
            starts, ends, hashes = _hashed(data, at)
        else:
            parts = [(x, *_hashed(data[x:z], np.array([0, z - x]))) for x, z in _blocks(data)]
            starts, ends, hashes = (np.concatenate(p) for p in zip(*((x + s, x + e, h) for x, s, e, h in parts), strict=True))
        yield Words(a, b - a, data, at, starts, ends, np.searchsorted(starts, at), hashes)


def sliding(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over each w consecutive values, by doubling."""
    if len(x) < w:
        return x[:0]
    out, have = x, 1
    while have * 2 <= w:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])
