"""Whole Arrow batches of texts as numpy arrays: words, their hashes, windows of them.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. All functions work on the UTF-8 bytes, so no text becomes a Python string.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    h = (h ^ (h >> _U(30))) * _M2
    h = (h ^ (h >> _U(27))) * _M3
    return h ^ (h >> _U(31))


class Texts:
    """The texts of one Arrow array: ``buf`` bytes, ``off`` n+1 offsets; null is empty."""

    def __init__(self, array: pa.Array):
        if isinstance(array, pa.ChunkedArray):
            array = array.combine_chunks()
        if array.null_count:
            array = pc.fill_null(array, "")
        self.n = len(array)
        if not self.n:
            self.buf, self.off = np.zeros(0, np.uint8), np.zeros(1, np.int64)
            return
        wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
        _, off, data = array.buffers()
        kind = np.int64 if wide else np.int32
        off = np.frombuffer(off, kind)[array.offset : array.offset + self.n + 1].astype(np.int64)
        buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.buf, self.off = buf[off[0] : off[-1]], off - off[0]

    def words(self, space: np.ndarray = _SPACE) -> Words:
        return Words(self, space)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each text has."""
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[self.off])


class Words:
    """Words of all texts in order: byte ``start`` and ``end``; those of text i are ``first[i]:first[i+1]``."""

    def __init__(self, texts: Texts, space: np.ndarray = _SPACE):
        self.texts = texts
        buf, off = texts.buf, texts.off
        inside = ~space[buf]
        begin, last = inside.copy(), inside.copy()
        if len(buf):
            cut = np.zeros(len(buf) + 1, bool)
            cut[off] = True
            begin[1:] &= ~inside[:-1] | cut[1:-1]
            last[:-1] &= ~inside[1:] | cut[1:-1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, off)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.count)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hash_spans(self.texts.buf, self.start, self.end, seed)


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes a step over all spans at once."""
    size = (end - start).astype(np.uint64)
    out = mix(size * _M1 + _U(seed))
    if not len(out):
        return out
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    live, at = None, start
    left = size.astype(np.int64)
    while True:
        x = eight[at]
        short = left < 8
        if short.any():
            bits = (np.maximum(left[short], 0) * 8).astype(np.uint64)
            x[short] &= (_U(1) << bits) - _U(1)
        if live is None:
            out = mix(out ^ x)
        else:
            out[live] = mix(out[live] ^ x)
        more = left > 8
        if not more.any():
            return out
        live = np.flatnonzero(more) if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8


_BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)  # odd, so they have inverses modulo 2**64
_power_table: dict[int, list[np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    table = _power_table.setdefault(base, [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    if len(table[0]) < n:
        for k, factor in enumerate((base, pow(base, -1, 1 << 64))):
            grown = np.full(n, factor, np.uint64)
            grown[0] = 1
            table[k] = np.cumprod(grown, dtype=np.uint64)
    return table[0][:n], table[1][:n]


def windows(words: Words, hashes: np.ndarray, width: int, block: int = 1 << 18, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all ``width``-word windows within a text, and the word index where each starts.

    Blocks overlap by ``width - 1`` words, so the power tables stay small for texts of any length. ``family`` picks
    one of two bases: their hashes of a window are independent, given those of its words.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    fits = np.ones(n, bool)
    ends = words.first[1:]
    for back in range(1, width):
        at = ends - back
        fits[at[at >= words.first[:-1]]] = False
    at = np.flatnonzero(fits)
    out = np.empty(n - width + 1, np.uint64)
    for lo in range(0, n - width + 1, block):
        hi = min(lo + block, n - width + 1)
        m = hi - lo + width
        up, down = _powers(m, _BASES[family])
        total = np.zeros(m, np.uint64)
        np.cumsum(hashes[lo : hi + width - 1] * down[: m - 1], out=total[1:])
        out[lo:hi] = (total[width:] - total[: hi - lo]) * up[: hi - lo]
    return mix(out[at]), at


def slices(batches: Iterator[pa.RecordBatch], column: str | int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most_bytes`` of ``column``, texts, binaries or lists of integers, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column(column)
        size = np.asarray(pc.fill_null(pc.list_value_length(own) if pa.types.is_list(own.type) else pc.binary_length(own), 0), np.int64) * (4 if pa.types.is_list(own.type) else 1)
        total = np.cumsum(size)
        lo = 0
        while lo < len(size):
            base = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, base + most_bytes, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _return_large() -> None:
    """Blocks of 1 MB and more go back to the system as soon as they are freed; else a worker keeps the peak of each stage beside the next one's."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)
    except (AttributeError, OSError):  # another C library than glibc
        return


_return_large()


def let_go() -> None:
    """Give memory that a finished task no longer uses back to the system: workers live on, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc keeps its own counsel
        return
