"""Words of whole texts and their hashes, vectorised over a batch's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from corpuskit.llm.encoding import utf8

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def byte_table(separators: bytes) -> np.ndarray:
    """Byte to its lower-cased form (A-Z only), separators to 0.  Byte 0, when
    it is no separator, becomes 255, which UTF-8 never holds."""
    lut = np.arange(256, dtype=np.uint8)
    lut[0x41:0x5B] += 0x20
    lut[0] = 255
    lut[np.frombuffer(separators, np.uint8)] = 0
    return lut


WHITE = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
ALNUM = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


class Words:
    """Words of a batch: bytes ``low[start[i]:end[i]]``; text t has the words
    ``first[t]:first[t + 1]``."""

    def __init__(self, column: pa.Array, lut: np.ndarray):
        raw, off = utf8(column)
        self.low = lut[raw]
        inside = self.low != 0
        n = len(raw)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        after = np.zeros(n + 1, bool)
        after[:-1] = inside
        self.start = np.flatnonzero(after & (~before | edge))
        self.end = np.flatnonzero(before & (~after | edge))
        self.first = np.searchsorted(self.start, off)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        at = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        with np.errstate(over="ignore"):
            value = self.low[self._inside] * _powers(_BASE, int(size.max()))[place]
            return mix(np.add.reduceat(value, at) + size.astype(np.uint64) * _STEP)

    def text(self, lo: int, hi: int) -> str:
        """Words lo..hi-1, one space between."""
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist())).decode()


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (the caller keeps within a text)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total, factor = np.zeros(n, np.uint64), np.uint64(1)
        for i in range(k):
            total += hashes[i:i + n] * factor
            factor = factor * _STEP
        return mix(total)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the (rightmost) least value in every window of ``width``."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, place = values[:n].copy(), np.arange(n)
    for i in range(1, width):
        later = values[i:i + n]
        take = later <= least
        least = np.where(take, later, least)
        place[take] = np.flatnonzero(take) + i
    return place
