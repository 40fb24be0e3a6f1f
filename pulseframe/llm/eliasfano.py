"""Elias-Fano sequences over NumPy arrays: monotone integers in about
2 + log2(universe / n) bits each, with vectorised access and successor search.

An element's low ``l`` bits stand in a packed bit array; its high part is the
number of zeros before the element's one bit in a unary bit vector. A running
count of ones per 64-bit word serves both select directions.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Position of the k-th set bit of every byte.
_SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


def encode(values: np.ndarray, universe_bits: int) -> dict[str, np.ndarray]:
    """Arrays of the sequence; ``values`` are sorted unsigned 64-bit integers."""
    n = len(values)
    low_bits = max(0, universe_bits - max(int(n).bit_length() - 1, 0)) if n else 0
    high = (values >> _U(low_bits)).astype(np.int64) if low_bits < 64 else np.zeros(n, np.int64)
    at = high + np.arange(n)
    words = np.zeros((int(at[-1]) + 64 if n else 64) // 64 + 1, np.uint64)
    np.add.at(words, at >> 6, _U(1) << (at & 63).astype(np.uint64))  # bits of their own: a sum is a union
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    low = np.zeros((n * low_bits) // 64 + 2, np.uint64)
    if n and low_bits:
        v = values & _U((1 << low_bits) - 1) if low_bits < 64 else values
        bit = np.arange(n, dtype=np.int64) * low_bits
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        np.add.at(low, word, v << off)
        over = np.flatnonzero(off.astype(np.int64) + low_bits > 64)
        np.add.at(low, word[over] + 1, v[over] >> (_U(64) - off[over]))
    return {"meta": np.array([n, low_bits], np.int64), "high": words, "ones": ones, "low": low}


class Sequence:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.low_bits = (int(x) for x in arrays["meta"])
        self.high, self.ones, self.low = arrays["high"], arrays["ones"], arrays["low"]

    def _select(self, k: np.ndarray, of_ones: bool) -> np.ndarray:
        """Bit position of the k-th one (or zero), counted from 0."""
        before = self.ones if of_ones else np.arange(len(self.ones)) * 64 - self.ones
        word = np.searchsorted(before, k, "right") - 1
        word = np.minimum(word, len(self.high) - 1)
        rest = k - before[word]
        bits = self.high[word] if of_ones else ~self.high[word]
        at = word * 64
        for width in (32, 16, 8):
            part = np.bitwise_count(bits & _U((1 << width) - 1)).astype(np.int64)
            skip = rest >= part
            rest = np.where(skip, rest - part, rest)
            bits = np.where(skip, bits >> _U(width), bits)
            at = at + np.where(skip, width, 0)
        return at + _SELECT[(bits & _U(255)).astype(np.int64), np.minimum(rest, 7)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        out = self.low[word] >> off
        spill = np.flatnonzero(off.astype(np.int64) + self.low_bits > 64)
        out[spill] |= self.low[word[spill] + 1] << (_U(64) - off[spill])
        return out & _U((1 << self.low_bits) - 1) if self.low_bits < 64 else out

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th elements."""
        if not len(i):
            return np.zeros(0, np.uint64)
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << _U(self.low_bits) if self.low_bits < 64 else high * _U(0)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element not below each value (n if none)."""
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value, or -1: its successor, where that has the same
        high part and the same low bits."""
        at, found = self._search(x)
        return np.where(found, at, -1)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The successor's index, and whether the successor is the value."""
        x = x.astype(np.uint64)
        if not self.n or not len(x):
            return np.full(len(x), self.n), np.zeros(len(x), bool)
        high = (x >> _U(self.low_bits)).astype(np.int64) if self.low_bits < 64 else np.zeros(len(x), np.int64)
        zeros = len(self.high) * 64 - int(self.ones[-1])
        past = high >= zeros
        h = np.minimum(high, zeros - 1)
        # Elements of a high part stand between its zero and the one before.
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) + 1 - h, 0)
        hi = self._select(h, False) - h
        lo, hi = np.minimum(lo, self.n), np.minimum(hi, self.n)
        want = x & _U((1 << self.low_bits) - 1) if self.low_bits < 64 else x
        end = hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        found = np.zeros(len(x), bool)
        same = np.flatnonzero((lo < end) & ~past)
        found[same] = self._low(lo[same]) == want[same]
        return np.where(past, self.n, np.minimum(lo, end)), found
