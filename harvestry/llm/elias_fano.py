"""Elias-Fano coding of monotone sequences in numpy arrays that can be memory-mapped."""

from __future__ import annotations

from functools import cached_property

import numpy as np

HALVES = tuple(np.uint64(w) for w in (32, 16, 8, 4, 2, 1))


def _place(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th one bit (from 0) of each 64-bit word, by halving."""
    place, r = np.zeros(len(words), np.int64), r.astype(np.uint8)
    for w in HALVES:
        low = words & ((np.uint64(1) << w) - np.uint64(1))
        count = np.bitwise_count(low)
        beyond = r >= count
        r = r - count * beyond
        words = np.where(beyond, words >> w, low)
        place += int(w) * beyond
    return place


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays that hold ascending values below universe: low bits packed, high parts in unary, zeros counted before each word."""
    n = len(values)
    values = values.astype(np.uint64)
    low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    length = n + (universe >> low_bits) + 1
    bits = np.zeros(-(-length // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    packed = np.packbits(bits, bitorder="little")
    zeros = 64 - np.bitwise_count(packed.view(np.uint64)).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(zeros)])
    low = np.zeros(n * low_bits // 64 + 2, np.uint64)
    if low_bits and n:
        at = np.arange(n, dtype=np.int64) * low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        part = values & np.uint64((1 << low_bits) - 1)
        _or_at(low, word, part << shift)
        spill = shift + np.uint64(low_bits) > np.uint64(64)
        _or_at(low, word[spill] + 1, part[spill] >> (np.uint64(64) - shift[spill]))
    return {"meta": np.array([n, low_bits, universe], np.int64), "low": low, "high": packed, "zeros": before.astype(np.uint32 if before[-1] < 1 << 32 else np.uint64)}


def _or_at(out: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """Sets bits at words that ascend and may repeat."""
    if len(at):
        first = np.flatnonzero(np.diff(at, prepend=-1))
        out[at[first]] |= np.bitwise_or.reduceat(bits, first)


class Sequence:
    """Queries many positions or values of a coded sequence at once."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.low_bits, self.universe = (int(x) for x in arrays["meta"])
        self.low, self.high, self.zeros = arrays["low"], arrays["high"].view(np.uint64), arrays["zeros"]

    @cached_property
    def ones(self) -> np.ndarray:
        """Ones before each word."""
        return np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros.astype(np.int64)

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero of the high part, from 0."""
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), "right") - 1
        return (word << 6) + _place(~self.high[word], k - self.zeros[word].astype(np.int64))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> shift
        over = np.flatnonzero(shift > 64 - self.low_bits)
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        out &= np.uint64((1 << self.low_bits) - 1)
        return out

    def rank(self, targets: np.ndarray) -> np.ndarray:
        """How many values are smaller than each target (0 to universe): the index of its successor."""
        return self._search(targets.astype(np.int64))[0]

    def _search(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Successors, and where the targets' buckets end: before it the values have the target's high part."""
        bucket = targets >> self.low_bits
        begin = np.where(bucket > 0, self._select0(np.maximum(bucket - 1, 0)) - bucket + 1, 0)
        last = end = self._select0(bucket) - bucket
        end = end.copy()
        want = targets.astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(begin < end)
        while len(open_):  # bisects the bucket's low parts
            middle = (begin[open_] + end[open_]) >> 1
            less = self._lows(middle) < want[open_]
            begin[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
            open_ = open_[begin[open_] < end[open_]]
        return begin, last

    def find(self, targets: np.ndarray) -> np.ndarray:
        """The index of each target, or -1."""
        if not self.n:
            return np.full(len(targets), -1)
        targets = targets.astype(np.int64)
        i, end = self._search(targets)
        same = np.flatnonzero(i < end)  # the successor is in the target's bucket
        same = same[self._lows(i[same]) == targets[same].astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)]
        out = np.full(len(targets), -1)
        out[same] = i[same]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at positions: the i-th one bit, found by bisecting the words' counts of ones."""
        word = np.searchsorted(self.ones, i, "right") - 1
        at = (word << 6) + _place(self.high[word], i - self.ones[word])
        return ((at - i) << self.low_bits) + self._lows(i).astype(np.int64)
