"""A compressed FM-index over integer symbols: Burrows-Wheeler transform in a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = bits
        self.blocks = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks))[:-1]]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.blocks[block] & ((np.uint64(1) << bit) - np.uint64(1)))


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first `depth` symbols at least (prefix doubling)."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.zeros(n, np.int64)
    rank[order[1:]] = np.cumsum(text[order[1:]] != text[order[:-1]])
    k = 1
    while k < depth and n and rank[order[-1]] < n - 1:
        follow = np.zeros(n, np.int64)
        if k < n:
            follow[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        k *= 2
    return order


class FMIndex:
    """Index of a text of symbols 0..sigma-1 for patterns of up to `depth` symbols.

    The text ends with a 0 and no pattern holds one, so no match runs over the text's end.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.suffixes = sorted_suffixes(text, depth + 1).astype(np.int32)
        sigma = int(text.max(initial=0)) + 1
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        seq = text[self.suffixes - 1]  # the symbol before each suffix, in suffix order
        self.levels: list[tuple[int, Bits, int]] = []
        for level in range(max(1, sigma.bit_length()) - 1, -1, -1):
            bit = (seq >> level) & 1
            self.levels.append((level, Bits(bit.astype(np.uint8)), len(seq) - int(bit.sum())))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.base = self.down(np.arange(sigma), np.zeros(sigma, np.int64))

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Follow places down the wavelet matrix along each symbol's bits."""
        for level, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> level) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.down(symbol, at) - self.base[symbol]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of `symbol` before what the intervals held."""
        begin = self.less[symbol]
        return begin + self.rank(symbol, low), begin + self.rank(symbol, high)

    def statistics(self, ends: np.ndarray, text: np.ndarray, most: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: for the text read up to each end (exclusive), how many of its last `most`
        symbols occur together at `least` places or more, and the interval of that match."""
        n = len(ends)
        low, high, length = np.zeros(n, np.int64), np.full(n, len(self.suffixes), np.int64), np.zeros(n, np.int64)
        live = np.arange(n)
        for step in range(1, most + 1):
            live = live[ends[live] >= step]
            a, b = self.extend(text[ends[live] - step], low[live], high[live])
            fits = b - a >= least
            live = live[fits]
            low[live], high[live], length[live] = a[fits], b[fits], step
        return length, low, high

    def first(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The earliest place in the text that each interval holds."""
        if not len(low):
            return np.zeros(0, np.int64)
        own, back = np.unique(low * (len(self.suffixes) + 1) + high, return_inverse=True)
        pairs = np.stack([own // (len(self.suffixes) + 1), own % (len(self.suffixes) + 1)], axis=1).ravel()
        return np.minimum.reduceat(np.append(self.suffixes, np.iinfo(np.int32).max), pairs)[::2][back].astype(np.int64)
