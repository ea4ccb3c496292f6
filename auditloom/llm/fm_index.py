"""An FM-index over word symbols: suffix array, wavelet matrix, backward search of many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; a suffix that ends is smaller than one that goes on."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[:max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit a level; ``rank`` works on whole arrays of queries."""

    def __init__(self, values: np.ndarray, top: int) -> None:
        self.bits = max(1, int(top).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        #: Where the run of each symbol begins in the last level.
        everything = np.arange(top + 1)
        self.begin = self._follow(everything, np.zeros(top + 1, np.int64))

    def _follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ones[at]
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + up, at - up)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] occurs before position at[i]."""
        return self._follow(symbol, at) - self.begin[symbol]


class FMIndex:
    """Symbols are 0 to ``top``; 0 separates stretches and is in no pattern."""

    def __init__(self, symbols: np.ndarray, top: int, sample: int = 8) -> None:
        symbols = np.append(symbols, 0)
        order = suffix_array(symbols)
        # The Burrows-Wheeler transform: what stands before each suffix, before the first a mark of its own.
        self.last = np.where(order > 0, symbols[order - 1], top + 1)
        self.wavelet = WaveletMatrix(self.last, top + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        marked = order % sample == 0
        self.marked = marked
        self.slot = np.cumsum(marked) - 1
        self.sampled = order[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern, read from its last symbol."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.last), np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            alive = np.flatnonzero((lengths >= back) & (low < high))
            if not len(alive):
                break
            symbol = patterns[alive, lengths[alive] - back]
            low[alive] = self.before[symbol] + self.wavelet.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.wavelet.rank(symbol, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back through the text until a sampled position."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.marked[rows[todo]]
            found = todo[hit]
            out[found] = self.sampled[self.slot[rows[found]]] + steps[found]
            todo = todo[~hit]
            symbol = self.last[rows[todo]]
            # The closing separator stands before no suffix and comes first among the separators.
            rows[todo] = self.before[symbol] + (symbol == 0) + self.wavelet.rank(symbol, rows[todo])
            steps[todo] += 1
        return out
