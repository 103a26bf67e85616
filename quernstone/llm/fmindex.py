"""FM-index over a shard of words: wavelet-matrix ranks, backward search, sampled suffix positions. All array-wise."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling; the last symbol must be smaller than all others and occur once."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype("int64")
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        second = np.full(n, -1, "int64")
        second[: n - width] = rank[width:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, "int64")
        fresh[order] = np.cumsum(np.concatenate(([0], sorted_key[1:] != sorted_key[:-1])))
        rank = fresh
        if rank[order[-1]] == n - 1 or width >= n:
            return order
        width *= 2


class WaveletMatrix:
    """Ranks over a sequence of small integers: bits from the highest on, zeros first at each level."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        level = sequence
        for b in range(bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype("int32"))
            self.zeros.append(len(level) - int(self.ones[-1][-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        # where the block of each symbol begins at the last level
        self.starts = np.searchsorted(self._order(level), np.arange(1 << bits))
        self.reverse = np.array([int(f"{s:0{bits}b}"[::-1], 2) for s in range(1 << bits)])

    def _order(self, last: np.ndarray) -> np.ndarray:
        return np.array([int(f"{s:0{self.bits}b}"[::-1], 2) for s in range(1 << self.bits)])[last]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        for ones, zeros, b in zip(self.ones, self.zeros, range(self.bits - 1, -1, -1)):
            up = ones[at]
            at = np.where((symbol >> b) & 1, zeros + up, at - up)
        return at - self.starts[self.reverse[symbol]]


class FMIndex:
    """Index of a sequence of symbols >= 1."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        text = np.concatenate((symbols.astype("int64"), [0]))
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.wavelet = WaveletMatrix(self.bwt, max(1, int(n_symbols).bit_length()))
        counts = np.bincount(text, minlength=n_symbols + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))[:-1]
        marked = order % sample == 0
        self.sampled = np.concatenate(([0], np.cumsum(marked)))
        self.marked, self.positions = marked, order[marked]
        self.n = len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of phrases of one length (rows of symbols), from the last word to the first."""
        low, high = np.zeros(len(phrases), "int64"), np.full(len(phrases), self.n, "int64")
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, k]
            low = self.first[symbol] + self.wavelet.rank(symbol, low)
            high = self.first[symbol] + self.wavelet.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: step back by LF until a sampled one."""
        at, steps, out = at.astype("int64"), np.zeros(len(at), "int64"), np.full(len(at), -1, "int64")
        left = np.arange(len(at))
        while len(left):
            here = at[left]
            hit = self.marked[here]
            done = left[hit]
            out[done] = self.positions[self.sampled[at[done]]] + steps[done]
            left = left[~hit]
            symbol = self.bwt[at[left]]
            at[left] = self.first[symbol] + self.wavelet.rank(symbol, at[left])
            steps[left] += 1
        return out
