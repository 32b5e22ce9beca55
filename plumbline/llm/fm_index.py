"""An FM-index over a sequence of small integers: wavelet-tree ranks and sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class WaveletTree:
    """Ranks of any symbol before any place, by one row of bit counts for each bit of a symbol."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(before), before
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            a, b = ones[low], ones[high]
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return high - low

    def at(self, place: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        out = np.zeros_like(place)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            before = ones[place]
            bit = ones[place + 1] - before
            out = out * 2 + bit
            place = np.where(bit, zeros + before, place - before)
        return out


class FMIndex:
    """Count and locate patterns in ``text``, whose symbols are 0 to ``symbols - 1``."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8):
        text, symbols = np.append(text + 1, 0), symbols + 1  # one end, below all symbols
        order = suffix_array(text)
        last = text[order - 1]
        self.tree = WaveletTree(last, symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)
        self.size = len(text)
        marked = order % sample == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.samples = order[marked]

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each pattern; the patterns stand at the right of their rows."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        live = np.flatnonzero(length > 0)
        for step in range(patterns.shape[1]):
            live = live[(length[live] > step) & (high[live] > low[live])]
            if not len(live):
                break
            symbol = patterns[live, patterns.shape[1] - 1 - step] + 1
            low[live] = self.smaller[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to the nearest sampled one."""
        out, steps = np.full(len(places), -1, np.int64), np.zeros(len(places), np.int64)
        todo, at = np.arange(len(places)), places.copy()
        while len(todo):
            here = at[todo]
            sampled = self.marks[here + 1] > self.marks[here]
            done = todo[sampled]
            out[done] = self.samples[self.marks[at[done]]] + steps[done]
            todo = todo[~sampled]
            here = at[todo]
            symbol = self.tree.at(here)
            at[todo] = self.smaller[symbol] + self.tree.rank(symbol, here)
            steps[todo] += 1
        return out
