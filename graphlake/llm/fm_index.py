"""An FM-index over a sequence of symbols: suffix order, Burrows-Wheeler transform, wavelet matrix, samples."""

from __future__ import annotations

import numpy as np

#: Every so many positions the suffix position itself is kept.
SAMPLE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling. Symbol 0 parts runs: each 0 differs from all others, so that
    comparisons end with a run."""
    n = len(text)
    parts = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(parts)
    rank[parts] = np.arange(len(parts))
    k = 0
    while True:
        if k == 0:
            key = rank
        else:
            key = rank * (n + int(text.max(initial=0)) + 2)
            key[: n - k] += rank[k:] + 1
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.concatenate([np.zeros(1, np.int64), np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        k = max(1, 2 * k)


class FMIndex:
    """text: symbols, runs of symbols > 0 that each end with a 0."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.n, self.bits = len(text), max(1, (symbols - 1).bit_length())
        order = suffix_order(text)
        self.bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.bits))])  # rows before each symbol's
        sampled = order % SAMPLE == 0
        sampled |= self.bwt == 0  # a run's start, so that no walk to the left leaves its run
        self.sampled, self.sample_at, self.positions = sampled, np.cumsum(sampled) - 1, order[sampled]
        self.zeros, self.levels = [], []
        x = self.bwt
        for level in range(self.bits - 1, -1, -1):
            bit = ((x >> level) & 1).astype(bool)
            ones = np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)])
            self.levels.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            x = np.concatenate([x[~bit], x[bit]])
        self.origin = self._descend(np.arange(1 << self.bits), np.zeros(1 << self.bits, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = ones[at].astype(np.int64)
            at = np.where((symbol >> (self.bits - 1 - i)) & 1, zeros + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before the row ``at``."""
        return self._descend(symbol, at) - self.origin[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases at once: the rows [lo, hi) of each. phrases: right-aligned."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        live = np.arange(len(phrases))
        for step in range(width):
            live = live[hi[live] > lo[live]]
            go = live[lengths[live] > step]
            if not len(go):
                break
            s = phrases[go, width - 1 - step]
            lo[go] = self.first[s] + self.rank(s, lo[go])
            hi[go] = self.first[s] + self.rank(s, hi[go])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row: steps to the left until a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[at])
        while len(todo):
            s = self.bwt[at[todo]]
            at[todo] = self.first[s] + self.rank(s, at[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[at[todo]]]
        return self.positions[self.sample_at[at]] + steps
