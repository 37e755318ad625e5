"""An FM-index over integer symbols: suffix array by doubling, wavelet matrix with rank tables, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``symbols``; a zero is a separator, and an earlier separator is smaller than a later one.

    Ranks by 1, 2, 4, ... symbols: each round sorts one number for each suffix, its rank and that of the suffix so many symbols further on.
    """
    n = len(symbols)
    zero = symbols == 0
    rank = np.where(zero, np.cumsum(zero), symbols.astype(np.int64) + int(zero.sum()))  # from 1; 0 is the end
    step = 1
    while True:
        key = rank.astype(np.uint64) << _U(32)
        if step < n:
            key[:-step] |= rank[step:].astype(np.uint64)
        order = np.argsort(key)
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[1], 1 + np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank, step = fresh, step * 2
        if step >= 2 * n or int(rank[order[-1]]) == n:
            return order


class FMIndex:
    """Of a text made of runs of symbols 1.., each run followed by one 0. ``sample``: a position in so many is kept, and each run's first."""

    def __init__(self, symbols: np.ndarray, sample: int = 16):
        n = len(symbols)
        sa = suffix_array(symbols)
        now = symbols[sa - 1].astype(np.uint32)
        self.n, self.size = n, int(symbols.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=self.size))])
        self.levels, self.zeros = [], []
        bits = max(1, (self.size - 1).bit_length())
        self.shifts = list(range(bits - 1, -1, -1))
        for shift in self.shifts:
            bit = ((now >> np.uint32(shift)) & np.uint32(1)).astype(bool)
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(n - int(ones[-1]))
            now = np.concatenate([now[~bit], now[bit]])
        starts = np.ones(n, bool)
        starts[1:] = symbols[:-1] == 0
        keep = starts | (np.arange(n) % sample == 0)
        self.kept = keep[sa]
        self.kept_rank = np.concatenate([[0], np.cumsum(self.kept)])
        self.places = sa[self.kept]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place ``at`` of the transformed text."""
        lo, hi = np.zeros_like(at), at
        for ones, zeros, shift in zip(self.levels, self.zeros, self.shifts, strict=True):
            bit = ((symbol >> shift) & 1).astype(bool)
            l1, h1 = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + l1, lo - l1), np.where(bit, zeros + h1, hi - h1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros, shift in zip(self.levels, self.zeros, self.shifts, strict=True):
            bit = ones[at + 1] - ones[at]
            out |= bit.astype(out.dtype) << shift
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each row of ``patterns``, a matrix whose rows are aligned to the right; empty where a symbol isn't in the text."""
        width = patterns.shape[1]
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(width - 1, -1, -1):
            on = np.flatnonzero((lengths > width - 1 - k) & (lo < hi))
            if not len(on):
                continue
            c = patterns[on, k]
            known = (c > 0) & (c < self.size)
            hi[on[~known]] = lo[on[~known]]
            on, c = on[known], c[known]
            lo[on], hi[on] = self.before[c] + self.rank(c, lo[on]), self.before[c] + self.rank(c, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions in the text of suffixes ``at``: steps back until a sampled one."""
        at, steps, out = at.copy(), 0, np.full(len(at), -1, np.int64)
        todo = np.arange(len(at))
        while len(todo):
            done = self.kept[at[todo]]
            hit = todo[done]
            out[hit] = self.places[self.kept_rank[at[hit]]] + steps
            todo = todo[~done]
            c = self.access(at[todo])
            at[todo] = self.before[c] + self.rank(c, at[todo])
            steps += 1
        return out
