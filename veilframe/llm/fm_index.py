"""FM-index over a sequence of small integers: wavelet-matrix ranks, sampled suffix positions, all in numpy.

Symbol 0 separates runs and is never searched for.  Searches and look-ups take arrays and step all their
entries together.
"""

from __future__ import annotations

import numpy as np

#: every so many positions of the text one suffix position is kept
SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; separators count as different, in order of position."""
    n = len(text)
    separators = text == 0
    rank = text.astype(np.int64) + int(separators.sum())
    rank[separators] = np.arange(int(separators.sum()))
    step = 1
    while True:
        key = rank * np.int64(n + int(rank.max()) + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.diff(sorted_, prepend=sorted_[:1]) != 0)
        if not n or new[order[-1]] == n - 1:
            return order
        rank, step = new, step * 2
        if step >= n:
            return order


class WaveletMatrix:
    """Ranks and access for symbols of ``bits`` bits; a prefix sum of ones for each level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.ones, self.zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(np.int32)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``end``."""
        start, end = np.zeros_like(end), end
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = self.ones[k][start], self.ones[k][end]
            start = np.where(one, self.zeros[k] + a, start - a)
            end = np.where(one, self.zeros[k] + b, end - b)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for k in range(self.bits):
            before = self.ones[k][at]
            one = self.ones[k][at + 1] - before
            symbol = symbol << 1 | one
            at = np.where(one == 1, self.zeros[k] + before, at - before)
        return symbol


class FMIndex:
    def __init__(self, text: np.ndarray):
        """``text`` ends with the separator 0."""
        n = len(text)
        order = suffix_array(text)
        self.n = n
        bits = max(1, int(text.max()).bit_length())
        self.bwt = WaveletMatrix(text[order - 1], bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        after_separator = np.ones(n, bool)
        after_separator[1:] = text[:-1] == 0  # walks never cross a separator
        sampled = after_separator[order] | (order % SAMPLE == 0)
        self.sampled = sampled
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges (low, high) of patterns of one length, one in each row of ``patterns``; symbols are positive."""
        m = len(patterns)
        low, high = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            fits = c < len(self.first) - 1
            high[live[~fits]] = low[live[~fits]] = 0
            live, c = live[fits], c[fits]
            low[live] = self.first[c] + self.bwt.rank(c, low[live])
            high[live] = self.first[c] + self.bwt.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to the nearest sampled one."""
        out, steps, live, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.astype(np.int64)
        while len(live):
            done = self.sampled[at]
            out[live[done]] = self.samples[self.sample_rank[at[done]]] + steps
            live, at = live[~done], at[~done]
            c = self.bwt.access(at)
            at = self.first[c] + self.bwt.rank(c, at)
            steps += 1
        return out
