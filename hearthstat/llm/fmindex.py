"""An FM-index over sequences of small integers: backward search through a wavelet matrix, sampled positions.

Symbol 0 separates sequences and is never searched for. Each separator counts as
different from the others, so no comparison runs past one, and the suffix order
(and with it the walk back to a sampled position) is a strict one.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """Rank and access over a sequence of integers below 2 ** depth, one bit vector to a binary digit."""

    def __init__(self, values: np.ndarray, depth: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(depth - 1, -1, -1):
            ones = (values >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(ones), len(values) - int(ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])
        self.starts = self._down(np.arange(1 << depth), np.zeros(1 << depth, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbols >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._down(symbols, at) - self.starts[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        symbols = np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            symbols |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return symbols, at - self.starts[symbols]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the sorted suffixes of a text that ends in a separator, by doubling what is still tied."""
    n = len(text)
    gaps = text == 0
    first = np.where(gaps, np.cumsum(gaps) - 1, text.astype(np.int64) + int(gaps.sum()))
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)
    tied, keys, step = np.arange(n), first[order], 1
    while len(tied):
        new = np.ones(len(tied), bool)
        new[1:] = keys[1:] != keys[:-1]
        rank[order[tied]] = tied[np.flatnonzero(new)][np.cumsum(new) - 1]
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        at = order[tied]
        keys = rank[at] * n + rank[at + step]
        by = np.argsort(keys, kind="stable")
        order[tied], keys = at[by], keys[by]
        step *= 2
    return order


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, every: int = 8):
        """`text`: symbols 1 to `symbols`, with a 0 first, between sequences and last."""
        order = suffix_order(text)
        self.n = len(text)
        counts = np.bincount(text, minlength=symbols + 1)
        self.less = np.concatenate([[0], np.cumsum(counts)])
        last = text[order - 1]
        self.turned = Wavelet(last.astype(np.int64), max(1, int(symbols).bit_length()))
        # A walk back must not pass a separator: what follows one is always sampled.
        sampled = (order % every == 0) | (last == 0)
        self.sampled, self.positions = Bits(sampled), order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols (padded with -1 on the left) its range among the sorted suffixes."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbols = patterns[live, column].astype(np.int64)
            live, symbols = live[symbols > 0], symbols[symbols > 0]
            base = self.less[symbols]
            low[live] = base + self.turned.rank(symbols, low[live])
            high[live] = base + self.turned.rank(symbols, high[live])
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these ranks start."""
        at = at.copy()
        steps = np.zeros(len(at), np.int64)
        todo = np.flatnonzero(~self.sampled.get(at))
        while len(todo):
            symbols, rank = self.turned.access(at[todo])
            at[todo] = self.less[symbols] + rank
            steps[todo] += 1
            todo = todo[~self.sampled.get(at[todo])]
        return self.positions[self.sampled.rank(at)] + steps
