"""FM-index over a sequence of integer symbols: suffix order, wavelet matrix, backward search, sampled locations.

Symbol 0 ends a phrase.  It never occurs in a pattern, so no search and no walk crosses it.
All steps are vectorised over patterns and rows.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in lexicographic order; every 0 is a symbol of its own.

    Prefix doubling that sorts only the suffixes still tied with another one.
    """
    n = len(text)
    ends = text == 0
    first = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()))
    order = np.argsort(first, kind="stable")
    slot = np.arange(n)
    head = np.ones(n + 1, dtype=bool)
    head[1:n] = first[order][1:] != first[order][:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head[:n], slot, 0))
    step = 1
    while True:
        tied = np.flatnonzero(~(head[:-1] & head[1:]))
        if not len(tied):
            return order
        who = order[tied]
        group = rank[who]
        tail = np.where(who + step < n, rank[np.minimum(who + step, n - 1)], -1)
        by = np.lexsort((tail, group))
        who, group, tail = who[by], group[by], tail[by]
        order[tied] = who
        fresh = np.ones(len(tied), dtype=bool)
        fresh[1:] = (group[1:] != group[:-1]) | (tail[1:] != tail[:-1])
        head[tied] = fresh
        rank[who] = np.maximum.accumulate(np.where(fresh, tied, 0))
        step *= 2


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)).astype(np.int64) & 1


class Wavelet:
    """Wavelet matrix: rank and access of any symbol in one step per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = []
        for level in reversed(range(max(1, int(alphabet - 1).bit_length()))):
            bit = (symbols >> level) & 1
            self.levels.append((level, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        low, high = np.zeros(len(at), dtype=np.int64), at.astype(np.int64)
        for level, bits, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def get(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.int64)
        for level, bits, zeros in self.levels:
            bit, ones = bits.get(at), bits.rank(at)
            out |= bit << level
            at = np.where(bit == 1, zeros + ones, at - ones)
        return out


class FMIndex:
    """Counts and locates phrases in `text`, whose phrases each end with a 0."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = 8):
        order = suffix_order(text)
        last = text[order - 1]  # the 0 at the end of the text precedes its start
        self.size = len(text)
        self.wavelet = Wavelet(last, alphabet)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet))))
        # every `sample`-th position and every phrase start is kept: a walk back ends before it leaves the phrase
        kept = (order % sample == 0) | (last == 0)
        self.kept = Bits(kept.astype(np.uint8))
        self.positions = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that start with each row of `patterns` (equal lengths)."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.size, dtype=np.int64)
        for column in reversed(range(patterns.shape[1])):
            alive = np.flatnonzero(low < high)
            if not len(alive):
                break
            symbol = patterns[alive, column]
            base = self.before[symbol]
            low[alive] = base + self.wavelet.rank(symbol, low[alive])
            high[alive] = base + self.wavelet.rank(symbol, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a kept position."""
        rows = rows.astype(np.int64)
        out = np.zeros(len(rows), dtype=np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            at = rows[todo]
            found = self.kept.get(at) == 1
            out[todo[found]] = self.positions[self.kept.rank(at[found])] + steps
            todo, at = todo[~found], at[~found]
            symbol = self.wavelet.get(at)
            rows[todo] = self.before[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return out
