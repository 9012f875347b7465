"""An FM-index over an integer sequence: suffix order, Burrows-Wheeler transform, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` in lexical order. The last symbol must be the only 0.

    The first round packs as many symbols as fit in 62 bits; each later round doubles what is compared, and only suffixes that are
    still tied are sorted again.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length()) if n else 1
    span = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(span):
        key <<= bits
        if k < n:
            key[: n - k] |= text[k:]
    order = np.argsort(key, kind="stable")
    ranks, tied = _ranks(key[order], np.zeros(n, np.int64), order, np.arange(n))
    rank = np.empty(n, np.int64)
    rank[order] = ranks
    at = np.flatnonzero(tied)
    while len(at):
        who = order[at]
        after = who + span
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        group = rank[who]
        by = np.lexsort((follow, group))
        who, follow, group = who[by], follow[by], group[by]
        order[at] = who
        first = np.r_[True, group[1:] != group[:-1]]
        new = first | np.r_[True, follow[1:] != follow[:-1]]
        place = np.arange(len(who))
        new_rank = group + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        rank[who] = new_rank
        alone = new & np.r_[new[1:], True]
        at = at[~alone]
        span *= 2
    return order


def _ranks(keys: np.ndarray, base: np.ndarray, order: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.r_[True, keys[1:] != keys[:-1]]
    return np.maximum.accumulate(np.where(new, place, 0)), ~(new & np.r_[new[1:], True])


class Bits:
    """A bit vector with rank in a fixed number of steps: packed words and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, bool)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])
        self.zeros = n - int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """Wavelet matrix: one bit vector for each bit of the symbols, from the highest."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels: list[tuple[int, Bits]] = []
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1 == 1
            self.levels.append((bit, Bits(ones)))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each place."""
        at = [np.zeros(len(symbol), np.int64), *places]
        for bit, level in self.levels:
            one = (symbol >> bit) & 1 == 1
            at = [np.where(one, level.zeros + r, p - r) for p in at for r in [level.rank(p)]]
        return [p - at[0] for p in at[1:]]

    def step(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        symbol, start, at = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), place
        for bit, level in self.levels:
            one = level.get(at) == 1
            symbol |= one.astype(np.int64) << bit
            start, at = (np.where(one, level.zeros + level.rank(p), p - level.rank(p)) for p in (start, at))
        return symbol, at - start


class FmIndex:
    """Backward search and location in a sequence of symbols from 1 to ``top``; a 0 is added as its end."""

    def __init__(self, symbols: np.ndarray, top: int, sample: int = 8):
        text = np.append(symbols, 0).astype(np.int64)
        order = suffix_order(text)
        bwt = text[order - 1]
        self.n, self.sample = len(text), sample
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.wavelet = Wavelet(bwt, top)
        sampled = order % sample == 0
        self.marked, self.positions = Bits(sampled), order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``patterns`` the range of suffixes that begin with it, found from its last symbol to its first."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            symbol = patterns[live, k]
            a, b = self.wavelet.rank(symbol, low[live], high[live])
            low[live], high[live] = self.first[symbol] + a, self.first[symbol] + b
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of rows of the suffix order: steps back to the next sampled place."""
        out, rows, who, steps = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(rows):
            hit = self.marked.get(rows) == 1
            out[who[hit]] = self.positions[self.marked.rank(rows[hit])] + steps
            rows, who, steps = rows[~hit], who[~hit], steps + 1
            if len(rows):
                symbol, before = self.wavelet.step(rows)
                rows = self.first[symbol] + before
        return out
