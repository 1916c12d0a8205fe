"""An FM-index over a sequence of small integers, in numpy.

The suffix array comes from prefix doubling that keeps sorting only the groups still tied; the Burrows-Wheeler transform is held in a
wavelet tree of bit vectors with a rank directory per 64 bits; text positions are kept for every ``step``-th position and found from
elsewhere by walking back with the LF mapping. All searches are batched: many patterns move through one step at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes; the last symbol must be unique and the smallest."""
    n = len(text)
    if n <= 1:
        return np.arange(n)
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # a group's rank is the place of its first member
    width = 1
    last = np.r_[first[1:], True]
    places = np.nonzero(~(first & last))[0]  # places in the order whose group has several members
    while len(places):
        at = order[places]
        head = rank[at]
        ahead = at + width
        key = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        sort = np.lexsort((key, head))
        at, head, key = at[sort], head[sort], key[sort]
        order[places] = at  # places are in order of group, and so is the sort
        new = np.r_[True, (head[1:] != head[:-1]) | (key[1:] != key[:-1])]
        fresh = np.maximum.accumulate(np.where(new, places, 0))
        rank[at] = fresh
        alone = new & np.r_[new[1:], True]
        places = places[~alone]
        width *= 2
    return order


class Bits:
    """A bit vector with rank: 64-bit words and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))]

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones in the first i bits."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletTree:
    """Levels of a wavelet matrix: at each level the symbols are split by one bit, zeros first, in stable order."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(depth - 1, -1, -1):
            bits = (symbols >> shift) & 1
            self.levels.append((shift, Bits(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` in the first i symbols."""
        start = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            a, b = bits.rank1(start), bits.rank1(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def get(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i and their ranks there."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            bit = bits.get(i)
            symbol |= bit << shift
            a, b = bits.rank1(start), bits.rank1(i)
            start, i = np.where(bit == 1, zeros + a, start - a), np.where(bit == 1, zeros + b, i - b)
        return symbol, i - start


class FMIndex:
    """Index of ``text``, integers >= 1; 0 is added as the end. ``size`` bounds the symbols."""

    def __init__(self, text: np.ndarray, size: int, step: int = 8):
        self.step, self.size = step, size
        full = np.r_[text.astype(np.int64), 0]
        order = suffix_array(full)
        bwt = full[order - 1]
        self.tree = WaveletTree(bwt, max(1, int(size).bit_length()))
        self.starts = np.r_[0, np.cumsum(np.bincount(full, minlength=size + 1))]
        sampled = order % step == 0
        self.sampled = Bits(sampled.astype(np.uint8))
        self.positions = order[sampled]
        self.n = len(full)

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``patterns`` (equal lengths), the half-open range of suffixes that begin with it; empty where none does."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            live = np.nonzero(low < high)[0]
            if not len(live):
                break
            symbol = patterns[live, column].astype(np.int64)
            start = self.starts[symbol]
            low[live], high[live] = start + self.tree.rank(symbol, low[live]), start + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of places in the suffix order, by walking back to a sampled one."""
        at, steps, out = rows.astype(np.int64).copy(), 0, np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.sampled.get(at) == 1
            done = todo[hit]
            out[done] = self.positions[self.sampled.rank1(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            symbol, rank = self.tree.get(at)
            at = self.starts[symbol] + rank
            steps += 1
        return out
