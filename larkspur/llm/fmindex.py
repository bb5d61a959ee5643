"""A compressed FM-index over the words of short texts, and matching statistics of those texts in it."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(16 - len(packed) % 8), np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)].astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """Ranks of symbols, level by level of their bits (highest first)."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.levels, self.depth = [], depth
        most = int(symbols.max()) + 1
        for level in range(depth - 1, -1, -1):
            bits = (symbols >> level & 1).astype(np.uint8)
            self.levels.append(Bits(bits))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.start = self._down(np.arange(most), np.zeros(most, np.int64))  # of each symbol on the lowest level

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.depth - 1, -1, -1), self.levels):
            ones = bits.rank(at)
            at = np.where((symbol >> level & 1).astype(bool), bits.zeros + ones, at - ones)
        return at

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before ``low`` and before ``high``."""
        low, high = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high])).reshape(2, -1) - self.start[symbol]
        return low, high


class FMIndex:
    """Over texts (arrays of word numbers from 1), each ended by 0; ``span`` words (2 or more) are looked for at a time.

    Suffixes are sorted by their first ``span`` symbols, which is as far as such a search can see.
    """

    def __init__(self, texts: list[np.ndarray], weights: np.ndarray, span: int):
        self.span = span
        lengths = np.array([len(x) for x in texts])
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(int(ends[-1]) + 1, np.int64)
        text[np.delete(np.arange(len(text)), ends)] = np.concatenate(texts)
        n = len(text)

        def pair(rank: np.ndarray, ahead: np.ndarray, by: int) -> np.ndarray:
            key = rank * (n + 1)
            key[: n - by] += ahead[by:] + 1
            return key

        def ranked(key: np.ndarray) -> np.ndarray:
            order = np.argsort(key)
            ahead = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, ahead[1:] != ahead[:-1]])
            return rank

        ranks, width = {1: text}, 1  # by doubling; then two that overlap
        while 2 * width <= span:
            ranks[2 * width] = ranked(pair(ranks[width], ranks[width], width))
            width *= 2
        suffixes = np.argsort(pair(ranks[width], ranks[width], span - width) if span > width else ranks[width])
        # intervals of suffixes that share one word less than the span: what is left of a match without its last word
        shared, same, at = span - 1, np.ones(n - 1, bool), 0
        for width in sorted(ranks, reverse=True):
            if shared - at >= width:
                part = np.r_[ranks[width], np.full(span, -1)][suffixes + at]
                same &= part[1:] == part[:-1]
                at += width
        edges = np.flatnonzero(np.r_[True, ~same, True])
        group = np.cumsum(np.r_[0, ~same])
        self.low, self.high = edges[:-1][group], edges[1:][group]
        self.first = np.r_[0, np.cumsum(np.bincount(text))]
        self.tree = WaveletTree(text[suffixes - 1], max(1, int(text.max()).bit_length()))
        owner = np.repeat(np.arange(len(texts)), lengths + 1)
        self.weight = np.r_[0, np.cumsum(weights[owner[suffixes]])]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes that start with the symbol and go on within [low, high)."""
        low, high = self.tree.ranks(symbol, low, high)
        return self.first[symbol] + low, self.first[symbol] + high

    def occurrences(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """For each text and each place in it where ``span`` words begin: the weight of all places that match them.

        All texts are streamed from their ends at once. A match loses its last word by widening its interval, and
        takes in the word before it by one step of backward search.
        """
        span, lengths = self.span, np.array([len(x) for x in texts])
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        flat = np.concatenate(texts).astype(np.int64)
        windows = lengths - span + 1
        out = np.zeros(int(windows.sum()), np.int64)
        into = np.r_[0, np.cumsum(windows)[:-1]]
        low, high = np.zeros(len(texts), np.int64), np.full(len(texts), len(self.low), np.int64)
        for step in range(int(lengths.max())):
            live = np.flatnonzero(step < lengths)
            if step >= span:
                some = low[live]
                low[live], high[live] = self.low[some], self.high[some]
            low[live], high[live] = self.extend(flat[starts[live] + lengths[live] - 1 - step], low[live], high[live])
            if step >= span - 1:
                out[into[live] + lengths[live] - 1 - step] = self.weight[high[live]] - self.weight[low[live]]
        return np.split(out, into[1:])
