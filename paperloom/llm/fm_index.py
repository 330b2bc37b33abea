"""An FM-index over integer symbols, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank over a sequence of symbols in bit vectors: one bit a symbol and level, with a running count for each 64 bits."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = []
        rest = sequence
        for b in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            bit = (rest >> b & 1).astype(bool)
            packed = np.zeros(len(bit) // 64 * 8 + 8, np.uint8)
            small = np.packbits(bit, bitorder="little")
            packed[: len(small)] = small
            words = packed.view(np.uint64)
            before = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((b, words, before, int(len(bit) - bit.sum())))
            rest = np.concatenate((rest[~bit], rest[bit]))
        every = np.arange(symbols, dtype=np.int32)
        self.zero = self._mapped(every, np.zeros(symbols, np.int64))

    def _mapped(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, words, before, zeros in self.levels:
            at = i >> 6
            ones = before[at] + np.bitwise_count(words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where(symbol >> b & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the first i places."""
        return self._mapped(symbol, i) - self.zero[symbol]


class FMIndex:
    """Index of texts of symbols (1 and up; 0 ends each text), right for patterns of up to depth symbols.

    Suffixes are sorted by their first depth symbols, which is all that
    backward search of such patterns looks at.
    """

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        n = len(text)
        rank, step = text.astype(np.int64), 1
        while step < depth:
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
            by = np.argsort(key, kind="stable")
            new = np.concatenate(([0], np.cumsum(np.diff(key[by]) != 0)))
            rank = np.empty(n, np.int64)
            rank[by] = new
            step *= 2
        self.suffix = np.argsort(rank, kind="stable")
        self.last = WaveletMatrix(text[self.suffix - 1].astype(np.int32), symbols)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))

    def ranges(self, patterns: np.ndarray, present: bool) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the rows of patterns by backward search; none is lo >= hi. Where every pattern is present, a search ends as soon as its range is one suffix."""
        c = patterns[:, -1]
        known = c > 0
        lo, hi = np.where(known, self.below[c], 0), np.where(known, self.below[c + 1], 0)
        for k in range(patterns.shape[1] - 2, -1, -1):
            live = np.flatnonzero(hi - lo > int(present))
            if not len(live):
                break
            c = patterns[live, k]
            both = self.last.rank(np.concatenate((c, c)), np.concatenate((lo[live], hi[live]))) + np.concatenate((self.below[c], self.below[c]))
            known = c > 0
            lo[live], hi[live] = np.where(known, both[: len(live)], 0), np.where(known, both[len(live) :], 0)
        return lo, hi
