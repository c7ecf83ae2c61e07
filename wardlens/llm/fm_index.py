"""FM-index over a shard of word sequences: wavelet tree in bit-packed levels, batched backward search.

Small helper of ``substrings``: a shard is bounded, Spark makes and deals out the shards.
"""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Rank queries on a sequence of symbols below ``sigma``: one packed bit per symbol and level.

    Each level sorts the symbols stably by one bit, so a symbol's positions lie together after the last level.
    """

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1 == 1
            padded = np.zeros(-(-(len(ones) + 1) // 64) * 64, bool)
            padded[: len(ones)] = ones
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            zeros = len(ones) - int(ones.sum())
            self.levels.append((np.uint64(bit), words, before.astype(np.uint32), zeros))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.start = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.uint64)
        for bit, words, before, zeros in self.levels:
            word = at >> 6
            low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(words[word] & low)
            at = np.where((symbols >> bit) & np.uint64(1), zeros + ones, at - ones).astype(np.int64)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the position beside it."""
        return self._descend(symbols, at) - self.start[symbols]


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the ``depth`` or more symbols that start there, by doubling; 0 follows the end."""
    rank, known = symbols.astype(np.int64), 1
    while True:
        ahead = np.zeros_like(rank)
        if known < len(rank):
            ahead[:-known] = rank[known:]
        key = rank * (int(rank.max()) + 1) + ahead
        order = np.argsort(key, kind="stable")
        known *= 2
        if known >= depth:
            return order
        sorted_key = key[order]
        steps = np.zeros(len(rank), np.int64)
        np.cumsum(sorted_key[1:] != sorted_key[:-1], out=steps[1:])
        rank = np.empty_like(rank)
        rank[order] = steps


class Index:
    """Index of sequences for matches of up to ``depth`` symbols; symbols are 1 and above, 0 ends a sequence, also the last."""

    def __init__(self, text: np.ndarray, depth: int):
        order = suffix_order(text, depth)
        sigma = int(text.max()) + 1
        self.order = order
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.tree = WaveletTree(text[order - 1], sigma)  # the symbol before each suffix

    def matching(self, text: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of indexed text: longest match to the left of each end, up to ``depth`` symbols, that
        occurs elsewhere too, with its rows (from, to) of the suffix order."""
        length = np.zeros(len(ends), np.int64)
        low, high = self.first[text[ends]], self.first[text[ends] + 1]
        alive = np.flatnonzero(high - low > 1)
        length[alive] = 1
        for back in range(1, depth):
            symbols = text[ends[alive] - back]
            both = self.tree.rank(np.concatenate([symbols, symbols]), np.concatenate([low[alive], high[alive]]))
            start = self.first[symbols]
            new_low, new_high = start + both[: len(alive)], start + both[len(alive) :]
            more = (new_high - new_low > 1) & (symbols > 0)
            alive = alive[more]
            low[alive], high[alive] = new_low[more], new_high[more]
            length[alive] += 1
        return length, low, high
