"""A compressed FM-index over sequences of whole numbers, searched for many patterns at once.

The Burrows-Wheeler transform is kept in a wavelet tree whose shape is that of Shannon's code: each level is a row of
bits with a count every 64, so the text takes about its entropy, and a rank as many steps as its symbol's code has
bits. Besides, the index knows which neighbours in suffix order agree in fewer than each number
of symbols up to a threshold; that lets a match drop symbols at its right end.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of Shannon's codes for symbols that occur so often: the binary logarithm of how rare each is, rounded up, 1 at least; 0 for absent ones."""
    rarity = counts.sum() / np.maximum(counts, 1)
    return np.where(counts > 0, np.maximum(1, np.ceil(np.log2(np.maximum(rarity, 1)))), 0).astype(np.int64)


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes of those lengths, by length and then symbol, none a prefix of another."""
    codes, deepest = np.zeros(len(lengths), np.int64), int(lengths.max(initial=0))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    room = np.int64(1) << (deepest - lengths[order])
    codes[order] = (np.cumsum(room) - room) >> (deepest - lengths[order])
    return codes


class Bits:
    """A row of bits, packed, with the ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.append(bits, np.zeros(64 - len(bits) % 64, bool)), bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word = at >> 6
        kept = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(kept)


class WaveletTree:
    """Ranks of symbols in a text. Each level has the bits of its nodes side by side."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.lengths = code_lengths(np.bincount(text, minlength=symbols))
        self.codes = canonical_codes(self.lengths)
        self.levels: list[tuple[Bits, np.ndarray, np.ndarray]] = []
        row = text
        for depth in range(int(self.lengths.max(initial=0))):
            head = self.codes >> np.maximum(self.lengths - depth, 0)  # of each symbol: its node
            row = row[self.lengths[row] > depth]
            row = row[np.argsort(head[row], kind="stable")]
            bits = Bits((self.codes[row] >> (self.lengths[row] - depth - 1) & 1).astype(bool))
            starts = np.searchsorted(head[row], head).astype(np.int32)
            self.levels.append((bits, starts, bits.ones(starts.astype(np.int64)).astype(np.int32)))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol, which must occur in the text, stands before each place."""
        out, lengths, lanes = at.astype(np.int64), self.lengths[symbols], None
        for depth, (bits, starts, before) in enumerate(self.levels):
            short = lengths > depth
            if not short.all():
                lanes = np.flatnonzero(short) if lanes is None else lanes[short]
                symbols, lengths = symbols[short], lengths[short]
            place = out if lanes is None else out[lanes]
            ones = bits.ones(starts[symbols] + place) - before[symbols]
            place = np.where(self.codes[symbols] >> (lengths - depth - 1) & 1, ones, place - ones)
            if lanes is None:
                out = place
            else:
                out[lanes] = place
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order; symbols are at least 0. The ranks of prefixes double in length until all differ."""
    n = len(text)
    width = int(text.max(initial=0) + 2).bit_length()
    taken = max(1, min(4, 62 // width))
    padded = np.append(text.astype(np.int64) + 1, np.zeros(taken, np.int64))
    key = np.zeros(n, np.int64)
    for k in range(taken):
        key = key << width | padded[k : n + k]
    while True:
        order = np.argsort(key)
        ranked = key[order]
        ranks = np.empty(n, np.int64)
        ranks[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]])) if n else 0
        if not n or ranks[order[-1]] == n - 1:
            return order
        further = np.zeros(n, np.int64)
        further[: max(0, n - taken)] = ranks[taken:] + 1
        key, taken = ranks * (n + 1) + further, 2 * taken


class FMIndex:
    """Index of sequences of symbols above 0, of which matches of up to ``threshold`` symbols are wanted."""

    def __init__(self, sequences: list[np.ndarray], symbols: int, threshold: int):
        self._build(np.concatenate(sequences) if len(sequences) else np.zeros(0, np.int64), np.array([len(x) for x in sequences], np.int64), symbols, threshold)

    @classmethod
    def of(cls, flat: np.ndarray, lengths: np.ndarray, symbols: int, threshold: int) -> FMIndex:
        """The same from sequences that stand one after the other."""
        out = cls.__new__(cls)
        out._build(flat, lengths, symbols, threshold)
        return out

    def _build(self, flat: np.ndarray, lengths: np.ndarray, symbols: int, threshold: int) -> None:
        self.threshold = threshold
        marked = np.zeros(len(flat) + len(lengths), np.int64)
        inside = np.ones(len(marked), bool)
        inside[np.cumsum(lengths + 1) - 1] = False
        marked[inside] = flat
        # Ends of sequences differ from each other while suffixes are sorted, so no match runs over one.
        apart = np.where(inside, marked + len(lengths), np.cumsum(~inside) - 1)
        order = suffix_array(apart)
        transform = marked[order - 1]
        self.size = len(marked)
        self.tree = WaveletTree(transform, symbols)
        counts = np.bincount(marked, minlength=symbols)
        self.present = counts > 0
        self.first = np.cumsum(counts) - counts
        self.agree = np.zeros(self.size + 1, np.int8)  # of each suffix and the one before it, at most threshold
        padded = np.append(marked, np.zeros(threshold, np.int64))
        lanes = np.arange(1, self.size)
        for k in range(threshold):
            a, b = padded[order[lanes] + k], padded[order[lanes - 1] + k]
            lanes = lanes[(a == b) & (a > 0)]
            self.agree[lanes] = k + 1

    @cached_property
    def _bounds(self) -> dict[int, np.ndarray]:
        return {}

    def _bound(self, length: int) -> np.ndarray:
        """Places in suffix order where fewer than ``length`` symbols agree."""
        if length not in self._bounds:
            self._bounds[length] = np.flatnonzero(self.agree < length).astype(np.int32)
        return self._bounds[length]

    def _shortened(self, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``length`` symbols of what the given intervals match."""
        if not length:
            return np.zeros_like(low), np.full_like(high, self.size)
        bound = self._bound(length)
        return bound[np.searchsorted(bound, low, "right") - 1].astype(np.int64), bound[np.searchsorted(bound, high)].astype(np.int64)

    def _extended(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search by one symbol."""
        found = self.tree.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return self.first[symbols] + found[: len(symbols)], self.first[symbols] + found[len(symbols) :]

    def matching_statistics(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of each pattern: the length of the longest match that starts there (up to the
        threshold), and low and high end of its interval in suffix order.

        ``patterns`` is a matrix whose rows are filled from the left; symbols that the index doesn't
        have are below 0. All patterns are searched together, from their right ends. A match that can't
        be extended loses symbols at its right end until it can.
        """
        matched, lows, highs = np.zeros(patterns.shape, np.int8), np.zeros(patterns.shape, np.int64), np.zeros(patterns.shape, np.int64)
        low, high, length = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size), np.zeros(len(patterns), np.int64)
        for back in range(int(lengths.max(initial=0))):
            lanes = np.flatnonzero(lengths > back)
            at = lengths[lanes] - 1 - back
            symbols = patterns[lanes, at]
            known = (symbols >= 0) & self.present[symbols]
            lost = lanes[~known]
            low[lost], high[lost], length[lost] = 0, self.size, 0
            open_, sought = lanes[known], symbols[known]
            while len(open_):
                below, above = self._extended(sought, low[open_], high[open_])
                found = below < above
                done = open_[found]
                low[done], high[done] = below[found], above[found]
                length[done] += 1
                open_, sought = open_[~found], sought[~found]
                if len(open_):
                    shorter = np.maximum(self.agree[low[open_]], self.agree[high[open_]]).astype(np.int64)
                    for k in np.unique(shorter).tolist():
                        own = open_[shorter == k]
                        low[own], high[own] = self._shortened(low[own], high[own], k)
                    length[open_] = shorter
            matched[lanes, at], lows[lanes, at], highs[lanes, at] = length[lanes], low[lanes], high[lanes]
            full = lanes[length[lanes] == self.threshold]
            low[full], high[full] = self._shortened(low[full], high[full], self.threshold - 1)
            length[full] -= 1
        return matched, lows, highs
