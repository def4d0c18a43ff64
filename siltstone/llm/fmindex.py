"""An FM-index over integer texts, its transform held in a wavelet matrix of compressed bits.

Suffixes are sorted by their first symbols only, `depth` of them at least. That is enough for
backward search of patterns up to that length: the rows of a pattern are one interval
whatever the order of suffixes that agree on it.
"""

from __future__ import annotations

import numpy as np

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_GROUP = 8  # words of a group; groups have absolute counts, words counts within their group


class Bits:
    """A bit vector with rank in constant time; words of equal bits are stored by their kind alone."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        size = (n // (64 * _GROUP) + 1) * _GROUP
        padded = np.zeros(size * 64, np.uint8)
        padded[:n] = bits
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.kind = np.where(words == 0, 0, np.where(words == _ALL, 1, 2)).astype(np.uint8)
        mixed = self.kind == 2
        self.words = np.append(words[mixed], np.uint64(0))
        self.group_ones, self.ones_in_group = self._counts(np.bitwise_count(words).astype(np.int64))
        self.group_mixed, self.mixed_in_group = self._counts(mixed.astype(np.int64))

    @staticmethod
    def _counts(each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What comes before each group, and within its group before each word."""
        before = np.cumsum(each) - each
        groups = before[::_GROUP]
        return groups.astype(np.int32), (before - np.repeat(groups, _GROUP)).astype(np.uint16)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = i >> 6
        group, kind = at // _GROUP, self.kind[at]
        word = self.words[np.where(kind == 2, self.group_mixed[group] + self.mixed_in_group[at], len(self.words) - 1)]
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        inside = np.where(kind == 1, i & 63, np.bitwise_count(word & low))
        return self.group_ones[group] + self.ones_in_group[at].astype(np.int64) + inside


class WaveletMatrix:
    def __init__(self, values: np.ndarray, symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for level in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            self.levels.append((level, Bits(bit), int(len(bit) - bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i goes on the way down of each symbol; differences of it are ranks."""
        for level, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i


class FmIndex:
    """Of `text`, whose symbols are 0 (a separator) to symbols - 1, for patterns of `depth` symbols (two at least)."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        self.depth, n = depth, len(text)
        rank, step, half, halved = text.astype(np.int64), 1, None, 0
        while step < depth:
            half, halved = rank, step  # names of the first `halved` symbols, fewer than depth, and of half of them at least
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:]
            _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)
            rank += 1
            step *= 2
        suffixes = np.argsort(rank, kind="stable")
        # where rows begin that share their first depth - 1 symbols: two overlapping names cover these
        skip = depth - 1 - halved
        later = np.zeros(n, np.int64)
        later[: n - skip] = half[skip:]
        first, second = half[suffixes], later[suffixes]
        new = np.ones(n, bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        self.parents = np.append(np.flatnonzero(new), n).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.wavelet = WaveletMatrix(text[suffixes - 1], symbols)
        self.suffixes = suffixes.astype(np.int32)
        all_symbols = np.arange(symbols)
        self.shift = self.before[:-1] - self.wavelet.descend(all_symbols, np.zeros(symbols, np.int64))

    def extended(self, symbol: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of patterns with a symbol put in front."""
        down = self.wavelet.descend(np.concatenate([symbol, symbol]), np.concatenate([a, b]))
        shift = self.shift[symbol]
        return down[: len(a)] + shift, down[len(a) :] + shift

    def shortened(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From an interval of `depth` symbols, that of all rows which share all of them but the last."""
        at = np.searchsorted(self.parents, a, "right")
        return self.parents[at - 1].astype(np.int64), self.parents[at].astype(np.int64)

    def stream(self, text: np.ndarray, starts: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of texts that are streamed from their ends: for each text (start[i], of many[i] + depth - 1 symbols) the intervals of its many[i] windows.

        A text's last window is searched symbol by symbol. From there on the matched length is carried:
        each step drops the last symbol and puts one in front, so that it stays `depth`, the most that
        is looked for. A text that is part of the index always matches in full; of another, windows that
        do not occur have empty intervals, and its search begins anew with the next one.
        """
        total = int(many.sum())
        out = np.cumsum(many) - many
        low, high = np.zeros(total, np.int64), np.zeros(total, np.int64)
        a, b = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for back in range(int(many.max(initial=0))):
            live = np.flatnonzero(many > back)
            window = starts[live] + many[live] - 1 - back
            found = b[live] > a[live]
            carried, fresh = live[found], live[~found]
            if len(carried):
                x, y = self.shortened(a[carried])
                a[carried], b[carried] = self.extended(text[window[found]], x, y)
            if len(fresh):
                a[fresh], b[fresh] = self.searched(text, window[~found])
            at = out[live] + many[live] - 1 - back
            low[at], high[at] = a[live], b[live]
        return low, high

    def searched(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the `depth` symbols from each start on, by backward search from the last of them."""
        last = text[starts + self.depth - 1]
        a, b = self.before[last].copy(), self.before[last + 1].copy()
        for j in range(self.depth - 2, -1, -1):
            live = np.flatnonzero(b > a)
            if not len(live):
                break
            a[live], b[live] = self.extended(text[starts[live] + j], a[live], b[live])
        return a, b
