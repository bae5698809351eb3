"""A compressed full-text index of many texts: BWT in a wavelet matrix, and matching statistics by backward search."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits packed into words, with counts at word boundaries."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)))[:-1].astype(np.int32)
        self.ones = int(counts.sum())

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank of any symbol at any position, in one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[BitVector] = []
        self.zeros: list[int] = []
        self.depth = max(1, int(sigma - 1).bit_length())
        now = symbols
        for level in range(self.depth - 1, -1, -1):
            bits = ((now >> level) & 1).astype(bool)
            self.levels.append(BitVector(bits))
            self.zeros.append(int(len(bits) - self.levels[-1].ones))
            now = np.concatenate((now[~bits], now[bits]))
        self.base = self.rank(np.arange(sigma), np.zeros(sigma, np.int64), absolute=True)

    def rank(self, symbol: np.ndarray, at: np.ndarray, absolute: bool = False) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        place = at.astype(np.int64)
        for level, bits, zeros in zip(range(self.depth - 1, -1, -1), self.levels, self.zeros):
            ones = bits.rank(place)
            place = np.where((symbol >> level) & 1, zeros + ones, place - ones)
        return place if absolute else place - self.base[symbol]


def suffix_array(text: np.ndarray, sigma: int, enough: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes in order of their first ``enough`` symbols at least (those that agree so far stand in any order); and, for
    each depth on the way, the classes of suffixes that agree in so many symbols, by their first row; -1 at the end.

    Prefix doubling from packed symbols; each round sorts only the suffixes that still tie.
    """
    n = len(text)
    bits = max(1, int(sigma).bit_length())  # one more symbol for the end
    pack = max(1, min(62 // bits, enough, 8))
    key = np.zeros(n, np.int64)
    padded = np.concatenate((text.astype(np.int64) + 1, np.zeros(pack, np.int64)))
    for k in range(pack):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key)
    ordered = key[order]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1])) if n else np.zeros(0, bool)
    starts = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = starts
    depth, levels = pack, [(pack, rank.astype(np.int32))]
    while depth < enough:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        at = order[slots]
        key = rank[at] * (n + 2) + rank[np.minimum(at + depth, n)] + 1
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        fresh[slots] = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = np.maximum.accumulate(np.where(fresh[slots], slots, 0))
        depth *= 2
        levels.append((depth, rank.astype(np.int32)))
    return order, levels


def common_prefixes(text: np.ndarray, order: np.ndarray, levels: list[tuple[int, np.ndarray]], most: int) -> np.ndarray:
    """Of each row and the row before it, the symbols they have in common, ``most`` at most; 0 for the first row."""
    n = len(text)
    a, b = order[:-1], order[1:]
    size = np.zeros(max(n - 1, 0), np.int64)
    for depth, rank in reversed(levels):
        size += depth * (rank[np.minimum(a + size, n)] == rank[np.minimum(b + size, n)])
    ended = np.append(text.astype(np.int64), -1)
    going = size < most
    for _ in range(levels[0][0] - 1):
        going &= (ended[np.minimum(a + size, n)] == ended[np.minimum(b + size, n)]) & (b + size < n) & (a + size < n)
        size += going
    return np.concatenate((np.zeros(min(n, 1), np.int64), np.minimum(size, most)))


class Minima:
    """The least entry of any range, from the least ones of all ranges whose lengths are powers of two."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while 1 << len(self.rows) <= len(x):
            last, half = self.rows[-1], 1 << len(self.rows) - 1
            self.rows.append(np.minimum(last[:-half], last[half:]))
        self.log = np.zeros(len(x) + 2, np.int8)
        for k in range(1, len(self.rows) + 1):
            self.log[1 << k :] = k

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Over ``first`` to ``last``, both inclusive and first <= last."""
        level = self.log[last - first + 1]
        out = np.empty(len(first), self.rows[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.rows[k]
            out[at] = np.minimum(row[first[at]], row[last[at] - (1 << int(k)) + 1])
        return out


class FMIndex:
    """Index of the texts of a shard (arrays of code points), each with the least and greatest document that holds it.

    The search uses the BWT in a wavelet matrix and the counts of symbols. Beside them lie, for matching statistics, the
    common prefixes of neighbouring rows (up to ``most`` symbols) and for each row the nearest rows before and after it
    that belong to another document; a text that several documents hold is another one to everything.
    """

    def __init__(self, texts: list[np.ndarray], low: np.ndarray, high: np.ndarray, most: int):
        size = np.array([len(t) for t in texts], np.int64)
        joined = np.concatenate([x for t in texts for x in (t, [0])]).astype(np.uint32)
        ends = np.cumsum(size + 1) - 1
        is_end = np.zeros(len(joined), bool)
        is_end[ends] = True
        self.alphabet = np.unique(joined[~is_end])
        symbols = np.searchsorted(self.alphabet, joined) + 1
        symbols[is_end] = 0
        sigma = len(self.alphabet) + 1
        self.n = n = len(symbols)
        self.most = most
        order, levels = suffix_array(symbols, sigma, most)
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma))))
        self.matrix = WaveletMatrix(symbols[order - 1], sigma)
        common = common_prefixes(symbols, order, levels, most)
        # rows that agree in ``most`` symbols are one class, whatever their order
        self.first = np.maximum.accumulate(np.where(common < most, np.arange(n), 0)).astype(np.int32)
        self.minima = Minima(common.astype(np.uint16 if most < 1 << 16 else np.int32))
        owner = np.repeat(np.arange(len(texts)), size + 1)[order]
        several = (low != high)[owner]
        document = low[owner]
        turn = np.concatenate(([True], (document[1:] != document[:-1]) | several[1:] | several[:-1]))  # from the row before
        self.before = np.maximum.accumulate(np.where(turn, np.arange(n), 0)) - 1  # -1: none
        nearest = np.minimum.accumulate(np.where(turn, np.arange(n), n)[::-1])[::-1]
        self.after = np.append(nearest[1:], n)  # n: none
        self.shared_texts = low != high

    def _elsewhere(self, row: np.ndarray) -> np.ndarray:
        """The symbols that a row has in common with the nearest rows of other documents, the greater number."""
        out = np.zeros(len(row), np.int64)
        for near, ok in ((self.before[row], self.before[row] >= 0), (self.after[row], self.after[row] < self.n)):
            at = np.flatnonzero(ok)
            a, b = np.minimum(row[at], near[at]) + 1, np.maximum(row[at], near[at])
            out[at] = np.maximum(out[at], self.minima.least(a, b))
        return out

    def matching_statistics(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """For each position of each streamed text, one of the shard's, the length of the longest match from there on with
        another document, ``most`` at most.

        Backward search of all texts side by side, the longest first. A step leads from the first row that begins with
        what has been read to the first that begins with one symbol more; from ``most`` symbols on, to the first of those
        that agree in as many. The text's own row is always among these rows, so the search itself does not fail; the
        nearest rows of other documents say how far the match with them goes.
        """
        size = np.array([len(t) for t in texts], np.int64)
        rank = np.argsort(-size, kind="stable")
        sizes = size[rank]
        flat = np.concatenate([texts[k] for k in rank]) if len(texts) else np.zeros(0, np.uint32)
        symbols = np.searchsorted(self.alphabet, flat) + 1
        ends = np.cumsum(sizes)
        whole = self.shared_texts[rank]
        lo, length = np.zeros(len(rank), np.int64), np.zeros(len(flat), np.int32)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            active = int(np.searchsorted(-sizes, -step, "left"))  # texts longer than ``step``
            place = ends[:active] - 1 - step
            symbol = symbols[place]
            row = self.counts[symbol] + self.matrix.rank(symbol, lo[:active])
            read = step + 1
            if read >= self.most:
                row = self.first[row].astype(np.int64)
                read = self.most
            lo[:active] = row
            length[place] = np.where(whole[:active], read, np.minimum(self._elsewhere(row), read))
        out: list[np.ndarray] = [length[:0]] * len(texts)
        for k, original in enumerate(rank):
            out[original] = length[ends[k] - sizes[k] : ends[k]]
        return out

    def shared_starts(self, texts: list[np.ndarray], length: int) -> list[np.ndarray]:
        """The positions of each text from which at least ``length`` symbols match in another document."""
        return [np.flatnonzero(x >= length) for x in self.matching_statistics(texts)]
