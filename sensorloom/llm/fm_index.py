"""A compressed FM-index over sequences of word numbers, searched for many patterns at once.

What is kept of a text is its Burrows-Wheeler transform as a wavelet tree of compressed bit vectors,
and one text position in ``SAMPLE``; the others are found by walking back to a sampled one.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8
_ALL = ~np.uint64(0)
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_BELOW = _BIT - np.uint64(1)


class OpenBits:
    """One bit vector as plain words with the ones before each, while a batch passes through it."""

    __slots__ = ("words", "before")

    def __init__(self, words: np.ndarray, before: np.ndarray):
        self.words, self.before = words, before

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & _BELOW[at & 63])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] & _BIT[at & 63]) != 0


class BitVector:
    """Bits in words of 64, of which only those that are neither all zeros nor all ones are stored.

    Eight words are a block with its count of ones; a word has its count within the block.  A transform of repetitive text has long runs, so most words need no storing.
    """

    __slots__ = ("stored", "mixed", "full", "before", "within")

    def __init__(self, bits: np.ndarray):
        blocks = len(bits) // 512 + 1
        padded = np.zeros(blocks * 512, dtype=bool)
        padded[: len(bits)] = bits
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        mixed = (words != 0) & (words != _ALL)
        self.stored = words[mixed]
        self.mixed = np.packbits(mixed, bitorder="little")
        self.full = np.packbits(words == _ALL, bitorder="little")
        ones = np.bitwise_count(words).astype(np.int64).reshape(-1, 8)
        self.before = np.cumsum(np.r_[0, ones.sum(axis=1)]).astype(np.uint32)
        self.within = (np.cumsum(ones, axis=1) - ones).astype(np.uint16).ravel()

    def opened(self) -> OpenBits:
        """All words and counts, for a batch of positions."""
        n = len(self.within)
        mixed = np.unpackbits(self.mixed, bitorder="little") == 1
        words = np.where(np.unpackbits(self.full, bitorder="little") == 1, _ALL, np.uint64(0))
        words[mixed] = self.stored
        return OpenBits(words, np.repeat(self.before[:-1].astype(np.int64), 8)[:n] + self.within)

    def nbytes(self) -> int:
        return sum(getattr(self, name).nbytes for name in self.__slots__)


class WaveletTree:
    """Balanced wavelet tree, level by level: at each, the next lower bit of all symbols, with those
    whose higher bits agree kept together (zeros before ones)."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[BitVector, int]] = []
        self.shifts = list(range(max(1, int(size - 1).bit_length()) - 1, -1, -1))
        for shift in self.shifts:
            bit = (symbols >> shift) & 1 == 1
            self.levels.append((BitVector(bit), int((~bit).sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of ``symbol`` before ``lo`` and before ``hi``, offset alike (as wavelet matrices do)."""
        for shift, (bits, zeros) in zip(self.shifts, self.levels, strict=True):
            one, bits = (symbol >> shift) & 1 == 1, bits.opened()
            a, b = bits.rank(lo), bits.rank(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return lo, hi

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank, offset as in ``ranks``."""
        symbol = np.zeros(len(at), np.int64)
        for shift, (bits, zeros) in zip(self.shifts, self.levels, strict=True):
            bits = bits.opened()
            one, ones = bits.get(at), bits.rank(at)
            symbol |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the length that is told apart."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank, width = rank.astype(np.int64), 1
    while True:
        tail = np.zeros(n, dtype=np.int64)
        tail[: max(0, n - width)] = rank[width:] + 1
        pair = rank * (n + 1) + tail
        order = np.argsort(pair, kind="stable")
        step = np.r_[0, np.cumsum(pair[order[1:]] != pair[order[:-1]])]
        if step[-1] == n - 1:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = step
        width *= 2


class FMIndex:
    """Index of ``symbols`` (0 separates sequences)."""

    def __init__(self, symbols: np.ndarray):
        text = np.r_[symbols + 1, 0]  # one end, smaller than all else
        order = suffix_order(text)
        self.n, self.size = len(text), int(text.max()) + 1
        self.first = np.searchsorted(text[order], np.arange(self.size + 1))
        self.tree = WaveletTree(text[order - 1], self.size)  # the symbol before each suffix, around the end
        nothing = np.zeros(self.size, np.int64)
        self.starts, _ = self.tree.ranks(np.arange(self.size), nothing, nothing)
        sampled = order % SAMPLE == 0
        self.is_sampled, self.samples = BitVector(sampled), order[sampled].astype(np.uint32)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: suffix ranges of ``symbol`` + pattern from those of the patterns."""
        a, b = self.tree.ranks(symbol, lo, hi)
        base = self.first[symbol] - self.starts[symbol]
        return base + a, base + b

    def search(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the patterns ``text[e - length : e]``.

        Returns each pattern's matching statistic up to ``length``, counting only suffixes that
        match elsewhere too, and its range of suffixes (left as it is once it holds a single one).
        """
        last = text[ends - 1] + 1
        lo, hi = self.first[last], self.first[last + 1]  # the suffixes that begin with the last symbol
        live = np.flatnonzero(hi - lo > 1)
        matched = (hi - lo > 1).astype(np.int64)
        for k in range(2, length + 1):
            if len(live) == 0:
                break
            a, b = self.extend(text[ends[live] - k] + 1, lo[live], hi[live])
            lo[live], hi[live] = a, b
            live = live[b - a > 1]
            matched[live] = k
        return matched, lo, hi

    def locate(self, rank: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to a sampled one, which are added to its position."""
        at, steps, out = rank.astype(np.int64), 0, np.empty(len(rank), np.int64)
        open_, sampled = np.arange(len(rank)), self.is_sampled.opened()
        while len(open_):
            known = sampled.get(at)
            out[open_[known]] = self.samples[sampled.rank(at[known])].astype(np.int64) + steps
            open_, at = open_[~known], at[~known]
            symbol, offset = self.tree.access(at)
            at = self.first[symbol] - self.starts[symbol] + offset
            steps += 1
        return out

    def nbytes(self) -> int:
        return sum(bits.nbytes() for bits, _ in self.tree.levels) + self.is_sampled.nbytes() + self.samples.nbytes + self.first.nbytes + self.starts.nbytes
