"""An FM-index over a sequence of small numbers: wavelet matrix, backward search, sampled suffix positions.

Searches are vectorised over patterns: each step of a backward search is a few array operations for all of them.
"""

from __future__ import annotations

from math import comb

import numpy as np

U = np.uint64


class Bits:
    """A bit vector in 64-bit words with a running count a word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.concatenate((bits, np.zeros(-n % 64 + 64, bool))), bitorder="little").view(U)
        self.words = packed
        self.counts = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        below = (U(1) << (i & 63).astype(U)) - U(1)
        return self.counts[w] + np.bitwise_count(self.words[w] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(U)) & U(1)).astype(bool)

    def get_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.get(i), self.rank(i)


BLOCK = 15  # bits, so that a class takes four
CLASS = np.bitwise_count(np.arange(1 << BLOCK, dtype=np.uint16))
BLOCKS = np.argsort(CLASS, kind="stable").astype(np.uint16)  # all blocks by class, then by value
FIRST = np.searchsorted(CLASS[BLOCKS], np.arange(BLOCK + 1))  # where each class begins among them
OFFSET = np.empty(1 << BLOCK, np.int64)
OFFSET[BLOCKS] = np.arange(1 << BLOCK) - FIRST[CLASS[BLOCKS]]
WIDTH = np.array([(comb(BLOCK, c) - 1).bit_length() for c in range(BLOCK + 1)], np.uint8)  # bits of an offset
MASK = (U(1) << WIDTH.astype(U)) - U(1)
#: Of four classes the ones (times 256) and the bits of offsets; sixteen classes have at most 240 and 208.
FOUR = sum(((np.arange(1 << 16) >> s & 15) << 8) + WIDTH[(np.arange(1 << 16) >> s) & 15] for s in (0, 4, 8, 12)).astype(np.uint16)
#: The ones of each of BLOCKS before each of its bits.
BEFORE = np.bitwise_count(BLOCKS[:, None] & ((np.uint16(1) << np.arange(16, dtype=np.uint16)) - np.uint16(1))).ravel()
LOW, BYTE_PAIRS, ONES = U(0xFFFFFFFF), U(0x00FF00FF00FF00FF), U(0x0001000100010001)


class CompressedBits:
    """A bit vector of block classes and offsets, near its entropy in size.

    Of each block of 15 bits the class, its number of ones, takes 4 bits and its place among the blocks of that class 0 to
    13. Sixteen classes are a word; the ones and the bits of offsets before each word are counted, in one number of 64 bits.
    """

    def __init__(self, bits: np.ndarray):
        padded = np.concatenate((bits, np.zeros(-len(bits) % (16 * BLOCK) + 16 * BLOCK, bool))).reshape(-1, BLOCK)
        block = np.packbits(np.pad(padded, ((0, 0), (0, 1))), axis=1, bitorder="little").view(np.uint16).ravel()
        kind = CLASS[block]
        self.classes = (kind[::2] | kind[1::2] << 4).view(U)
        ones = np.cumsum(kind, dtype=np.int64) - kind
        width = WIDTH[kind]
        start = np.cumsum(width, dtype=np.int64) - width
        self.heads = ones[::16].astype(U) << U(32) | start[::16].astype(U)
        self.offsets = np.zeros((int(start[-1]) >> 6) + 2, U)
        word, shift, value = start >> 6, (start & 63).astype(U), OFFSET[block].astype(U)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        self.offsets[word[first]] = np.bitwise_or.reduceat(value << shift, first)
        over = np.flatnonzero((start & 63) + width > 64)
        self.offsets[word[over] + 1] |= value[over] >> (U(64) - shift[over])

    def nbytes(self) -> int:
        return self.classes.nbytes + self.heads.nbytes + self.offsets.nbytes

    def block(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of BLOCKS position i lies in, the position in it, and the ones before it."""
        b = i // BLOCK
        at = i - b * BLOCK
        w = b >> 4
        word = self.classes.take(w)
        shift = ((b & 15) << 2).view(U)
        kind = (word >> shift & U(15)).view(np.int64)
        word &= (U(1) << shift) - U(1)
        four = word.view(np.uint16)
        sums = FOUR.take(four).view(U)  # of four groups of classes; they are added by one product, as each part stays below 256
        sums = ((sums & BYTE_PAIRS) * ONES >> U(48)) + ((sums >> U(8) & BYTE_PAIRS) * ONES >> U(48) << U(32))
        sums += self.heads.take(w)
        p = sums & LOW
        q, s = (p >> U(6)).view(np.int64), p & U(63)
        value = self.offsets.take(q) >> s
        value |= self.offsets.take(q + 1) << U(1) << (U(63) - s)
        value &= MASK.take(kind)
        return FIRST.take(kind) + value.view(np.int64), at, (sums >> U(32)).view(np.int64)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        block, at, before = self.block(i)
        return before + BEFORE.take(block << 4 | at)

    def get(self, i: np.ndarray) -> np.ndarray:
        block, at, _ = self.block(i)
        return (BLOCKS.take(block) >> at & 1).astype(bool)

    def get_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block, at, before = self.block(i)
        return (BLOCKS.take(block) >> at & 1).astype(bool), before + BEFORE.take(block << 4 | at)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int, kind: type = Bits):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        rest = symbols
        for level in range(self.levels - 1, -1, -1):
            one = ((rest >> level) & 1).astype(bool)
            self.bits.append(kind(one))
            self.zeros.append(int(len(one) - one.sum()))
            rest = np.concatenate((rest[~one], rest[one]))
        self.first = np.zeros(sigma, np.int64)
        self.first[:] = self.place(np.arange(sigma), np.zeros(sigma, np.int64))

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, bits in enumerate(self.bits):
            ones = bits.rank(i)
            i = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands before position i."""
        return self.place(symbol, i) - self.first[symbol]

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol = np.zeros(len(i), np.int64)
        for k, bits in enumerate(self.bits):
            one, ones = bits.get_and_rank(i)
            symbol = symbol * 2 + one
            i = np.where(one, self.zeros[k] + ones, i - ones)
        return symbol, i - self.first[symbol]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorts all suffixes by doubling; a suffix that ends first is the smaller one. Only unsettled groups are sorted on."""
    n = len(text)
    order = np.argsort(text.astype(np.uint16) if n and text.max() < 1 << 16 else text, kind="stable")  # a radix sort for two bytes
    keys = text[order]
    head = np.concatenate(([True], keys[1:] != keys[:-1]))
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    step = 1
    while True:
        tail = np.append(head[1:], True)
        open_ = np.flatnonzero(~(head & tail))  # places of suffixes whose rank is shared
        if not len(open_):
            return order
        at = order[open_]
        after = at + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at] * np.int64(n + 1) + second
        perm = np.argsort(key, kind="stable")
        order[open_] = at[perm]
        key = key[perm]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head[open_] = new
        start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order[open_]] = start[open_]
        step *= 2


class FMIndex:
    """text: symbols from 0 to sigma - 1. Symbol 0 parts pieces and no pattern may hold it.

    compressed: bit vectors of block classes and offsets. Frequent symbols should have small numbers then, so that the
    upper levels are nearly all zeros.
    """

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8, compressed: bool = False):
        kind = CompressedBits if compressed else Bits
        text = np.append(text.astype(np.int64) + 1, 0)  # the end is smaller than all
        sigma += 1
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.n = len(text)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(bwt, minlength=sigma))))
        self.tree = WaveletMatrix(bwt, sigma, kind)
        sampled = sa % sample == 0
        self.marked = kind(sampled)
        self.places = sa[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of patterns of one length, a row each: the ranges of suffixes that begin with them."""
        count, length = patterns.shape
        lo, hi = np.zeros(count, np.int64), np.full(count, self.n)
        live = np.arange(count)
        for k in range(length - 1, -1, -1):
            c = patterns[live, k] + 1
            lo[live] = self.less[c] + self.tree.rank(c, lo[live])
            hi[live] = self.less[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffixes: steps back until a sampled one."""
        rows, out, steps = rows.copy(), np.empty(len(rows), np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            there = self.marked.get(r)
            out[todo[there]] = self.places[self.marked.rank(r[there])] + steps
            todo, r = todo[~there], r[~there]
            symbol, rank = self.tree.symbol_and_rank(r)
            rows[todo] = self.less[symbol] + rank
            steps += 1
        return out
