"""Vectorised scanning of Arrow text batches: bytes, words, rolling hashes and content-chosen anchors.

Everything here runs inside a Spark task on one slice of a batch (a few MB of text), so that memory stays
bounded whatever the size of the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SEED = np.random.default_rng(20240101)
BYTE_VALUES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))

#: Bytes that separate words for the contracts that split on white space.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words of letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a slice take max_bytes at most; a longer text has a slice of its own."""
    for batch in batches:
        n, start = batch.num_rows, 0
        if not n:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        base = 0
        while start < n:
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            base, start = int(ends[stop - 1]), stop


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the offsets of each, from 0."""
    a = texts.fill_null("").cast(pa.binary()) if not pa.types.is_binary(texts.type) else texts
    width = np.int32
    if pa.types.is_large_string(texts.type):
        a, width = texts.fill_null("").cast(pa.large_binary()), np.int64
    off = np.frombuffer(a.buffers()[1], width)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and the offsets of each text's words in these."""
    inside = is_word[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[off[:-1][off[:-1] < len(data)]] = False
        after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(n + 1, BASE), np.full(n + 1, BASE_INV)
    p[0] = q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


class Rolling:
    """Hashes of any ranges of a sequence of 64-bit values (modulo 2**64)."""

    def __init__(self, values: np.ndarray):
        self.pow, self.inv = powers(1 << max(10, int(len(values)).bit_length()))
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * self.pow[: len(values)], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.inv[lo] + (hi - lo).astype(U))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Rolling(BYTE_VALUES[data]).of(starts, ends)


def anchors(values: np.ndarray, off: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Groups the windows of each sequence by their anchor: the leftmost of the grams with the least hash in it.

    Equal windows have equal anchors at equal offsets. A row for each run of windows with one anchor:
    doc (index), lo (first window's start in the sequence), n (windows), h (the gram's hash), c (hash of all that the
    run's windows cover and of where the anchor is in it), at (the anchor's place after lo).
    """
    roll = Rolling(values)
    lens = np.diff(off)
    m = len(values) - gram + 1
    n_win = np.maximum(lens - window + 1, 0)
    if m <= 0 or not n_win.sum():
        return {k: np.zeros(0, np.int64) for k in ("doc", "lo", "n", "at")} | {k: np.zeros(0, U) for k in ("h", "c")}
    at = np.arange(m)
    h = roll.of(at, at + gram)
    bits = U(max(1, int(m).bit_length()))
    low = ((h >> bits) << bits) | at.astype(U)
    width, span = 1, window - gram + 1
    while width < span:  # the least key of the next span grams
        step = min(width, span - width)
        low = np.minimum(low[: len(low) - step], low[step:]) if len(low) > step else low[:0]
        width += step
    doc = np.repeat(np.arange(len(lens)), n_win)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(n_win) - n_win, n_win) + off[doc]
    anchor = (low[start] & ((U(1) << bits) - U(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    n = np.diff(np.append(new, len(anchor)))
    lo, pos, doc = start[new], anchor[new], doc[new]
    c = mix(roll.of(lo, lo + n - 1 + window) + (pos - lo).astype(U) * U(0x9E3779B97F4A7C15))
    return {"doc": doc, "lo": lo - off[doc], "n": n, "h": h[pos], "c": c, "at": pos - lo}


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges ranges that touch or overlap."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:] - 1, len(e) - 1)]
