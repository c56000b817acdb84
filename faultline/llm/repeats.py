"""Exact search for windows (of bytes or words) that occur more than once, by anchors chosen from the content.

A window's anchor is the gram in it with the least hash. Equal windows have equal anchors, so what can repeat at all is
found among the occurrences of repeated anchors: some 2 rows in 70 bytes, not one a byte. Runs of windows with one
anchor are one row. The rows are shuffled and sorted once by (anchor, all that the run covers):

- runs that repeat an earlier one as a whole are settled: all their windows repeat ("known");
- runs whose anchor occurs nowhere else, or only with the same surroundings later, are settled: none repeats;
- what is left, the first run of each of several surroundings of one anchor, is "open": at the edges of repeated
  passages. Its windows are compared one by one, by the operators that use this module.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import textscan as ts

ROWS = "known boolean, heavy boolean, h long, c long, key_id long, key_text long, lo int, n int, at int"
RUNS = "known boolean, heavy boolean, h long, key_id long, key_text long, lo int, n int, at int"
KEYS = ("key_id", "key_text")


def symbols(texts: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values of the bytes or words of texts, and the offsets of each text's."""
    data, off = ts.buffer(texts)
    if unit == "bytes":
        return ts.BYTE_VALUES[data], off
    starts, ends, of = ts.words(data, off, ~ts.SPACES)
    return ts.hashes(data, starts, ends), of


def joined_runs(key_id, key_text, lo, n) -> list[np.ndarray]:
    """Joins runs (sorted by key and lo) that follow each other."""
    if not len(lo):
        return [key_id, key_text, lo, n]
    new = np.concatenate(([True], (key_id[1:] != key_id[:-1]) | (key_text[1:] != key_text[:-1]) | (lo[1:] != lo[:-1] + n[:-1])))
    first = np.flatnonzero(new)
    return [key_id[first], key_text[first], lo[first], np.add.reduceat(n, first)]


def first_of_group(columns: list[np.ndarray]) -> np.ndarray:
    """For each row of sorted columns, the row that begins its group."""
    m = len(columns[0])
    new = np.ones(m, bool)
    if m > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.maximum.accumulate(np.where(new, np.arange(m), 0))


def record(known, heavy, h, c, key_id, key_text, lo, n, at) -> pa.RecordBatch:
    signed = lambda x: pa.array(np.asarray(x).view(np.int64) if np.asarray(x).dtype == np.uint64 else np.asarray(x, np.int64), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(known, pa.bool_()), pa.array(heavy, pa.bool_()), *map(signed, (h, c, key_id, key_text)), *(pa.array(np.asarray(x, np.int32)) for x in (lo, n, at))],
        ["known", "heavy", "h", "c", *KEYS, "lo", "n", "at"],
    )


def settled_here(h, c, key_id, key_text, lo, n, at, other_document: bool, heavy: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of ROWS from runs of one slice. Runs that repeat an earlier one of the slice are known, and dealt evenly."""
    if not len(h):
        return
    order = np.lexsort((lo, key_text, key_id, c, h))
    h, c, key_id, key_text, lo, n, at = (x[order] for x in (h, c, key_id, key_text, lo, n, at))
    first = first_of_group([h, c])
    there = (key_id == key_id[first]) & (key_text == key_text[first]) & (lo == lo[first])  # a repeated row is the same place
    done = key_id > key_id[first] if other_document else ~there
    back = np.flatnonzero(done)
    back = back[np.lexsort((lo[back], key_text[back], key_id[back]))]
    k_id, k_text, k_lo, k_n = joined_runs(key_id[back], key_text[back], lo[back], n[back])
    if len(k_id):
        spread = ts.mix(k_id.view(np.uint64) * ts.BASE + k_text.view(np.uint64) + k_lo.astype(np.uint64))
        none = np.zeros(len(k_id), np.int64)
        yield record(np.ones(len(k_id), bool), none.astype(bool), spread, none, k_id, k_text, k_lo, k_n, none)
    keep = ~done & (~there | (first == np.arange(len(first))))
    often = np.isin(h[keep].view(np.int64), heavy) if heavy is not None and len(heavy) else np.zeros(keep.sum(), bool)
    yield record(np.zeros(keep.sum(), bool), often, h[keep], c[keep], key_id[keep], key_text[keep], lo[keep], n[keep], at[keep])


def scan(docs: DataFrame, unit: str, window: int, gram: int, other_document: bool, heavy: np.ndarray | None = None) -> DataFrame:
    """Anchored runs of all documents (key_id, key_text, text). What repeats inside a slice is settled there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ts.slices(batches, "text"):
            values, off = symbols(part.column("text"), unit)
            a = ts.anchors(values, off, window, gram)
            ids, keys = (np.asarray(part.column(k)) for k in KEYS)
            yield from settled_here(a["h"], a["c"], ids[a["doc"]], keys[a["doc"]], a["lo"], a["n"], a["at"], other_document, heavy)

    return docs.select(*KEYS, "text").mapInArrow(run, ROWS)


def runs_of(part: pa.RecordBatch, fields: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The document of each run in the column `runs`, and the runs' fields."""
    lists = part.column("runs")
    of = np.asarray(lists.offsets, np.int64)
    flat = lists.values.slice(of[0], of[-1] - of[0])
    return np.repeat(np.arange(len(of) - 1), np.diff(of)), [flat.field(k).to_numpy(zero_copy_only=False) for k in range(fields)]


def longer_grams(open_docs: DataFrame, unit: str, window: int, gram: int, other_document: bool) -> DataFrame:
    """The open runs again, by grams half-way from `gram` to the window.

    Windows that begin well before their anchor share the gram that ends with it and begins earlier, the others the one
    that begins with it and ends later. Each run is parted by that; most grams at the edges of repeats are unique now.
    """
    more = (window - gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ts.slices(batches, "text"):
            values, off = symbols(part.column("text"), unit)
            roll = ts.Rolling(values)
            doc, (lo, n, at) = runs_of(part, 3)
            lo, n, at = (x.astype(np.int64) for x in (lo, n, at))
            base = off[doc]
            pos = lo + at
            out = []
            for early in (True, False):
                a = lo if early else np.maximum(lo, pos - more + 1)
                b = np.minimum(lo + n, pos - more + 1) if early else lo + n
                some = np.flatnonzero(b > a)
                a, b, p, d, s = a[some], b[some], pos[some], doc[some], base[some]
                g0, g1 = (p - more, p + gram) if early else (p, p + gram + more)
                h = roll.of(g0 + s, g1 + s) + np.uint64(early)
                c = ts.mix(roll.of(a + s, b - 1 + window + s) + (p - a).astype(np.uint64) * ts.BASE)
                out.append((h, c, d, a, b - a, p - a))
            h, c, d, a, m, at = (np.concatenate([x[k] for x in out]) for k in range(6))
            ids, keys = (np.asarray(part.column(k)) for k in KEYS)
            yield from settled_here(h, c, ids[d], keys[d], a, m, at, other_document)

    return open_docs.mapInArrow(run, ROWS)


def heavy_anchors(docs: DataFrame, unit: str, window: int, gram: int, other_document: bool, one_in: int = 64, least: int = 40, most: int = 10_000) -> np.ndarray:
    """Anchors that very many documents hold with different surroundings, from one document in `one_in`.

    This only decides which anchors are dealt out over many tasks; results don't depend on it.
    """
    some = docs.where(F.pmod(F.xxhash64("key_id", "key_text", F.lit(7)), F.lit(one_in)) == 0)
    counts = scan(some, unit, window, gram, other_document).where("not known").groupBy("h").count().where(F.col("count") >= least)
    return np.array([r["h"] for r in counts.orderBy(F.desc("count")).limit(most).collect()], np.int64)


def settle(rows: DataFrame, other_document: bool) -> DataFrame:
    """From anchored runs, those known to repeat and those still open. One shuffle and sort.

    Runs of a heavy anchor are dealt by their surroundings as well, and all taken for open unless known.
    """
    dealt = rows.repartition(F.when(F.col("heavy"), F.xxhash64("h", "c")).otherwise(F.col("h")))
    ordered = dealt.sortWithinPartitions("known", "heavy", "h", "c", *KEYS, "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # h, c, where the group begins (key_id, key_text, lo), whether its h has several surroundings
        waiting: list[pa.RecordBatch] = []  # open rows of an anchor with one kind of surroundings so far
        for batch in batches:
            if not batch.num_rows:
                continue
            known, heavy = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), bool) for k in ("known", "heavy"))
            h, c, key_id, key_text, lo = (np.asarray(batch.column(k)) for k in ("h", "c", *KEYS, "lo"))
            m = len(h)
            plain = ~known
            group_c, group_h = first_of_group([known, heavy, h, c]), first_of_group([known, heavy, h])
            first_id, first_text, first_lo = key_id[group_c], key_text[group_c], lo[group_c]
            repeat = group_c != np.arange(m)
            n_c = np.cumsum(~repeat)
            ends_h = np.append(np.flatnonzero(group_h[1:] != group_h[:-1]), m - 1)
            starts_h = group_h[ends_h]
            many = n_c[ends_h] > n_c[starts_h]
            if last is not None and plain[0] and not heavy[0] and last[0] == h[0]:
                in_first = group_h == 0
                same_c = in_first & (group_c == 0) & (c == last[1])
                first_id, first_text, first_lo = (np.where(same_c, x, y) for x, y in zip(last[2], (first_id, first_text, first_lo), strict=True))
                repeat |= same_c
                many[0] = many[0] or last[3] or not same_c[0]
                if many[0]:
                    yield from waiting
                    waiting = []
            else:
                waiting = []
            several = np.repeat(many, ends_h - starts_h + 1)
            there = (key_id == first_id) & (key_text == first_text) & (lo == first_lo)  # a repeated row is the same place
            done = plain & (key_id > first_id if other_document else ~there)
            open_ = plain & ~done & (several | heavy) & ~(there & repeat)
            out = known | done | open_
            tail = (group_h == starts_h[-1]) & plain & ~done & ~heavy & ~(there & repeat)
            if not many[-1] and tail.any():
                waiting.append(pick(batch, tail, np.zeros(m, bool)))
            if out.any():
                yield pick(batch, out, known | done)
            end = m - 1
            last = (h[end], c[end], (first_id[end], first_text[end], first_lo[end]), bool(many[-1])) if plain[end] and not heavy[end] else None

    def pick(batch: pa.RecordBatch, rows: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        got = batch.filter(pa.array(rows))
        names = ["heavy", "h", *KEYS, "lo", "n", "at"]
        return pa.RecordBatch.from_arrays([pa.array(known[rows]), *(got.column(k) for k in names)], ["known", *names])

    return ordered.mapInArrow(run, RUNS)


def with_runs(docs: DataFrame, runs: DataFrame, how: str, fields: tuple[str, ...] = ("lo", "n")) -> DataFrame:
    """docs (keys, text, ...) with the array `runs` of each document's runs."""
    grouped = runs.groupBy(*KEYS).agg(F.collect_list(F.struct(*fields)).alias("runs"))
    return docs.join(grouped, list(KEYS), how)
