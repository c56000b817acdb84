"""Exact removal of repeated byte strings by sparse distributed prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm import repeats
from faultline.llm import textscan as ts
from faultline.llm.repeats import KEYS
from faultline.llm.tables import cut_table, doc_key

PAIRS = "known boolean, a long, b long, key_id long, key_text long, lo int, n int"


def rank_pairs(open_docs: DataFrame, length: int) -> DataFrame:
    """For every window of the open runs, the ranks of its first half and of the half at the doubled offset.

    Ranks are names: hashes of the half's bytes. Windows that repeat inside a batch are settled there (known).
    """
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ts.slices(batches, "text"):
            data, off = ts.buffer(part.column("text"))
            roll = ts.Rolling(ts.BYTE_VALUES[data])
            doc, (lo, n) = repeats.runs_of(part, 2)
            lo, n = lo.astype(np.int64), n.astype(np.int64)
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc = np.repeat(doc, n)
            p = at + off[doc]
            a, b = roll.of(p, p + half), roll.of(p + half, p + length)
            key_id, key_text = (np.asarray(part.column(k))[doc] for k in KEYS)
            order = np.lexsort((at, key_text, key_id, b, a))
            a, b, at, key_id, key_text = (x[order] for x in (a, b, at, key_id, key_text))
            first = repeats.first_of_group([a, b])
            again = (key_id != key_id[first]) | (key_text != key_text[first]) | (at != at[first])  # else a repeated row
            back = np.flatnonzero(again)
            back = back[np.lexsort((at[back], key_text[back], key_id[back]))]
            k = repeats.joined_runs(key_id[back], key_text[back], at[back], np.ones(len(back), np.int64))
            spread = ts.mix(k[0].view(np.uint64) * ts.BASE + k[1].view(np.uint64) + k[2].astype(np.uint64))
            yield pairs(np.ones(len(spread), bool), spread, spread, *k)
            keep = np.flatnonzero(first == np.arange(len(first)))
            yield pairs(np.zeros(len(keep), bool), a[keep], b[keep], key_id[keep], key_text[keep], at[keep], np.ones(len(keep), np.int64))

    def pairs(known, a, b, key_id, key_text, lo, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(known), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(key_id), pa.array(key_text), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))],
            ["known", "a", "b", *KEYS, "lo", "n"],
        )

    return open_docs.mapInArrow(run, PAIRS)


def repeated_runs(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of windows (key_id, key_text, lo, n) whose bytes also start earlier.

    Sparse prefix doubling, from 32 over 66 to 100 bytes by default. Round one ranks grams of `gram` bytes at the places
    that anchor windows, sorts pairs of that rank and the rank of what the anchored windows cover, and drops what is
    unique. Round two does so with the grams that reach half-way further, to the side where the windows lie. Round three
    sorts, for each window still open, the ranks of its two halves: the threshold is reached, equal pairs are equal
    windows, and all but the first of them start earlier. Ranks are 64-bit names; a pair is told apart by 128 bits.

    All rounds after the first read the texts from one shuffle.
    """
    heavy = repeats.heavy_anchors(keyed, "bytes", length, gram, False)
    first = cut_table(repeats.settle(repeats.scan(keyed, "bytes", length, gram, False, heavy), False))
    open_docs = repeats.with_runs(keyed, first.where("not known"), "inner", ("lo", "n", "at"))
    second = repeats.settle(repeats.longer_grams(open_docs, "bytes", length, gram, False), False)
    pairs = rank_pairs(repeats.with_runs(keyed, second.where("not known"), "inner"), length)
    order = Window.partitionBy("known", "a", "b").orderBy(*KEYS, "lo")
    again = pairs.withColumn("place", F.rank().over(order)).where(F.col("known") | (F.col("place") > 1))
    known = first.where("known").unionByName(second.where("known"))
    return known.select(*KEYS, "lo", "n").unionByName(again.select(*KEYS, "lo", "n"))


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 32, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Removes every byte covered by a `length`-byte string that also starts earlier.

    Earlier: in a document with a smaller id (null last; rows that share an id but not the text are ordered by a hash of
    the text), or earlier in the same document. Strings are judged on the input and never cross documents.

    Returns (id, n_bytes, n_removed, n_spans, kept binary) for each row; kept are the remaining bytes, which need not be
    UTF-8. Null texts are empty; rows that repeat an id and its text get the same result; other columns are not read;
    an empty table gives no rows.
    """
    keyed = doc_key(docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text")))
    covered = repeats.with_runs(keyed, repeated_runs(keyed, length, gram), "left")
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ts.slices(batches, "text"):
            texts = part.column("text").fill_null("").cast(pa.binary()).to_pylist()
            lists = part.column("runs")
            n_removed, n_spans, kept = [], [], []
            for text, own in zip(texts, lists, strict=True):
                if not own.is_valid:
                    n_removed.append(0), n_spans.append(0), kept.append(text)
                    continue
                lo, n = (np.asarray(own.values.field(k), np.int64) for k in (0, 1))
                s, e = ts.runs(lo, lo + n - 1 + length)
                n_removed.append(int((e - s).sum()))
                n_spans.append(len(s))
                edges = [0, *np.stack([s, e], 1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    out = covered.select("doc_id", "text", "runs").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("doc_id", id_column)
