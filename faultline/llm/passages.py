"""Removal of passages of words that earlier documents hold, with an FM-index for each shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import repeats
from faultline.llm import textscan as ts
from faultline.llm.fmindex import FMIndex
from faultline.llm.repeats import KEYS
from faultline.llm.tables import cut_table, doc_key, drop_tables

SEGMENTS = "known boolean, shard long, key_id long, key_text long, lo int, n int, words binary"


def segments(open_docs: DataFrame, window: int) -> DataFrame:
    """The words (as 64-bit hashes) of the open runs, to be dealt to shards by their anchor.

    A run of a heavy anchor is dealt window by window instead, by the window's words, so that no shard gets all runs of
    one anchor; windows that repeat within a batch are settled at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ts.slices(batches, "text"):
            h, off = repeats.symbols(part.column("text"), "words")
            roll = ts.Rolling(h)
            doc, (lo, n, anchor, heavy) = repeats.runs_of(part, 4)
            lo, n, heavy = lo.astype(np.int64), n.astype(np.int64), heavy.astype(bool)
            key_id, key_text = (np.asarray(part.column(k)) for k in KEYS)
            light = np.flatnonzero(~heavy)
            yield table(anchor[light], doc[light], lo[light], n[light], h, off, key_id, key_text)
            if heavy.any():
                w = np.flatnonzero(heavy)
                d = np.repeat(doc[w], n[w])
                at = np.repeat(lo[w], n[w]) + np.arange(n[w].sum()) - np.repeat(np.cumsum(n[w]) - n[w], n[w])
                name = roll.of(at + off[d], at + off[d] + window)
                order = np.lexsort((at, key_text[d], key_id[d], name))
                d, at, name = d[order], at[order], name[order]
                first = repeats.first_of_group([name])
                done = key_id[d] > key_id[d[first]]
                yield table(ts.mix(name[done] + at[done].astype(np.uint64)).view(np.int64), d[done], at[done], np.ones(done.sum(), np.int64), h, off, key_id, key_text, known=True)
                yield table(name[~done].view(np.int64), d[~done], at[~done], np.ones((~done).sum(), np.int64), h, off, key_id, key_text)

    def table(shard, doc, lo, n, h, off, key_id, key_text, known=False) -> pa.RecordBatch:
        start = lo + off[doc]
        words = [b"" if known else h[s : s + k + window - 1].tobytes() for s, k in zip(start.tolist(), n.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(lo), known)), pa.array(shard), pa.array(key_id[doc]), pa.array(key_text[doc]), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(words, pa.binary())],
            ["known", "shard", *KEYS, "lo", "n", "words"],
        )

    return open_docs.mapInArrow(run, SEGMENTS)


def backward(index: FMIndex, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Backward search of pieces of the indexed text: matching statistics of their ends, as far as the pieces reach.

    Returns the words matched and the range of suffixes of that match. A search ends when one suffix is left, the piece
    itself; a piece is repeated if it matches in its whole length. Pieces that matched the same words so far and go on
    with the same one take the step together.
    """
    sigma = len(index.less)
    lo, hi, matched = np.zeros(len(start), np.int64), np.full(len(start), index.n), np.zeros(len(start), np.int64)
    live = np.arange(len(start))
    for k in range(int(length.max(initial=0))):
        live = live[length[live] > k]
        c = text[start[live] + length[live] - 1 - k] + 1
        asked, which = np.unique(lo[live] * sigma + c, return_inverse=True)  # ranges of one step that begin alike are one
        at, c = np.divmod(asked, sigma)
        to = np.empty_like(at)
        to[which] = hi[live]
        low, high = index.less[c] + index.tree.rank(c, np.stack([at, to]))
        several = (high - low > 1)[which]
        live, which = live[several], which[several]
        if not len(live):
            break
        lo[live], hi[live], matched[live] = low[which], high[which], k + 1
    return matched, lo, hi


def first_document(index: FMIndex, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least document id among the text positions of each range. ids: the id at each position."""
    if not len(lo):
        return np.zeros(0, np.int64)
    ranges, which = np.unique(np.stack([lo, hi], 1), axis=0, return_inverse=True)
    which = which.reshape(-1)
    count = ranges[:, 1] - ranges[:, 0]
    begin = np.cumsum(count) - count
    rows = np.arange(count.sum()) + np.repeat(ranges[:, 0] - begin, count)
    return np.minimum.reduceat(ids[index.locate(rows)], begin)[which]


def match_shard(shard: list[np.ndarray], key_id: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a shard's segments (segment, place) that also start in a document with a smaller id.

    Indexes all segments and streams them through backward searches:

    - of the whole segment; if an earlier document has it, all its windows repeat;
    - of the words that all windows of a segment share, for the other segments; if only one suffix has them, no window
      repeats. If they occur as often as the whole segment does, so does each window between them, at the same places,
      and no earlier document has one;
    - of each window of the segments that are left, which are those at the edges of repeated passages.

    Ranges that reach the threshold are located and their least document compared with the segment's own.
    """
    vocab, number, counts = np.unique(np.concatenate(shard), return_inverse=True, return_counts=True)
    by_count = np.empty(len(vocab), np.int64)
    by_count[np.argsort(-counts, kind="stable")] = np.arange(len(vocab))
    size = np.array([len(s) for s in shard], np.int64)
    start = np.cumsum(size + 1) - (size + 1)
    text = np.zeros((size + 1).sum(), np.int64)
    owner = np.repeat(np.arange(len(shard)), size + 1)
    inside = np.arange(len(text)) - start[owner] < size[owner]
    text[inside] = by_count[number] + 1
    index = FMIndex(text, len(vocab) + 1, compressed=True)
    ids = key_id[owner]
    matched, lo, hi = backward(index, text, start, size)
    whole = matched == size
    earlier = np.zeros(len(size), bool)
    earlier[whole] = first_document(index, ids, lo[whole], hi[whole]) < key_id[whole]
    often = np.where(whole, hi - lo, 1)
    done, rest = np.flatnonzero(earlier), np.flatnonzero(~earlier)
    matched, lo, hi = backward(index, text, start[rest] + n[rest] - 1, window - n[rest] + 1)
    edge = rest[(matched == window - n[rest] + 1) & (hi - lo > often[rest])]
    seg, place = windows_of(edge, n)
    matched, lo, hi = backward(index, text, start[seg] + place, np.full(len(seg), window))
    repeated = np.flatnonzero(matched == window)
    found = repeated[first_document(index, ids, lo[repeated], hi[repeated]) < key_id[seg[repeated]]]
    return tuple(np.concatenate(x) for x in zip((seg[found], place[found]), windows_of(done, n), strict=True))


def windows_of(segs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place) of all windows of some segments; n: the windows of each."""
    n = n[segs]
    return np.repeat(segs, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def match(segs: DataFrame, window: int, shard_words: int = 300_000) -> DataFrame:
    """Runs (key_id, key_text, lo, n) of the windows in segments that earlier documents hold.

    Segments are shuffled and sorted by their shard key; a task indexes whole keys together until shard_words are met.
    """
    ordered = segs.repartition("shard").sortWithinPartitions("known", "shard", *KEYS, "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole keys, then the rows of the last key seen
        words = 0
        last = None
        for batch in batches:
            known = batch.column("known").to_numpy(zero_copy_only=False).astype(bool)
            if known.any():
                yield batch.filter(pa.array(known)).select([*KEYS, "lo", "n"])
                batch = batch.filter(pa.array(~known))
            if not batch.num_rows:
                continue
            shard, key_id, key_text, lo, n = (np.asarray(batch.column(k)) for k in ("shard", *KEYS, "lo", "n"))
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            texts = batch.column("words").to_pylist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                if shard[a] != last and words >= shard_words:
                    yield from flush(held)
                    held, words = [], 0
                last = shard[a]
                own = [np.frombuffer(t, np.uint64) for t in texts[a:b]]
                held.append((own, key_id[a:b], key_text[a:b], lo[a:b].astype(np.int64), n[a:b].astype(np.int64)))
                words += sum(map(len, own))
        yield from flush(held)

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        key_id, key_text, lo, n = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3, 4))
        seg, place = match_shard([s for x in held for s in x[0]], key_id, n, window)
        order = np.lexsort((lo[seg] + place, key_text[seg], key_id[seg]))
        seg, place = seg[order], place[order]
        out = repeats.joined_runs(key_id[seg], key_text[seg], lo[seg] + place, np.ones(len(seg), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(out[2].astype(np.int32)), pa.array(out[3].astype(np.int32))], [*KEYS, "lo", "n"])

    return ordered.mapInArrow(run, "key_id long, key_text long, lo int, n int")


def repeated_passages(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """Runs of windows (key_id, key_text, lo, n) whose words also start in a document with a smaller id.

    Anchors route: runs whose anchor stands in one document only can't count and are dropped; all others go to the shard of
    their anchor, where the index decides. Before that only copies are combined: runs equal as a whole within one slice of
    texts, so that a group of copies sends a run once a slice, and, as they are hot keys, all runs of heavy anchors.
    """
    heavy = repeats.heavy_anchors(keyed, "words", window, gram, True)
    runs = repeats.scan(keyed, "words", window, gram, True, heavy)
    apart = runs.withColumn("c", F.when(F.col("heavy"), F.col("c")).otherwise(F.xxhash64(*KEYS)))
    settled = cut_table(repeats.settle(apart, True))
    known = settled.where("known").select(*KEYS, "lo", "n")
    segs = segments(repeats.with_runs(keyed, settled.where("not known"), "inner", ("lo", "n", "h", "heavy")), window)
    found = cut_table(known.unionByName(match(segs, window)))
    drop_tables(settled)
    return found


def remove_passages(docs: DataFrame, window: int = 50, gram: int = 25) -> DataFrame:
    """Removes every word covered by `window` consecutive words that also start in a document with a smaller doc_id.

    Words are what white space (space, tab to carriage return) parts, unchanged. Windows are judged on the input. Texts
    from which nothing is removed stay as they are; of others the kept words are joined by one space.

    Returns docs' columns with the new text and the columns n_words, n_removed long and kept_words string (the kept words
    joined by one space, for every row). Null texts have no words and stay null; a null doc_id is greater than all;
    documents that share a doc_id don't remove each other's words. Columns of docs with these names are replaced. An
    empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_words")]
    whole = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*[c for c in names if c != "text"]).alias("row"))
    keyed = doc_key(whole)
    covered = repeats.with_runs(keyed, repeated_passages(keyed, window, gram), "left")
    row = whole.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ts.slices(batches, "text"):
            texts = part.column("text")
            n_words, n_removed, kept, after = [], [], [], []
            for text, own in zip(texts.to_pylist(), part.column("runs"), strict=True):
                w = (text or "").encode().split()
                n_words.append(len(w))
                gone = 0
                if own.is_valid:
                    lo, n = (np.asarray(own.values.field(k), np.int64) for k in (0, 1))
                    s, e = ts.runs(lo, lo + n - 1 + window)
                    gone = int((e - s).sum())
                    edges = [0, *np.stack([s, e], 1).ravel().tolist(), len(w)]
                    w = [x for i in range(0, len(edges), 2) for x in w[edges[i] : edges[i + 1]]]
                n_removed.append(gone)
                kept.append(b" ".join(w).decode())
                after.append(kept[-1] if gone else text)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(after, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["row", "text", "n_words", "n_removed", "kept_words"],
            )

    out = covered.select("row", "text", "runs").mapInArrow(run, f"row {row}, text string, n_words long, n_removed long, kept_words string")
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in names], "n_words", "n_removed", "kept_words")
