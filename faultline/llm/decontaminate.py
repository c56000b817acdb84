"""Benchmark decontamination with an FM-index for each shard of the training texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import textscan as ts
from faultline.llm.fmindex import FMIndex
from faultline.llm.tables import doc_key

FOUND = "key_id long, key_text long, n_words long, spans array<struct<start: long, end: long>>, items array<string>"


class Phrases:
    """The windows of a block of benchmark items, as numbers of the words they hold."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        data, off = ts.buffer(pa.array(texts, pa.string()))
        low = ts.LOWER[data]
        starts, ends, of = ts.words(low, off, ts.ALNUM)
        h = ts.hashes(low, starts, ends)
        self.vocab, number = np.unique(h, return_inverse=True)
        number = number + 1
        self.ids = ids
        rows: dict[tuple[int, ...], set[int]] = {}
        for i in range(len(texts)):
            w = number[of[i] : of[i + 1]].tolist()
            size = min(window, len(w))
            for k in range(len(w) - size + 1 if size else 0):
                rows.setdefault(tuple(w[k : k + size]), set()).add(i)
        by: dict[int, list[tuple[tuple[int, ...], list[int]]]] = {}
        for w, items in rows.items():
            by.setdefault(len(w), []).append((w, sorted(items)))
        self.patterns = []  # length, patterns, offsets into the items, items
        for size, found in sorted(by.items()):
            owners = [items for _, items in found]
            self.patterns.append((size, np.array([w for w, _ in found], np.int64), np.concatenate(([0], np.cumsum([len(x) for x in owners]))), np.array(sum(owners, []), np.int64)))
        self.shortest = min(by, default=0)

    def scan(self, texts: pa.Array) -> list[tuple[int, list[dict], list[str]]]:
        """For each text of a shard: words, merged hit spans (in words), ids of the items found."""
        data, off = ts.buffer(texts)
        low = ts.LOWER[data]
        starts, ends, of = ts.words(low, off, ts.ALNUM)
        n_words = np.diff(of)
        out = [(int(n), [], []) for n in n_words]
        if not self.shortest or not len(starts):
            return out
        h = ts.hashes(low, starts, ends)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        number = np.where(self.vocab[at] == h, at + 1, 0)
        # Words of no item part the text: only runs that can hold a phrase are indexed, each with a 0 after it.
        doc = np.repeat(np.arange(len(n_words)), n_words)
        known = number > 0
        new = known & np.concatenate(([True], ~known[:-1] | (doc[1:] != doc[:-1])))
        last = known & np.concatenate((~known[1:] | (doc[1:] != doc[:-1]), [True]))
        begin, end = np.flatnonzero(new), np.flatnonzero(last) + 1
        long_enough = end - begin >= self.shortest
        begin, end = begin[long_enough], end[long_enough]
        if not len(begin):
            return out
        size = end - begin + 1
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        text = number[np.minimum(place, len(number) - 1)]
        text[np.cumsum(size) - 1] = 0
        index = FMIndex(text, len(self.vocab) + 1)
        hit_from, hit_to, pairs = [], [], []
        for length, patterns, owner_off, owners in self.patterns:
            lo, hi = index.search(patterns)
            found = np.flatnonzero(hi > lo)
            if not len(found):
                continue
            n = hi[found] - lo[found]
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[found], n)
            word = place[index.locate(rows)]
            hit_from.append(word)
            hit_to.append(word + length)
            which = np.repeat(found, n)
            d = doc[word]
            own = owner_off[which + 1] - owner_off[which]
            item = owners[np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(owner_off[which], own)]
            pairs.append(np.unique(np.repeat(d, own) * len(self.ids) + item))
        if not hit_from:
            return out
        s, e = np.concatenate(hit_from), np.concatenate(hit_to)
        order = np.lexsort((s, doc[s]))
        s, e = s[order], e[order]
        for d in np.unique(doc[s]).tolist():
            a, b = np.searchsorted(doc[s], [d, d + 1])
            x, y = ts.runs(s[a:b] - of[d], e[a:b] - of[d])
            out[d][1].extend({"start": int(p), "end": int(q)} for p, q in zip(x, y, strict=True))
        for p in np.unique(np.concatenate(pairs)).tolist():
            out[p // len(self.ids)][2].append(self.ids[p % len(self.ids)])
        return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    block_words: int = 2_000_000,
    shard_bytes: int = 1 << 20,
) -> DataFrame:
    """Finds every benchmark phrase in every document.

    Words are runs of 0-9, a-z (after lower-casing A-Z) and characters beyond ASCII. A phrase is `window` consecutive
    words of an item, or all words of a shorter one. Returns docs' columns and n_words long, spans (merged ranges of
    words inside phrases), items (the sorted distinct ids, as strings, of the items found).

    Each task indexes shards of at most shard_bytes of text (or one longer text) and searches all phrases backward in
    them, so documents are not shuffled. The benchmark is counted first and sent in blocks of at most block_words words
    (an item is not cut), each a scan of its own; with more than one block the findings are merged by document.

    Null texts have no words. An item whose id is null has the id ''. Rows of one id and text get equal findings.
    Columns of docs called n_words, spans or items are replaced. Empty tables: no rows, or no hits.
    """
    found = find_phrases(docs, benchmark, window, block_words, shard_bytes)
    keep = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    keyed = doc_key(docs.select("doc_id", "text", F.struct(*keep).alias("row")))
    return keyed.join(found, ["key_id", "key_text"]).select("row.*", "n_words", "spans", "items")


def blocks_of(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n")).first()["n"] or 0
    n = -(-total // (block_words * 4)) if total else 1
    return [items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def scan_block(docs: DataFrame, block: DataFrame, window: int, shard_bytes: int, keep_text: bool = False) -> DataFrame:
    """The findings of one block of items, by a narrow job over docs (id columns and text)."""
    rows = block.collect()  # at most a block, see blocks_of
    phrases = Phrases([r["id"] for r in rows], [r["text"] for r in rows], window)
    sent = docs.sparkSession.sparkContext.broadcast(phrases)
    others = [f for f in docs.schema.fields if f.name != "text" or keep_text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", n_words long, spans array<struct<start: long, end: long>>, items array<string>"
    names = [f.name for f in others]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for part in ts.slices(batches, "text", shard_bytes):
            got = sent.value.scan(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in names), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], span), pa.array([g[2] for g in got], pa.list_(pa.string()))],
                [*names, "n_words", "spans", "items"],
            )

    return docs.mapInArrow(scan, schema)


def find_phrases(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 2_000_000, shard_bytes: int = 1 << 20) -> DataFrame:
    """(key_id, key_text, n_words, spans, items) for each distinct id and text."""
    return merge_findings([scan_block(doc_key(docs.select("doc_id", "text")).drop("doc_id"), b, window, shard_bytes) for b in blocks_of(benchmark, block_words)], ["key_id", "key_text"])


def merge_findings(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    merged = every.distinct().groupBy(*keys).agg(F.max("n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Spans of several blocks can overlap: each is cut to what lies beyond the ones before it.
    cut_spans = F.aggregate(
        "spans",
        F.array().cast("array<struct<start: bigint, end: bigint>>"),
        lambda acc, s: F.when(s["end"] <= F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1)), acc).otherwise(
            F.concat(acc, F.array(F.struct(F.greatest(s["start"], F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))).alias("start"), s["end"].alias("end"))))
        ),
    )
    return merged.withColumn("spans", cut_spans)


def phrase_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 2_000_000, shard_bytes: int = 1 << 20) -> DataFrame:
    """A row for each row of docs, without their texts: doc_id, n_words, spans, items. No shuffle while the benchmark is one block."""
    blocks = blocks_of(benchmark, block_words)
    if len(blocks) == 1:
        got = scan_block(docs.select("doc_id", F.col("text").cast("string").alias("text")), blocks[0], window, shard_bytes)
        return got.withColumn("items", F.array_sort(F.array_distinct("items")))
    keyed = doc_key(docs.select("doc_id", "text"))
    return keyed.drop("text").join(merge_findings([scan_block(keyed.drop("doc_id"), b, window, shard_bytes) for b in blocks], ["key_id", "key_text"]), ["key_id", "key_text"]).drop("key_id", "key_text")


def remove_phrases(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 2_000_000, shard_bytes: int = 1 << 20) -> DataFrame:
    """docs without the text from the first to the last word of each span that benchmark phrases cover.

    Documents of which no word is left go; null texts and texts without hits stay as they are. With a benchmark of one
    block this is a narrow job.
    """
    blocks = blocks_of(benchmark, block_words)
    texts = docs.select(F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    if len(blocks) == 1:
        found = scan_block(texts, blocks[0], window, shard_bytes, keep_text=True)
    else:
        keyed = doc_key(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row")))
        found = keyed.join(find_phrases(docs, benchmark, window, block_words, shard_bytes), ["key_id", "key_text"])
    row = texts.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ts.slices(batches, "text", shard_bytes):
            data, off = ts.buffer(part.column("text"))
            starts, ends, of = ts.words(ts.LOWER[data], off, ts.ALNUM)
            texts, keep = part.column("text").to_pylist(), []
            for i, spans in enumerate(part.column("spans").to_pylist()):
                gone = sum(s["end"] - s["start"] for s in spans)
                keep.append(not gone or gone < of[i + 1] - of[i])
                if gone:
                    raw, base = texts[i].encode(), off[i]
                    edges = [0]
                    for s in spans:
                        edges += [int(starts[of[i] + s["start"]] - base), int(ends[of[i] + s["end"] - 1] - base)]
                    edges.append(len(raw))
                    texts[i] = b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)).decode()
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], ["row", "text"]).filter(pa.array(keep))

    out = found.select("row", "text", "spans").mapInArrow(run, f"row {row}, text string")
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
