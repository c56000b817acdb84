"""Cross-tokenizer alignment: which tokens of two tokenizers overlap in each text, and how often each pair of ids does so."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.encoders import WordEncoder, byte_encoder, piece_encoder
from faultline.llm.tables import cut_table
from faultline.llm.textscan import slices

#: Tokens of A that one lane of the lockstep takes. Long texts have many lanes, so a step always has much to do at once.
LANE = 256
#: Pairs of ids that a task holds while it counts.
HELD = 2_000_000


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_of: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (i, j) of overlapping tokens, and cuts: tokens of A and of B that end at one place.

    a_end, b_end: where the tokens of all texts end, in bytes from the start of the first text (A and B have the same
    bytes); a_of: where each text's tokens of A begin. A lane is a text, or a part of one that begins at a token of A. All
    lanes have a pointer into A and one into B; a step links the two tokens each lane points to, then moves the pointer whose
    token ends first, or both, which is a cut. Lanes that have come to their end leave the state.
    """
    parts = -(-np.diff(a_of) // lane)
    text = np.repeat(np.arange(len(parts)), parts)
    i = a_of[text] + lane * (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts))
    stop = np.minimum(i + lane, a_of[text + 1])
    j = np.searchsorted(b_end, np.where(i > 0, a_end[i - 1], 0) if len(i) else i, "right")
    links_i, links_j, cuts_i, cuts_j = [i[:0]], [i[:0]], [i[:0]], [i[:0]]
    while len(i):
        links_i.append(i)
        links_j.append(j)
        a, b = a_end[i], b_end[j]
        both = a == b
        cuts_i.append(i[both])
        cuts_j.append(j[both])
        i, j = i + (a <= b), j + (b <= a)
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    return tuple(map(np.concatenate, (links_i, links_j, cuts_i, cuts_j)))


class Tokens:
    """The tokens of a slice of texts by both tokenizers: ids, where they end in bytes, and where each text's begin."""

    def __init__(self, a: np.ndarray, a_of: np.ndarray, b: np.ndarray, b_of: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.a, self.a_of, self.b, self.b_of = a, a_of, b, b_of
        self.a_end, self.b_end = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
        self.i, self.j, self.cuts_i, self.cuts_j = lockstep(self.a_end, self.b_end, a_of)

    def text_of(self, i: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.a_of, i, "right") - 1

    def each(self, i: np.ndarray) -> np.ndarray:
        """How many of these tokens of A each text has."""
        return np.bincount(self.text_of(i), minlength=len(self.a_of) - 1)

    def pairs(self, b_ids: int) -> np.ndarray:
        """The id pair of each link as one number."""
        return self.a[self.i].astype(np.int64) * b_ids + self.b[self.j]

    def groups(self) -> list[str]:
        """The groups between cuts of each text: ids of A, a bar, ids of B; parted by semicolons."""
        a_ends, b_ends = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        a_ends[self.cuts_i], b_ends[self.cuts_j] = True, True
        last_a, last_b = np.flatnonzero(a_ends), np.flatnonzero(b_ends)
        place_a = np.arange(len(self.a)) + np.append(0, last_b + 1)[np.cumsum(a_ends) - a_ends]
        place_b = np.arange(len(self.b)) + (last_a + 1)[np.cumsum(b_ends) - b_ends]
        ids, marks = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        marks[place_a[last_a]], marks[place_b[last_b]] = ord("|"), ord(";")
        digits, width = decimals(max(1, len(str(int(ids.max(initial=0))))))
        rows, n = digits[ids], width[ids]
        rows[np.arange(len(ids)), n] = marks
        data = rows[np.arange(rows.shape[1]) <= n[:, None]].tobytes()
        ends = np.append(0, np.cumsum(n + 1))
        at = ends[self.a_of + self.b_of].tolist()
        return [data[x : max(x, y - 1)].decode("ascii") for x, y in zip(at, at[1:], strict=False)]


_DECIMALS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def decimals(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of all numbers of at most `width` digits, a row each with room for a mark, and how many digits there are."""
    if width not in _DECIMALS:
        said = np.array([str(v) for v in range(10**width)], f"S{width + 1}")
        _DECIMALS[width] = said.view(np.uint8).reshape(-1, width + 1), np.char.str_len(said)
    return _DECIMALS[width]


def rows_of(ids: np.ndarray, of: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of) - 1, [None, pa.py_buffer(of.astype(np.int64) * 4), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())


class Alignment(NamedTuple):
    """texts: a row a document. pairs: (pair, n, best): how often two ids (A's times the number of B's ids, plus B's) are linked,
    and whether that is the most for the id of B. rest: (key, n_best, count_sum) to be added for links of rarer pairs, or None."""

    texts: DataFrame
    pairs: DataFrame
    rest: DataFrame | None

    def with_rest(self, texts: DataFrame) -> DataFrame:
        """texts (key, n_best, count_sum and others) with what the rarer pairs add."""
        if self.rest is None:
            return texts.drop("key")
        more = self.rest.select("key", F.col("n_best").alias("_best"), F.col("count_sum").alias("_sum"))
        both = texts.join(more, "key", "left")
        return both.withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}).drop("key", "_best", "_sum")


def encoded(docs: DataFrame, encoders: Callable[[], tuple[WordEncoder, WordEncoder]], id_column: str, text_column: str) -> DataFrame:
    """(key long, id, a binary, b binary): the ids of both tokenizers as 32-bit numbers; none where their bytes aren't space and text."""
    kind = docs.schema[id_column].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = encoders()
        for part in slices(batches, "text", 1 << 20):
            texts = part.column("text").fill_null("").to_pylist()
            (a, a_of), (b, b_of) = one.encode(texts, True), other.encode(texts, True)
            a_at, b_at = a_of.tolist(), b_of.tolist()
            a_bytes, b_bytes = list(map(one.table.__getitem__, a.tolist())), list(map(other.table.__getitem__, b.tolist()))
            keep = np.zeros(len(texts), bool)
            for k, text in enumerate(texts):
                want = b" " + text.encode()
                keep[k] = text != "" and b"".join(a_bytes[a_at[k] : a_at[k + 1]]) == want and b"".join(b_bytes[b_at[k] : b_at[k + 1]]) == want
            if not keep.all():
                (a, a_of), (b, b_of) = kept(a, a_of, keep), kept(b, b_of, keep)
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("id"), rows_of(a, a_of), rows_of(b, b_of)], ["key", "id", "a", "b"])

    picked = docs.select(F.monotonically_increasing_id().alias("key"), docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    return picked.mapInArrow(encode, f"key long, id {kind}, a binary, b binary")


def kept(ids: np.ndarray, of: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(of)
    return ids[np.repeat(keep, n)], np.append(0, np.cumsum(np.where(keep, n, 0)))


def align(docs: DataFrame, a_file: str, b_file: str, id_column: str = "doc_id", text_column: str = "text", frequent: int = 1 << 21) -> Alignment:
    """Aligns the tokens of a byte-level BPE (A, of space and text) with those of a piece model (B) in every whole text.

    texts has (key, id, n_a, n_b, n_groups, n_links, n_best, count_sum long, groups string): the tokens of A and B, the groups
    that byte offsets where both end cut them into, the overlapping pairs (links), how many of these have a pair whose count in
    the corpus is the highest of its id of B (ties included), and the sum of the counts over the links.

    Texts are encoded once, into a table of ids in the shared folder. Pairs are counted in a task before they are shuffled.
    Counts go back to the links in two ways: the most frequent pairs, at most `frequent` of them (two 64-bit numbers each), are
    broadcast; links of all others, each of which is rare, meet their counts in a join (rest; see with_rest). With no more
    pairs than `frequent` there is no rest.

    Null and empty texts, and those whose tokens don't give back space and text (that hold U+2581, for one), have no tokens:
    zeros and ''. Null and repeated ids pass through, each row on its own. Other columns are not read. An empty table gives no
    rows. One text, with its tokens, is in memory at a time beside a slice of 1 MB. The files are the same on all executors.
    """
    spark = docs.sparkSession
    encoders = lambda: (byte_encoder(a_file, False), piece_encoder(b_file))
    b_ids = len(piece_encoder(b_file).table)
    tokens = cut_table(encoded(docs, encoders, id_column, text_column), compression="zstd")

    def tokens_of(part: pa.RecordBatch) -> Tokens:
        one, other = encoders()
        ids = []
        for name in ("a", "b"):
            column = part.column(name)
            of = np.append(0, np.cumsum(np.array([len(x) for x in column.to_pylist()], np.int64))) // 4
            ids += [np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(np.int64), of]
        return Tokens(*ids, one.sizes, other.sizes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0
        for part in slices(batches, "a", 2 << 20):
            own = np.unique(tokens_of(part).pairs(b_ids), return_counts=True)
            held.append(own)
            total += len(own[0])
            if total > 2 * HELD:
                held = [summed(held)]
                total = len(held[0][0])
                if total > HELD:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held.pop())), ["pair", "n"])
                    total = 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, summed(held))), ["pair", "n"])

    counts = cut_table(tokens.select("a", "b").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.pmod("pair", F.lit(b_ids))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B at most
    pairs = counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    size = F.floor(F.log2("n") * 4).cast("int")
    least = frequent_size(counts.groupBy(size.alias("size")).count(), frequent)
    table = pairs.where(size >= least).select("pair", (F.col("n") * 2 + F.col("best").cast("long")).alias("v")).toArrow()
    keys = table.column("pair").to_numpy()
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((keys[order], table.column("v").to_numpy()[order]))
    kind = docs.schema[id_column].dataType.simpleString()

    def looked_up(own: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs, their counts doubled plus best (0 where not known), and each link's place among them."""
        distinct, place = np.unique(own.pairs(b_ids), return_inverse=True)
        keys, values = known.value
        at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
        return distinct, np.where(keys[at] == distinct, values[at], 0) if len(keys) else np.zeros(len(distinct), np.int64), place

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "a", 2 << 20):
            own = tokens_of(part)
            _, values, place = looked_up(own)
            text, v, n = own.text_of(own.i), values[place], len(part)
            # Floating-point sums are exact below 2**53, so the counts are summed in two halves.
            sums = [np.bincount(text, w, n).astype(np.int64) for w in ((v >> 1) & 0x3FFFFFF, v >> 27)]
            numbers = [np.diff(own.a_of), np.diff(own.b_of), own.each(own.cuts_i), own.each(own.i), np.bincount(text, v & 1, n).astype(np.int64), sums[0] + (sums[1] << 26)]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("id"), *[pa.array(x.astype(np.int64)) for x in numbers], pa.array(own.groups(), pa.string())], ["key", "id", *NUMBERS, "groups"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "a", 2 << 20):
            own = tokens_of(part)
            distinct, values, place = looked_up(own)
            far = np.flatnonzero(values[place] == 0)
            rows, n = np.unique(own.text_of(own.i[far]) * len(distinct) + place[far], return_counts=True)
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(rows // max(len(distinct), 1))), pa.array(distinct[rows % max(len(distinct), 1)]), pa.array(n)], ["key", "pair", "times"])

    texts = tokens.mapInArrow(told, f"key long, id {kind}, " + ", ".join(f"{c} long" for c in NUMBERS) + ", groups string").withColumnRenamed("id", id_column)
    rest = None
    if least > 0:
        met = tokens.select("key", "a", "b").mapInArrow(others, "key long, pair long, times long").join(pairs.where(size < least), "pair")
        rest = met.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    return Alignment(texts, pairs, rest)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(n, new) if len(new) else n


def frequent_size(sizes: DataFrame, most: int) -> int:
    """The least size class (four for each doubling of a count) such that at most `most` pairs are of it or a larger one; 0 if all are."""
    found = sorted(((r["size"], r["count"]) for r in sizes.collect()), reverse=True)  # some 250 classes at most
    taken = 0
    for size, n in found:
        taken += n
        if taken > most:
            return size + 1
    return 0
