"""Spelling variants: words one edit apart, found by scanning sorted word lists, and grouped by frequency."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.tables import cut_table, drop_tables
from faultline.llm.textscan import slices

#: Words that a task counts before it passes them on.
HELD = 400_000
#: Code points of sorted words that are scanned at once.
SCANNED = 4_000_000


def word_counts(docs: DataFrame, least_length: int = 6, every: int = 199, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): maximal runs of Latin letters in all texts, A-Z lower-cased, with at least least_length code points.

    A run whose crc32 together with its document's id is divisible by `every` loses one code point, which this number picks
    (every=0: none does). Null texts have no words; a null id is written as an empty string. Counts are combined in a task
    (the words of one slice of 1 MB and HELD more at a time) before they are shuffled.
    """
    run = re.compile(rf"[a-zÀ-ÿ]{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for part in slices(batches, "text"):
            for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                own = Counter(run.findall(text.lower() if text.isascii() else text.encode().lower().decode()))
                if every:
                    start = zlib.crc32(f"{key}:".encode())
                    for word in list(own):
                        h = zlib.crc32(word.encode(), start)
                        if h % every == 0:
                            n, at = own.pop(word), h % len(word)
                            if len(word) > least_length:
                                found[word[:at] + word[at + 1 :]] += n
                found.update(own)
            if len(found) > HELD:
                yield counted(found)
                found.clear()
        yield counted(found)

    def counted(found: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    picked = docs.select(F.coalesce(docs[id_column].cast("string"), F.lit("")).alias("id"), docs[text_column].cast("string").alias("text"))
    return picked.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dealt(words: DataFrame, most: int) -> DataFrame:
    """(m, x, y, key, word, n): lists of words among which all pairs one edit apart meet, in each list those whose edit is in [x, y).

    Two words one edit apart, the shorter of length m, share what is before the edit and what is after it. So words of length m
    and m + 1 meet by the m they have in mind and all that lies outside of [x, y): at first one half of the word, and where
    over `most` words share the other half, a quarter, and so on. Lists that leave one place open hold at most one word for each
    letter, or for each two letters: no list grows with the vocabulary.
    """
    length = F.char_length("word")
    m = F.explode(F.array(length, length - 1)).alias("m")
    half = F.floor(F.col("m") / 2).cast("int")

    def keyed(rows: DataFrame) -> DataFrame:
        outside = F.xxhash64("m", "x", "y", F.left("word", F.col("x")), F.expr("right(word, m - y)"))
        return rows.select("m", "x", "y", outside.alias("key"), "word", "n")

    def parted(rows: DataFrame, at: Column) -> DataFrame:
        halves = F.explode(F.array(F.struct(F.col("x"), at.alias("y")), F.struct(at.alias("x"), F.col("y")))).alias("s")
        return keyed(rows.withColumn("s", halves).select("m", "s.x", "s.y", "word", "n"))

    shortest = words.agg(F.min(length)).first()[0] or 0
    rows = cut_table(parted(words.select("word", "n", m).where(F.col("m") >= shortest).withColumns({"x": F.lit(0), "y": F.col("m")}), half))
    done = []
    while True:
        crowded = rows.where("y - x > 1").groupBy("m", "x", "y", "key").agg(F.count("*").alias("size")).where(F.col("size") > most).select("m", "x", "y", "key")
        crowded = cut_table(crowded)
        if crowded.isEmpty():
            done.append(rows)
            break
        by = ["m", "x", "y", "key"]
        done.append(rows.join(crowded, by, "left_anti"))
        rows = cut_table(parted(rows.join(crowded, by, "left_semi").drop("key"), F.floor((F.col("x") + F.col("y")) / 2).cast("int")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def near_words(words: DataFrame, most: int = 20_000) -> DataFrame:
    """(word, n, other, other_n): each pair of words (word, n; distinct) that differ by one inserted, deleted or replaced code point, once.

    Words are of Latin letters up to U+00FF and of any length. most: see dealt.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            lists = np.stack([held.column(c).to_numpy() for c in ("m", "x", "y", "key")])
            open_ = int(np.flatnonzero(np.append(True, (lists[:, 1:] != lists[:, :-1]).any(axis=0)))[-1])  # the last list can go on
            if (open_ >= 50_000) or (open_ and held.nbytes > SCANNED):
                yield from scanned(held.slice(0, open_))
                held = held.slice(open_).combine_chunks()
        if held is not None:
            yield from scanned(held)

    rows = dealt(words, most).repartition("m", "x", "y", "key").sortWithinPartitions("m", "x", "y", "key", "word")
    return rows.mapInArrow(scan, "word string, n long, other string, other_n long")


def scanned(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The near pairs of whole lists (m, x, y, key, word, n), sorted by these."""
    m, x, y, key = (rows.column(c).to_numpy() for c in ("m", "x", "y", "key"))
    first = np.append(True, (m[1:] != m[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (key[1:] != key[:-1]))
    starts = np.flatnonzero(first)
    several = np.diff(np.append(starts, len(m))) > 1
    lo = 0
    while lo < len(starts):  # lists of one m, about SCANNED code points at once
        width = int(m[starts[lo]]) + 1
        hi = lo
        while hi < len(starts) and m[starts[hi]] + 1 == width and (hi == lo or starts[hi] - starts[lo] < SCANNED // width):
            hi += 1
        at = np.flatnonzero(np.repeat(several[lo:hi], np.diff(np.append(starts, len(m))[lo : hi + 1]))) + starts[lo]
        if len(at):
            part = rows.take(pa.array(at))
            words = part.column("word").to_pylist()
            a, b = near_pairs(words, width, first[at], x[at], y[at])
            names, n = part.column("word").combine_chunks(), part.column("n").combine_chunks()
            one, other = pa.array(a), pa.array(b)
            yield pa.RecordBatch.from_arrays([names.take(one), n.take(one), names.take(other), n.take(other)], ["word", "n", "other", "other_n"])
        lo = hi


def near_pairs(words: list[str], width: int, first: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words one edit apart in sorted lists of words of length width - 1 and width; first: where lists begin.

    Every word walks down the rest of its list, all at once. It keeps the band (one place each side of the diagonal) of its
    edit matrix with the word it is at, a row for each letter of that word. The next word shares a prefix with that one, whose
    rows stay as they are. Once a row has no value under two, no word with this prefix can be near, and the walk goes on behind
    all of them. A pair counts in the list whose [x, y) has the edit, that is where the two words first differ.
    """
    count = len(words)
    size = np.fromiter(map(len, words), np.int64, count)
    code = np.zeros((count + 1, width + 2), np.uint8)  # a column of zeros before the letters and one behind them
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    code[np.repeat(np.arange(count), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + 1] = flat
    same = code[1:count, 1:-1] == code[: count - 1, 1:-1]
    shared = np.full(count + 1, -1, np.int64)  # letters shared with the word before; -1 where a list begins
    shared[1:count] = np.minimum(np.where(same.all(axis=1), width, same.argmin(axis=1)), np.minimum(size[1:], size[:-1]))
    shared[:count][first] = -1
    # behind[k, i]: the first word after k that doesn't share i letters with the word before it.
    stops = np.where(shared[:, None] < np.arange(width + 1), np.arange(count + 1)[:, None], count)
    behind = np.minimum.accumulate(stops[::-1], axis=0)[::-1][1:].astype(np.int32)
    size = np.append(size, 0)

    q = np.flatnonzero(shared[1 : count + 1] >= 0)
    at = q + 1
    depth = shared[at]
    differ = depth.copy()
    # Bands of a word's rows with its own prefixes: 1, 0, 1.
    band = np.ones((len(q), width + 1, 3), np.int8)
    band[:, :, 1] = 0
    band[:, 0, 0] = 2
    row = np.arange(len(q))
    found_a, found_b = [q[:0]], [q[:0]]
    while len(q):
        letter = code[at, depth + 1]
        before = band[row, depth]
        left = before[:, 0] + (letter != code[q, depth])
        left = np.minimum(left, before[:, 1] + 1)
        mid = np.minimum(np.minimum(before[:, 1] + (letter != code[q, depth + 1]), before[:, 2] + 1), left + 1)
        right = np.minimum(before[:, 2] + (letter != code[q, np.minimum(depth + 2, width + 1)]), mid + 1)
        depth = depth + 1
        now = np.minimum(np.stack((left, mid, right), axis=1), 2)
        band[row, depth] = now
        dead = now.min(axis=1) > 1
        whole = ~dead & (depth == size[at])
        if whole.any():
            w = np.flatnonzero(whole)
            place = differ[w]
            near = (now[w, size[q[w]] - size[at[w]] + 1] == 1) & (np.minimum(size[q[w]], size[at[w]]) == width - 1) & (x[q[w]] <= place) & ((place < y[q[w]]) | (y[q[w]] == width - 1))
            found_a.append(q[w[near]])
            found_b.append(at[w[near]])
        to = np.where(dead, behind[at, depth], np.where(whole, at + 1, at))
        moved = dead | whole
        at = to
        reach = shared[at]
        depth = np.where(moved, reach, depth)
        differ = np.where(moved, np.minimum(differ, reach), differ)
        live = depth >= 0
        if not live.all():
            q, at, depth, differ, row = q[live], at[live], depth[live], differ[live], row[live]
    return np.concatenate(found_a), np.concatenate(found_b)


def spelling_groups(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199, factor: int = 5, most: int = 20_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of at least least_length code points that occurs least_count times.

    n_near: the words one edit apart. form: the most frequent of these (ties: the first in code-point order) if it is at least
    `factor` times as frequent, else null; form_n its count. root: where forms lead to in the end, the word itself without one.

    Counts are over all texts (see word_counts). Only the vocabulary is shuffled after that, and no list of words that meet is
    longer than `most` but by the bound of dealt. A word has at most some 64 letters * (2 * its length + 1) neighbours, so no
    key of the joins is hot. Chains of forms, whose counts grow by `factor` each step, are followed by doubling. Null texts have
    no words; an empty table gives no rows; equal rows count as often as they stand there.
    """
    words = cut_table(word_counts(docs, least_length, every, id_column, text_column).where(F.col("n") >= least_count))
    pairs = cut_table(near_words(words, most))
    swapped = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    first = F.min(F.struct((-F.col("other_n")).alias("down"), "other"))
    near = pairs.unionByName(swapped).groupBy("word").agg(F.max("n").alias("n"), F.count("*").alias("n_near"), first.alias("best"))
    formed = -F.col("best.down") >= F.lit(factor) * F.col("n")
    near = cut_table(near.select("word", "n_near", F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.down")).alias("form_n")))
    hops = cut_table(near.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        farther = cut_table(hops.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ended = farther.where("moved").isEmpty()
        drop_tables(hops)
        hops = farther.select("word", "root")
        hops.cut_path = farther.cut_path
        if ended:
            break
    drop_tables(pairs)
    rows = words.join(near, "word", "left").join(hops, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
