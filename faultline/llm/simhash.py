"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm import textscan as ts
from faultline.operators.components import components
from faultline.llm.tables import cut_table, drop_tables
from faultline.llm.textscan import slices

HASH_SEED = 42
#: Sets of fewer shingles are not judged by their bits.
SMALL = 32


def fingerprint_of(text: bytes, shingle: int) -> int:
    """The 64-bit SimHash of a text as a signed number; without words 0."""
    import xxhash

    h, words = xxhash.xxh64_intdigest, text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [words]
    else:
        grams = zip(*(words[i:] for i in range(shingle)), strict=False)
    codes = np.array([h(b" ".join(g), HASH_SEED) for g in grams], ">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(codes), 1 << 16):
        ones += np.unpackbits(codes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(codes)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp long) for each row; words are what white space parts, lower-cased (A-Z). Null texts have no words."""
    kind = docs.schema[id_column].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column("text").fill_null("").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([fingerprint_of(t, shingle) for t in texts], pa.int64())], ["id", "fp"])

    picked = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    return picked.mapInArrow(scan, f"id {kind}, fp long").withColumnRenamed("id", id_column)


def ball(fp, radius: int):
    """All 64-bit values within `radius` (0 to 2) bits of fp."""
    bits = F.sequence(F.lit(0), F.lit(63))
    one = F.transform(bits, lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    if radius == 0:
        return F.array(fp)
    if radius == 1:
        return F.concat(F.array(fp), one)
    two = F.flatten(
        F.transform(
            bits,
            lambda i: F.transform(
                F.filter(bits, lambda j: j > i),
                lambda j: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j)),
            ),
        )
    )
    return F.concat(F.array(fp), one, two)


def near_links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Links between distinct fingerprints (column fp) that keep all within `bits` bits connected: (a, b), a < b.

    Every fingerprint emits all values within half the radius; two within `bits` of each other meet at one of them. The
    values are the shuffle key, so a group holds at most the fingerprints of one ball (65 for radius 1), whatever the
    number of copies. In each group neighbours in sorted order are linked, which keeps the group connected, if they
    verify; for an odd radius, where ends of a group can be further apart, all its pairs are verified.
    """
    half = (bits + 1) // 2
    met = fps.select("fp", F.explode(ball(F.col("fp"), half)).alias("v"))
    if bits == 2 * half:
        pairs = met.select(F.lag("fp").over(Window.partitionBy("v").orderBy("fp")).alias("a"), F.col("fp").alias("b")).where("a is not null")
    else:
        pairs = met.alias("x").join(met.alias("y"), "v").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).where("a < b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)


def simhash_classes(docs: DataFrame, shingle: int = 5, bits: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row: the smallest id that links of at most `bits` differing bits reach.

    Copies are one fingerprint before anything is compared. Rows whose id is null keep it; they count for the links,
    and component_id is null where no id is known in a component. An empty table gives no rows.
    """
    fps = cut_table(fingerprints(docs, shingle, id_column, text_column))
    least = fps.groupBy("fp").agg(F.min(id_column).alias("least"))
    linked = components(near_links(least.select("fp"), bits)).withColumnRenamed("node", "fp")
    grouped = least.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = grouped.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(id_column, "fp", "component_id")


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's word shingles, sorted, and where each text's begin.

    Words are what white space parts, A-Z lower-cased. A text of fewer words is one shingle, one without words has none.
    """
    data, off = ts.buffer(texts)
    low = ts.LOWER[data]
    starts, ends, of = ts.words(low, off, ~ts.SPACES)
    n = np.diff(of)
    grams = np.where(n > shingle, n - shingle + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), grams)
    at = np.arange(len(text)) - np.repeat(np.cumsum(grams) - grams, grams) + of[text]
    codes = ts.Rolling(ts.hashes(low, starts, ends)).of(at, np.minimum(at + shingle, of[text + 1]))
    order = np.lexsort((codes, text))
    codes, text = codes[order], text[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (text[1:] != text[:-1])
    return codes[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def set_names(codes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A hash of each set of shingles; that of no shingles is 0."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ts.mix(codes + ts.BASE))))
    return ts.mix(sums[of[1:]] - sums[of[:-1]]).view(np.int64)


#: For each value of a byte its eight bits as eight counters of a byte each: up to 255 of them can be added at once.
COUNTERS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
PIECE, CHUNK = 128, 1 << 15


def long_fingerprints(codes: np.ndarray, of: np.ndarray, lanes: int) -> np.ndarray:
    """The SimHash of 64 * lanes bits of each set of shingles, a row each of signed 64-bit numbers; without shingles all 0."""
    n = np.diff(of)
    some = np.flatnonzero(n)
    out = np.zeros((len(n), lanes), np.int64)
    edges = np.union1d(of[:-1][some], np.arange(0, len(codes), PIECE))
    first = np.searchsorted(edges, of[:-1][some])
    offsets = np.arange(lanes, dtype=np.uint64) * ts.BASE
    for lane in range(lanes if len(some) else 0):
        parts = []
        for k in range(0, len(codes), CHUNK):
            own = edges[np.searchsorted(edges, k) : np.searchsorted(edges, k + CHUNK)] - k
            block = ts.mix(codes[k : k + CHUNK] + offsets[lane]).view(np.uint8).reshape(-1, 8)
            parts.append(np.add.reduceat(COUNTERS[block], own, axis=0))
        ones = np.add.reduceat(np.concatenate(parts).view(np.uint8).reshape(-1, 64).astype(np.int64), first, axis=0)
        out[some, lane] = np.packbits(2 * ones > n[some, None], axis=1).view(">i8")[:, 0]
    return out


def text_sets(docs: DataFrame, shingle: int, lanes: int) -> DataFrame:
    """(doc_id, node, n, fp array<long>, codes array<int>) for each row: the name of its set of shingles, their number, its bits, the set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            codes, of = shingle_sets(part.column("text"), shingle)
            bits = pa.ListArray.from_arrays(pa.array(np.arange(0, lanes * len(part) + 1, lanes), pa.int32()), pa.array(long_fingerprints(codes, of, lanes).ravel()))
            sets = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(codes.astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(set_names(codes, of)), pa.array(np.diff(of)), bits, sets], ["doc_id", "node", "n", "fp", "codes"])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, node long, n long, fp array<long>, codes array<int>")


def similar_nodes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, lanes: int = 12, blocks_at_once: int = 12, tile: int = 2000, lot: int = 1 << 17) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) for each row and (node, least, root) for each distinct set of shingles: near-duplicates have one root.

    A Jaccard similarity of 0.8 leaves some 15 % of a SimHash's bits different, far beyond the balls that can be emitted
    for one 64-bit fingerprint. So texts get 64 * lanes bits; each 32-bit block of these is a fingerprint of its own, whose
    ball of radius 1 is emitted once for all texts that share it, and two texts meet if they differ by 2 bits at most in
    any block. With 24 blocks a pair of similarity 0.8 meets with probability 0.95, of 0.85 with 0.99. Pairs that meet are
    decided by the Jaccard similarity of their sets of shingles (named by 32 bits). Before that go pairs whose numbers of
    shingles rule it out, and pairs that differ in more bits than expected by 2.5 standard deviations (1 in 160 of those of
    similarity 0.8, 1 in 2,000 of those of 0.82); sets of under SMALL shingles, whose bits are no fair sample, are spared that
    and decided at once by their shingles, which are few enough to travel with them. A pair counts in the first block it meets in.

    Blocks are taken blocks_at_once at a time, which bounds the disk that their balls take. Every pair that meets and is
    not of one class yet is settled, in two steps: with the first blocks few pairs of each group, which join near copies to
    classes (with later blocks nearly all of these are of one class already), then all pairs across classes, large groups in
    tiles of `tile` texts. Sets travel to at most max(lot, texts / 2) pairs at a time.

    Rows without words are one node. Null texts have no words. An empty table gives no rows. Both results are tables of
    cut_table; all others are removed.
    """
    wide = cut_table(text_sets(docs, shingle, lanes))
    rows = cut_table(wide.select("doc_id", "node"))
    nodes = cut_table(wide.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("codes").alias("codes"), F.min("doc_id").alias("least")))
    drop_tables(wide)
    lot = max(lot, nodes.count() // 2)
    alike = alike_in_bits(similarity, 64 * lanes)
    known = nodes.select("node", "n", "fp", F.when(F.col("n") < SMALL / similarity, F.col("codes")).alias("few"))
    classes = cut_table(nodes.select("node", F.col("node").alias("root")))

    settled: list[DataFrame] = []  # pairs decided already

    def merged(classes: DataFrame, pairs: DataFrame) -> DataFrame:
        """The classes, joined where any of the pairs (a, b, root_a, root_b) are similar. Pairs decided before are left out."""
        if settled:
            pairs = pairs.join(reduce(DataFrame.unionByName, settled).select("a", "b"), ["a", "b"], "left_anti")
        pairs = cut_table(pairs)
        settled.append(pairs)
        links = [similar_pairs(pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(lots)) == k), nodes, similarity) for lots in [-(-pairs.count() // lot)] for k in range(lots)]
        if not links:
            return classes
        every = reduce(DataFrame.unionByName, links)
        joined = components(every.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        out = cut_table(classes.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        drop_tables(classes, joined, *links)
        return out

    for start in range(0, 2 * lanes, blocks_at_once):
        blocks = block_codes(nodes, start, blocks_at_once)
        reps = cut_table(blocks.groupBy("code").agg(F.min("node").alias("rep")))
        crowd = cut_table(ball_groups(reps))
        if not start:
            sets = known.join(classes, "node")
            one, other = (sets.select(F.col("node").alias(s), *[F.col(k).alias(f"{k}_{s}") for k in ("root", "n", "fp", "few")]) for s in ("a", "b"))
            few = few_pairs(blocks, reps, crowd).join(one, "a").join(other, "b").where("root_a <> root_b").where(alike)
            classes = merged(classes, few.select("a", "b", "root_a", "root_b"))
        met = open_pairs(blocks.join(classes, "node"), crowd, known, alike, tile)
        classes = merged(classes, met)
        drop_tables(reps, crowd, met)
    drop_tables(*settled)
    out = cut_table(nodes.select("node", "least").join(classes, "node"))
    drop_tables(nodes, classes)
    return rows, out


def alike_in_bits(similarity: float, bits: int) -> Column:
    """Whether sets of n_a and n_b shingles with the bits fp_a and fp_b may be similar: see similar_nodes.

    few_a and few_b: the shingles of sets of fewer than SMALL / similarity, which decide where either set is small.
    """
    share = acos(2 * similarity / (1 + similarity)) / pi
    differ = F.aggregate(F.zip_with("fp_a", "fp_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
    near = differ <= int(share * bits + 2.5 * sqrt(share * (1 - share) * bits))
    shared = F.size(F.array_intersect("few_a", "few_b"))
    decided = F.when(F.least("n_a", "n_b") < SMALL, shared >= similarity * (F.col("n_a") + F.col("n_b") - shared)).otherwise(near)
    return (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")) & decided


def met_before(code: str) -> Column:
    """Whether nodes with the bits fp_a and fp_b also meet in a block before that of the code: with 2 differing bits at most."""
    halves = F.flatten(F.zip_with("fp_a", "fp_b", lambda p, q: F.array(F.shiftrightunsigned(p.bitwiseXOR(q), 32), p.bitwiseXOR(q).bitwiseAND(F.lit(0xFFFFFFFF)))))
    return F.exists(F.slice(halves, F.lit(1), F.shiftright(code, 32).cast("int")), lambda x: F.bit_count(x) <= 2)


def similar_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b, ...) whose sets of shingles have the similarity, as a table."""
    asked = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()
    sets = cut_table(nodes.select("node", "codes").join(asked, "node", "left_semi"))
    x, y = (sets.select(F.col("node").alias(s), F.col("codes").alias(f"codes_{s}")) for s in ("a", "b"))
    shared = F.size(F.array_intersect("codes_a", "codes_b"))
    out = cut_table(pairs.join(x, "a").join(y, "b").where(shared >= similarity * (F.size("codes_a") + F.size("codes_b") - shared)).select(pairs.columns))
    drop_tables(sets)
    return out


def block_codes(nodes: DataFrame, start: int, count: int) -> DataFrame:
    """(node, code): a row for each of the 32-bit blocks of a fingerprint, its number in the upper half of the code. Sets without shingles have none."""
    halves = F.flatten(F.transform("fp", lambda x: F.array(F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF)))))
    parts = nodes.where("n > 0").select("node", F.posexplode(F.slice(halves, start + 1, count)).alias("block", "part"))
    return parts.select("node", F.call_function("shiftleft", (F.col("block") + start).cast("long"), F.lit(32)).bitwiseOR(F.col("part")).alias("code"))


#: A ball has the code itself, sent with the mark 32, and what differs from it in bit 0 to 31, sent with the bit's number.
FLIPS, MARK_BITS = np.append(np.int64(1) << np.arange(32), 0), 6


def ball_groups(reps: DataFrame) -> DataFrame:
    """(v, code, first, before) for codes that share a value v of their balls of radius 1 with another: at most 33 for each v.

    first and before: the first code of v's group and the one before this. A value is sent as one number with a mark of
    which bit differs, from which its code follows.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column("code"))[:, None] ^ FLIPS
            yield pa.RecordBatch.from_arrays([pa.array(((values << MARK_BITS) | np.arange(33)).ravel())], ["p"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)  # the last group, which can go on in the next batch
        for batch in batches:
            p = np.concatenate((held, np.asarray(batch.column("p"))))
            whole = int(np.searchsorted(p, (p[-1] >> MARK_BITS) << MARK_BITS)) if len(p) else 0
            held = p[whole:]
            yield several(p[:whole])
        yield several(held)

    def several(p: np.ndarray) -> pa.RecordBatch:
        v, code = p >> MARK_BITS, (p >> MARK_BITS) ^ FLIPS[p & 63]
        new = np.ones(len(p) + 1, bool)
        new[1:-1] = v[1:] != v[:-1]
        first = np.maximum.accumulate(np.where(new[:-1], np.arange(len(p)), 0))
        at = np.flatnonzero(~(new[:-1] & new[1:]))
        before = np.where(new[:-1], 0, np.arange(len(p)) - 1)[at]
        return pa.RecordBatch.from_arrays([pa.array(v[at]), pa.array(code[at]), pa.array(code[first[at]]), pa.array(code[before], mask=new[at])], ["v", "code", "first", "before"])

    sent = reps.select("code").mapInArrow(emit, "p long").repartition(F.shiftright("p", MARK_BITS)).sortWithinPartitions("p")
    return sent.mapInArrow(groups, "v long, code long, first long, before long")


def few_pairs(blocks: DataFrame, reps: DataFrame, crowd: DataFrame) -> DataFrame:
    """(a, b), distinct: each node with the least of its code, and that with those of two codes that share a ball with it."""
    chain = crowd.groupBy("code").agg(F.min(F.when(F.col("first") != F.col("code"), F.col("first"))).alias("x"), F.max("before").alias("y"))
    chain = chain.select(F.col("code").alias("d"), F.explode(F.array_distinct(F.array_compact(F.array("x", "y")))).alias("c"))
    c, d = (reps.select(F.col("code").alias(k), F.col("rep").alias(s)) for k, s in (("c", "a"), ("d", "b")))
    equal = blocks.join(reps, "code").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    pairs = chain.join(c, "c").join(d, "d").select("a", "b").unionByName(equal).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_pairs(blocks: DataFrame, crowd: DataFrame, sets: DataFrame, alike: Column, tile: int) -> DataFrame:
    """(a, b, root_a, root_b), distinct, a table: all pairs of nodes of different roots whose codes in a block are equal or
    share a ball, but in no block before it, and that are alike.

    blocks: (node, code, root); sets: (node, n, fp, few). A pair that meets in many blocks is one row of the join, so near copies,
    which share most of theirs, don't multiply it; pairs that meet in blocks of an earlier call were decided then. Only groups of codes that hold several roots are looked at. Of two codes
    that met the larger is home, and the nodes of the other visit it. Home's largest class, its top, is set apart: nodes of
    that class visit only nodes beyond it, so that many near copies of one class don't meet each other again. Home nodes are
    dealt to tiles of about `tile`, which visitors visit one by one.
    """
    sizes = blocks.groupBy("code", "root").agg(F.count("*").alias("m"))
    groups = sizes.groupBy("code").agg(F.sum("m").alias("n"), F.max_by("root", F.struct("m", "root")).alias("top"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    groups = cut_table(groups.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")))
    held = crowd.select("v", "code").join(groups, "code").groupBy("v").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list(F.struct("n", "code", "top", "lo", "hi", "tiles")).alias("codes")).where("lo <> hi")

    def home_to(c: Column, d: Column) -> Column:
        """Two codes share two values, of which the smaller one counts; n, then the code, says which is home."""
        once = F.col("v") < F.col("v").bitwiseXOR(c["code"]).bitwiseXOR(d["code"])
        larger = (c["n"] > d["n"]) | (c["n"] == d["n"]) & (c["code"] > d["code"])
        return once & larger & (F.least(c["lo"], d["lo"]) != F.greatest(c["hi"], d["hi"]))

    def pair(c: Column, d: Column) -> Column:
        beyond = (c["lo"] != c["top"]) | (c["hi"] != c["top"])
        return F.struct(c["code"].alias("c"), d["code"].alias("d"), c["top"].alias("top"), c["tiles"].alias("tiles"), beyond.alias("beyond"))

    every = F.flatten(F.transform("codes", lambda c: F.transform(F.filter("codes", lambda d: home_to(c, d)), lambda d: pair(c, d))))  # at most 33 codes
    own = groups.where("lo <> hi").select(F.col("code").alias("c"), F.col("code").alias("d"), "top", "tiles", F.lit(True).alias("beyond"))
    met = cut_table(held.select(F.explode(every).alias("p")).select("p.*").unionByName(own))
    side = lambda s: [F.col(k).alias(f"{k}_{s}") for k in ("node", "root", "n", "fp", "few")]
    homes = blocks.join(met.select("c", "top", "tiles").distinct(), F.col("code") == F.col("c")).join(sets, "node")
    homes = homes.select("c", *side("a"), F.expr("cast(pmod(xxhash64(node), tiles) as int)").alias("i"), (F.col("root") != F.col("top")).alias("open"))
    guests = blocks.join(met, F.col("code") == F.col("d")).join(sets, "node").select("c", "d", "top", "tiles", "beyond", *side("b"))

    def visited(homes: DataFrame, guests: DataFrame) -> DataFrame:
        there = guests.withColumn("i", F.explode(F.expr("sequence(0, tiles - 1)"))).drop("tiles", "beyond")
        pairs = homes.join(there, ["c", "i"]).where("root_a <> root_b and (c <> d or root_a = top or node_a < node_b)").where(alike & ~met_before("c"))
        ordered = F.when(F.col("node_a") < F.col("node_b"), F.struct(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "root_a", "root_b"))
        return pairs.select(ordered.otherwise(F.struct(F.col("node_b").alias("a"), F.col("node_a").alias("b"), F.col("root_b").alias("root_a"), F.col("root_a").alias("root_b"))).alias("p")).select("p.*")

    strangers = visited(homes, guests.where("root_b <> top"))
    rest = visited(homes.where("open"), guests.where("root_b = top and beyond and c <> d"))
    out = cut_table(strangers.unionByName(rest).distinct())
    drop_tables(groups, met)
    return out


def similar_classes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, component_id) for each row: near-duplicates by Jaccard similarity of word shingles. Options: see similar_nodes."""
    rows, nodes = similar_nodes(docs, **options)
    lowest = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(nodes.join(lowest, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids (doc_id, distinct).

    Of rows that share a doc_id one stays, the one whose text hashes least; rows without a doc_id all stay.
    """
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash"), F.struct(*docs.columns).alias("row"))
    known = rows.where("doc_id is not null")
    least = known.groupBy("doc_id").agg(F.min("hash").alias("hash"), F.count("*").alias("copies")).join(ids, "doc_id", "left_semi")
    kept = known.join(least, ["doc_id", "hash"])
    one = kept.where("copies = 1").unionByName(kept.where("copies > 1").dropDuplicates(["doc_id"]))
    return one.select("row").unionByName(rows.where("doc_id is null").select("row")).select("row.*")


def near_duplicates_dropped(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of near-duplicates, that with the smallest doc_id; the other options are those of similar_nodes."""
    rows, nodes = similar_nodes(docs, **options)
    ids = cut_table(nodes.groupBy("root").agg(F.min("least").alias("doc_id")).select("doc_id").distinct())
    drop_tables(rows, nodes)
    return keep_ids(docs, ids)
