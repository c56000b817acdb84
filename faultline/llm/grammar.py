"""Token ids in files that a Re-Pair grammar compresses, with decoding of any part."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.encoders import byte_encoder
from faultline.llm.textscan import slices

#: A shard is: MAGIC and six numbers (see HEAD), rules (two symbols each), expansion lengths of the rules, symbols and ids of
#: each document, symbols. Symbols below `base` are ids, base + r is rule r; they take 2 bytes if all fit, else 4.
MAGIC = b"RePair1\0"
HEAD = "<6q"  # bytes a symbol, base, rules, documents, symbols, ids
#: Ids after which a shard is closed.
SHARD = 1 << 19


def repair(ids: np.ndarray, ends: np.ndarray, base: int, least: int = 8, rounds: int = 16, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (left, right), symbols and where each document's symbols end.

    ids: of all documents, below base; ends: where each document's end. Each round counts the pairs of neighbours inside
    documents and replaces frequent ones (`least` times or more, the most frequent first) by new symbols: a pair is replaced
    where it is the most frequent of those it overlaps. It ends when no pair is frequent, after a round that took away less than
    1 of 64 symbols, after `rounds`, or with `most` rules (by default as many as keep symbols in two bytes, if ids do).
    """
    if most is None:
        most = (1 << 16) - base if base < 1 << 16 else 1 << 20
    sym = ids.astype(np.uint32)
    last = np.zeros(len(sym), bool)
    last[ends[np.diff(ends, prepend=0) > 0] - 1] = True
    rules = np.zeros((0, 2), np.int64)
    for turn in range(rounds):
        room = (most - len(rules)) // 2 if turn < rounds - 1 else most - len(rules)
        if room <= 0 or len(sym) < 2:
            break
        span = base + len(rules)
        kind = np.uint32 if span < 1 << 16 else np.uint64  # half the bytes to sort and to look up, as a rule
        none = np.iinfo(kind).max  # no pair: both its symbols are below span
        pair = sym[:-1].astype(kind) * kind(span) + sym[1:]
        pair[last[:-1]] = none
        ordered = np.sort(pair)
        new = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        times = np.diff(np.append(new, len(ordered)))
        keys = ordered[new]
        often = np.flatnonzero((times >= least) & (keys != none))
        if not len(often):
            break
        chosen = often[np.lexsort((slots(keys[often]), -times[often]))[:room]]  # ties by a hash, as neighbours in a repeated passage tie
        wanted = keys[chosen]
        table = np.full(1 << 18, len(chosen), np.int32)  # of two pairs that share a slot the more frequent one stays
        table[slots(wanted)[::-1]] = np.arange(len(chosen))[::-1]
        r = table[slots(pair)]
        r[(np.append(wanted, kind(none))[r] != pair) | last[:-1]] = len(chosen)
        # Of overlapping pairs the more frequent goes first; of a run of one pair, as in aaaa, every second one.
        before, after = np.append(len(chosen), r[:-1]), np.append(r[1:], len(chosen))
        hit = (r < len(chosen)) & (r <= before) & (r <= after)
        place = np.flatnonzero(hit)
        begins = np.append(True, (np.diff(place) != 1) | (r[place[1:]] != r[place[:-1]])) if len(place) else np.zeros(0, bool)
        nth = np.arange(len(place)) - np.maximum.accumulate(np.where(begins, np.arange(len(place)), 0))
        place = place[nth % 2 == 0]
        used = np.bincount(r[place], minlength=len(chosen))
        worth = used >= min(least, 3)
        place = place[worth[r[place]]]
        if not len(place):
            break
        name = np.cumsum(worth) - 1 + span
        made = wanted[worth].astype(np.int64)
        rules = np.concatenate((rules, np.stack((made // span, made % span), axis=1)))
        sym[place] = name[r[place]]
        stay = np.ones(len(sym), bool)
        stay[place + 1] = False
        last[place] = last[place + 1]
        sym, last = sym[stay], last[stay]
        if 64 * len(place) < len(stay):
            break
    stops = np.zeros(len(ends), np.int64)
    some = np.diff(ends, prepend=0) > 0
    stops[some] = np.flatnonzero(last) + 1
    return rules, sym, np.maximum.accumulate(stops) if len(stops) else stops


def slots(pairs: np.ndarray) -> np.ndarray:
    if pairs.dtype == np.uint32:
        return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(14)
    return (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)


def pack(ids: np.ndarray, ends: np.ndarray, base: int, **options: int) -> bytes:
    """A shard of documents whose ids end at `ends`."""
    rules, sym, stops = repair(ids, ends, base, **options)
    sizes = np.ones(base + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        sizes[base + k] = sizes[a] + sizes[b]
    width = 2 if base + len(rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    head = MAGIC + struct.pack(HEAD, width, base, len(rules), len(ends), len(sym), len(ids))
    parts = rules.astype(kind), sizes[base:].astype("<u4"), np.diff(stops, prepend=0).astype("<u4"), np.diff(ends, prepend=0).astype("<u4"), sym.astype(kind)
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """Reads a shard of `pack`: all of it, a document, or any range of ids."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.width, self.base, rules, docs, symbols, self.n_ids = struct.unpack_from(HEAD, data, len(MAGIC))
        at = len(MAGIC) + struct.calcsize(HEAD)

        def numbers(n: int, width: int) -> np.ndarray:
            nonlocal at
            own = np.frombuffer(data, f"<u{width}", n, at).astype(np.int64)
            at += n * width
            return own

        self.rules = numbers(2 * rules, self.width).reshape(-1, 2)
        self.lengths = numbers(rules, 4)
        self.stops = np.cumsum(numbers(docs, 4))
        self.ends = np.cumsum(numbers(docs, 4))
        self.symbols = numbers(symbols, self.width)
        self._through: np.ndarray | None = None
        self._whole: tuple[np.ndarray, np.ndarray] | None = None

    def __len__(self) -> int:
        return len(self.ends)

    def size(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= self.base
        out = np.ones(len(symbols), np.int64)
        out[rule] = self.lengths[symbols[rule] - self.base]
        return out

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of these symbols: rules are replaced by their two sides until none is left."""
        while len(symbols) and (rule := symbols >= self.base).any():
            n = 1 + rule
            first = np.cumsum(n) - n
            out = np.empty(int(n.sum()), np.int64)
            out[first[~rule]] = symbols[~rule]
            sides = self.rules[symbols[rule] - self.base]
            out[first[rule]], out[first[rule] + 1] = sides[:, 0], sides[:, 1]
            symbols = out
        return symbols

    def ids(self) -> np.ndarray:
        """All ids: every rule is expanded once, then symbols are replaced by what they stand for in one step."""
        if self._whole is None:
            offset = np.cumsum(self.lengths) - self.lengths
            self._whole = offset, self.expanded(np.arange(self.base, self.base + len(self.rules)))
        offset, flat = self._whole
        n = self.size(self.symbols)
        begin = np.cumsum(n) - n
        out = np.empty(self.n_ids, np.int64)
        plain = self.symbols < self.base
        out[begin[plain]] = self.symbols[plain]
        rule = np.flatnonzero(~plain)
        size = n[rule]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin[rule], size) + within] = flat[np.repeat(offset[self.symbols[rule] - self.base], size) + within]
        return out

    def part(self, lo: int, hi: int) -> np.ndarray:
        """The ids from lo to hi, of which only the symbols that hold them are expanded."""
        if self._through is None:
            self._through = np.cumsum(self.size(self.symbols))
        lo, hi = max(lo, 0), min(hi, self.n_ids)
        if hi <= lo:
            return np.zeros(0, np.int64)
        a, b = np.searchsorted(self._through, lo, "right"), np.searchsorted(self._through, hi, "left") + 1
        skip = lo - (self._through[a - 1] if a else 0)
        return self.expanded(self.symbols[a:b])[skip : skip + hi - lo]

    def document(self, k: int) -> np.ndarray:
        return self.expanded(self.symbols[self.stops[k - 1] if k else 0 : self.stops[k]])


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard: int = SHARD, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes the ids of every whole text, each with end_id behind it, in ascending order of ids of documents.

    tokenizer: a byte-level BPE file of the `tokenizers` library, the same on all executors; no special tokens are added, those
    in a text are taken as its default says. path: a folder, of Parquet files of (part, shard, before, n_ids, doc_ids,
    payload): part and shard number the shards in order, before counts the ids of the part's earlier shards, payload is a shard
    of `pack`. Shards close at `shard` ids, so a task holds one shard, and one text, at a time.

    Null texts are empty (their end_id stays), null ids come last. Rows that share an id come in the order of a hash of their
    texts; rows that repeat both are dealt by their place in the input, so that no id is more than a task can hold. An empty
    table gives no rows.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = byte_encoder(tokenizer)
        base, part = max(len(own.table), end_id + 1), TaskContext.get().partitionId()
        names: list[pa.Array] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        number = before = n = 0

        def closed() -> pa.RecordBatch:
            ids, ends = np.concatenate(held), np.cumsum(np.concatenate(sizes))
            every = pa.concat_arrays(names)
            row = [pa.array([part]), pa.array([number]), pa.array([before]), pa.array([n]), pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every), pa.array([pack(ids, ends, base)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["part", "shard", "before", "n_ids", "doc_ids", "payload"])

        for rows in slices(batches, "text", min(1 << 20, 2 * shard)):
            ids, of = own.encode(rows.column("text").fill_null("").to_pylist())
            held.append(np.insert(ids, of[1:], end_id))
            sizes.append(np.diff(of) + 1)
            names.append(rows.column("id"))
            n += len(held[-1])
            if n >= shard:
                yield closed()
                number, before, n = number + 1, before + n, 0
                names, held, sizes = [], [], []
        if n:
            yield closed()

    order = [F.col("id").isNull().alias("last"), F.col("id"), F.xxhash64(F.coalesce("text", F.lit(""))), F.monotonically_increasing_id()]
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    rows = rows.select("id", "text", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("k"))
    rows = rows.repartitionByRange("k").sortWithinPartitions("k").select("id", "text")
    rows.mapInArrow(encode, f"part long, shard long, before long, n_ids long, doc_ids array<{kind}>, payload binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """(id, start long, n_tokens long, ids binary) for each document in files of write_ids.

    start: how many ids all documents before it have; ids: little-endian 32-bit numbers. The ids of parts are summed up by one
    task, from a row for each part (a task of the writer); everything else is read a shard at a time.
    """
    shards = spark.read.parquet(path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = Shard(batch.column("payload")[k].as_py())
                names, ids = batch.column("doc_ids")[k].values, own.ids().astype("<u4")
                n = np.diff(own.ends, prepend=0)
                start = batch.column("before")[k].as_py() + own.ends - n
                part = pa.array(np.full(len(own), batch.column("part")[k].as_py()))
                for lo in range(0, len(own), 4096):
                    hi = min(lo + 4096, len(own))
                    own_ids = ids[own.ends[lo] - n[lo] : own.ends[hi - 1]]
                    said = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(np.append(0, np.cumsum(n[lo:hi])) * 4), pa.py_buffer(own_ids.tobytes())])
                    yield pa.RecordBatch.from_arrays([part[lo:hi], names[lo:hi], pa.array(start[lo:hi]), pa.array(n[lo:hi]), said.cast(pa.binary())], ["part", "id", "local", "n_tokens", "ids"])

    rows = shards.select("part", "before", "doc_ids", "payload").mapInArrow(decode, f"part long, id {kind}, local long, n_tokens long, ids binary")
    return rows.join(F.broadcast(parts), "part").select(F.col("id").alias(id_column), (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids")
