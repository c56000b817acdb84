"""Near-duplicate embeddings by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.components import components
from faultline.llm.tables import cut_table

MARGIN = 1e-6
#: A cell's code: the dimension, the block (of at most BLOCKS) and six bits for each of at most five grid coordinates.
BLOCKS, GRID_BITS = 4096, 30


@lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    """A fixed pseudo-random rotation, which spreads the variance over all coordinates."""
    return np.linalg.qr(np.random.default_rng(12345).standard_normal((dim, dim)))[0]


def unit_vectors(values: np.ndarray) -> np.ndarray:
    """Rows of length 1. Powers of two are taken out first, which loses nothing, so that no square over- or underflows."""
    values = np.ldexp(values, -np.frexp(np.abs(values).max(axis=1, keepdims=True))[1])
    return values / np.sqrt((values * values).sum(axis=1))[:, None]


def distinct_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(v array<double>, least id, copies) for each distinct usable vector; copies meet before anything else does."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = rows.where(F.col("v").isNotNull()).where(finite).where(F.exists("v", lambda x: x != 0))
    return usable.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))


def spread(vectors: DataFrame, threshold: float, block_dims: int, grid_dims: int) -> DataFrame:
    """Rows (cell, home, block, node, copies, u): each vector at its own cell of every block, and at those it probes.

    u: the vector's bytes, in single precision where that loses nothing.

    Unit vectors with a cosine of at least `threshold` are within 2 - 2 * threshold of each other (squared). Rotated and
    split into blocks, in one block at least they are within the block's share of that, in proportion to its dimensions.
    The first grid_dims coordinates of a block give its cell, twice the share's radius wide; a vector probes the cells
    that its ball reaches and that don't sort before its own, so each pair of cells meets once.
    """
    budget = 2 - 2 * threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                lists = batch.column("v")
                of = np.asarray(lists.offsets, np.int64)
                flat = np.asarray(lists.values, np.float64)[of[0] : of[-1]] if len(lists.values) else np.zeros(0)
                node, copies = (np.asarray(batch.column(c)) for c in ("node", "copies"))
                for dim in np.unique(np.diff(of)).tolist():
                    own = np.flatnonzero(np.diff(of) == dim)
                    yield from deal(np.stack([flat[of[i] - of[0] : of[i + 1] - of[0]] for i in own]), node[own], copies[own], dim)

    def deal(v: np.ndarray, node: np.ndarray, copies: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
        turned = unit_vectors(v) @ rotation(dim)
        single = v.astype(np.float32)
        packed = [x.tobytes() if (x == y).all() else y.tobytes() for x, y in zip(single, v, strict=True)]
        for b, start in enumerate(range(0, dim, block_dims)):
            part = turned[:, start : start + block_dims]
            radius = np.sqrt(budget * part.shape[1] / dim) + MARGIN
            width = 2 * radius
            grid = part[:, : min(grid_dims, part.shape[1])]
            cell = np.floor(grid / width).astype(np.int64)
            inner = grid - cell * width
            side = np.where(inner < radius, -1, 1)  # the one neighbour in each dimension that the ball can reach
            gap = np.where(inner < radius, inner, width - inner)
            for step in product((0, 1), repeat=grid.shape[1]):
                move = np.array(step)
                reach = (gap * gap * move).sum(axis=1) <= radius * radius
                to = cell + side * move
                differs = to != cell
                first = np.argmax(differs, axis=1)
                rows = np.arange(len(cell))
                after = ~differs.any(axis=1) | (to[rows, first] > cell[rows, first])
                at = np.flatnonzero(reach & after)
                home = not any(step)
                code = np.full(len(at), (dim * BLOCKS + b) << GRID_BITS, np.int64)
                for j in range(to.shape[1]):  # cells 64 apart share a code: more is compared then, not less
                    code += (to[at, j] & 63) << (6 * j)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code), pa.array(np.full(len(at), home)), pa.array(np.full(len(at), b, np.int32)), pa.array(node[at]), pa.array(copies[at]), pa.array([packed[i] for i in at], pa.binary())],
                    ["cell", "home", "block", "node", "copies", "u"],
                )

    return vectors.select("v", "node", "copies").mapInArrow(run, "cell long, home boolean, block int, node long, copies long, u binary")


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors, in double precision, of the bytes of vectors."""
    if len({len(x) for x in packed}) == 1:
        kind = np.float32 if len(packed[0]) == 4 * dim else np.float64
        return unit_vectors(np.frombuffer(b"".join(packed), kind).reshape(len(packed), dim).astype(np.float64))
    return unit_vectors(np.stack([np.frombuffer(x, np.float32 if len(x) == 4 * dim else np.float64).astype(np.float64) for x in packed]))


def meet(dealt: DataFrame, threshold: float, block_dims: int, tile: int = 2048, most: int = 20_000) -> DataFrame:
    """(a, b, n): vectors that verified links lead from a to b, or for b null how many copies a is linked with.

    Cells of more than `most` home rows are split into shards of their home rows, and their probing rows go to each of
    them. A task holds one shard's home rows and streams the other rows of the cell past them, in tiles: block distances
    first, then exact cosines of what is within the block's share. A pair counts in the first block that finds it.
    """
    crowded = dealt.where("home").groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("shards")).where("shards > 1")
    crowded = cut_table(crowded)
    few = crowded.count() <= 100_000  # 12 bytes each: then they are sent, else joined by a shuffle
    rows = dealt.join(F.broadcast(crowded) if few else crowded, "cell", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    own = F.when(F.col("home"), F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")).otherwise(F.lit(-1))
    # Home rows also visit the home rows of later shards, so that each pair of them meets once.
    stops = F.transform(F.sequence(F.greatest(own, F.lit(0)), F.col("shards") - 1), lambda k: F.struct(k.alias("shard"), F.when(k == own, 0).otherwise(2).alias("role")))
    both = rows.withColumn("stop", F.explode(stops)).select("cell", "stop.shard", "stop.role", "block", "node", "copies", "u")
    ordered = both.repartition("cell", "shard").sortWithinPartitions("cell", "shard", "role", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, Home()
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, shard, role, block, node, copies = (np.asarray(batch.column(c)) for c in ("cell", "shard", "role", "block", "node", "copies"))
            u = batch.column("u")
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (shard[1:] != shard[:-1]) | (role[1:] != role[:-1])) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if (cell[a], shard[a]) != key:
                    yield from held.links()
                    key, held = (cell[a], shard[a]), Home()
                vectors = unpack(u.slice(a, b - a).to_pylist(), (int(cell[a]) >> GRID_BITS) // BLOCKS)
                if role[a] == 0:
                    held.add(vectors, node[a:b], copies[a:b], int(block[a]))
                else:
                    yield from held.visit(vectors, node[a:b], copies[a:b])
        yield from held.links()

    class Home:
        def __init__(self):
            self.parts, self.ready, self.done = [], None, False

        def add(self, u, node, copies, block):
            self.parts.append((u, node, copies))
            self.block = block

        def stacked(self):
            if self.ready is None and self.parts:
                self.ready = tuple(np.concatenate([p[k] for p in self.parts]) for k in range(3))
                self.parts = self.parts[:1]
            return self.ready

        def links(self):
            """Links among the home rows themselves."""
            if self.done or self.stacked() is None:
                return
            self.done = True
            u, node, copies = self.ready
            for k in range(0, len(u), tile):
                for m in range(k, len(u), tile):
                    yield from compare(u[k : k + tile], node[k : k + tile], copies[k : k + tile], u[m : m + tile], node[m : m + tile], copies[m : m + tile], self.block, k == m)

        def visit(self, u, node, copies):
            if self.stacked() is None:
                return
            yield from self.links()
            for k in range(0, len(u), tile):
                for m in range(0, len(self.ready[0]), tile):
                    yield from compare(u[k : k + tile], node[k : k + tile], copies[k : k + tile], *(x[m : m + tile] for x in self.ready), self.block, False)

    def compare(x, x_node, x_copies, y, y_node, y_copies, block, same) -> Iterator[pa.RecordBatch]:
        dim = x.shape[1]
        turn = rotation(dim)
        budget = 2 - 2 * threshold + MARGIN

        def near(k: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
            width = min(block_dims, dim - k * block_dims)
            return ((p - q) ** 2).sum(axis=1) <= budget * width / dim + MARGIN

        cols = turn[:, block * block_dims : (block + 1) * block_dims]
        p, q = x @ cols, y @ cols
        d2 = (p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1) - 2 * (p @ q.T)
        i, j = np.nonzero(d2 <= budget * cols.shape[1] / dim + MARGIN)
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 50_000):
            a, b = i[k : k + 50_000], j[k : k + 50_000]
            fine = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
            a, b = a[fine], b[fine]
            for e in range(block):  # found by an earlier block already
                if not len(a):
                    break
                c = turn[:, e * block_dims : (e + 1) * block_dims]
                new = ~near(e, x[a] @ c, y[b] @ c)
                a, b = a[new], b[new]
            if not len(a):
                continue
            n_x = np.bincount(a, y_copies[b], len(x)).astype(np.int64)
            n_y = np.bincount(b, x_copies[a], len(y)).astype(np.int64)
            hit_x, hit_y = np.flatnonzero(n_x), np.flatnonzero(n_y)
            # What links of a tile connect is kept with few links: each row's first partner on either side.
            first_x, at_x = np.unique(a, return_index=True)
            first_y, at_y = np.unique(b, return_index=True)
            from_, to = np.concatenate((x_node[first_x], y_node[first_y])), np.concatenate((y_node[b[at_x]], x_node[a[at_y]]))
            if len(a) > len(from_):
                from_, to = spanning(a, b, x_node, y_node)
            else:
                from_, to = x_node[a], y_node[b]
            yield out(from_, to, np.zeros(len(from_), np.int64))
            ends = np.concatenate((x_node[hit_x], y_node[hit_y]))
            yield out(ends, None, np.concatenate((n_x[hit_x], n_y[hit_y])))

    def spanning(a, b, x_node, y_node):
        """Links enough to connect what the pairs connect."""
        parent = {}

        def find(v):
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        kept = []
        for p, q in zip(x_node[a].tolist(), y_node[b].tolist(), strict=True):
            r, s = find(p), find(q)
            if r != s:
                parent[r] = s
                kept.append((p, q))
        kept = np.array(kept, np.int64).reshape(-1, 2)
        return kept[:, 0], kept[:, 1]

    def out(a, b, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), pa.array(n)], ["a", "b", "n"])

    return ordered.mapInArrow(run, "a long, b long, n long")


def embedding_classes(vectors: DataFrame, threshold: float = 0.95, block_dims: int = 8, grid_dims: int = 3, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, n_links, component_id) for each row of vectors.

    n_links: other rows whose cosine with this one, in double precision, is at least `threshold`. component_id: the
    smallest id that links reach. Copies of a vector are linked and compared as one. A vector that is null, zero or has
    a null or non-finite component, and any vector of another dimension, links with nothing. A row without an id keeps
    a null id: it counts as a partner, and component_id is the smallest known id, or null. Other columns are not read;
    an empty table gives no rows.

    The nodes of the graph are distinct vectors, named by their smallest id; those of which no copy has an id are named
    by a hash.
    """
    key = F.transform(F.col(vector_column).cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.select(F.col(id_column), key.alias("v"))
    nodes = distinct_vectors(vectors, id_column, vector_column).withColumn("node", F.coalesce(F.col("least").cast("long"), F.xxhash64("v")))
    nodes = cut_table(nodes)
    found = cut_table(meet(spread(nodes, threshold, block_dims, grid_dims), threshold, block_dims))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b is not null").select("a", "b"))
    info = nodes.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = info.groupBy("root").agg(F.min("least").alias("component_id"))
    info = info.join(lowest, "root").select("v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return (
        rows.withColumn("usable", F.col("v").isNotNull())
        .join(info, "v", "left")
        .select(id_column, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.when(F.col("n_links").isNull(), F.col(id_column))).alias("component_id"))
    )
