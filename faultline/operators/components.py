"""Connected components by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.sources.io import cut_table, drop_tables

#: Edges (1 MB of them) that are left to one task to finish.
LAST = 1 << 16


def components(edges: DataFrame, max_rounds: int = 60, last: int = LAST) -> DataFrame:
    """Labels the nodes of an undirected graph.

    edges: (a long, b long), in any direction, repeats and loops allowed. Returns (node, root): nodes of one component
    share a root, which is one of them (not the smallest: take the smallest of what you need by grouping on it).

    Each round every node points to the neighbour (or itself) with the least pseudo-random priority, and the graph is
    contracted along these pointers. Priorities are drawn anew each round, so paths shrink by a constant factor and the
    edges left decline geometrically. Pointers are grouped with map-side combine and joined back by shuffle; nothing is
    collected, and the tables of a round go when the next has replaced them. Once the contracted graph has at most `last`
    edges, one task finishes it, which spares many rounds over next to nothing. The result is a table of cut_table. An
    empty graph gives no rows.
    """
    edges = cut_table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = cut_table(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    for turn in range(max_rounds):
        if edges.count() <= last:
            to = edges.select("a", "b").coalesce(1).mapInArrow(united, "a long, to long")
            named = cut_table(labels.join(to.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
            drop_tables(edges, labels)
            return named
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("p"), F.col(c).alias("to"))
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut_table(both.groupBy("a").agg(F.min(F.least(rank("a"), rank("b")))["to"].alias("to")))
        moved = edges.join(to, "a").select(F.col("to").alias("x"), F.col("b").alias("a")).join(to, "a")
        fewer = cut_table(moved.select(F.least("x", "to").alias("a"), F.greatest("x", "to").alias("b")).where("a <> b").distinct())
        named = cut_table(labels.join(to.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        drop_tables(edges, labels, to)
        edges, labels = fewer, named
    raise RuntimeError(f"no convergence in {max_rounds} rounds")


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, to): the nodes of at most LAST edges (a, b), and one node of each one's component."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            parent[root(a)] = root(b)
    nodes = np.array(list(parent), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([root(v) for v in nodes.tolist()], pa.int64())], ["a", "to"])
