"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.tables import cut_table

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeat: float = 3.0) -> DataFrame:
    """The words that each source is to give: (source, source_size, target).

    sizes: (source, source_size), a row a source. Sources are ordered by code point, null last, and weigh as `weights`
    repeated. They share the sum of all sizes by weight; what goes beyond max_repeat times a source's size is shared by
    weight among the others until none is above. Solved in closed form: with sources sorted by size over weight, the
    first k are capped and the rest share by weight, for the least k that leaves none above its cap.

    The windows run over a row a source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = sizes.withColumn("i", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("i") % n + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("i"))
    all_rows = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("source_size").cast("double")
    w = w.withColumns(
        {
            "total": F.sum(size).over(all_rows),
            "capped_before": F.coalesce(F.sum(size * max_repeat).over(before), F.lit(0.0)),
            "weight_left": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    level = (F.col("total") - F.col("capped_before")) / F.col("weight_left")
    fits = size * max_repeat >= level * F.col("weight")
    w = w.withColumn("level", F.min(F.when(fits, F.struct(F.col("capped_before"), level.alias("level")))).over(all_rows)["level"])
    return w.select("source", "source_size", F.least(size * max_repeat, F.coalesce(F.col("level") * F.col("weight"), size * max_repeat)).alias("target"))


def mix_schedule(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeat: int = 3, rows_a_slice: int = 20_000) -> DataFrame:
    """The copies of documents in the order in which a weighted fair queue sends them, until the total budget is reached.

    docs: any table with doc_id, text, source; other columns are ignored. Returns a row for each document and turn sent:
    (doc_id, source, size, source_size, target, turn, finish), range-sorted by finish. See scheduled.
    """
    sent = scheduled(sized(docs, rows_a_slice), weights, max_repeat)
    return sent.select("doc_id", "source", "size", "source_size", "target", "turn", "finish").orderBy("finish", F.col("source").asc_nulls_last(), "doc_id", "turn")


def mix_taken(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeat: int = 3, rows_a_slice: int = 20_000) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs: the words that the queue sends of it, all turns counted."""
    rows = sized(docs, rows_a_slice)
    sent = scheduled(rows, weights, max_repeat).groupBy("row").agg(F.sum("size").alias("taken"))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    every = rows.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("row", "doc_id", "d.source", "size", "source_size", "target")
    return every.join(sent, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def sized(docs: DataFrame, rows_a_slice: int) -> DataFrame:
    """(row, doc_id, source, size, draw, slice, slices), a narrow table: the texts are read once.

    draw: 60 bits of a hash of id and text, which shuffle the documents alike in every run. slice: which of `slices` equal
    ranges it is in, about rows_a_slice rows each.
    """
    key = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("text")))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.left(key, F.lit(15)), 16, 10).cast("long").alias("draw"),
    )
    rows = cut_table(rows)
    n = -(-rows.count() // rows_a_slice)
    return rows.withColumns({"slice": F.floor(F.col("draw") / float(1 << 60) * n).cast("long"), "slices": F.lit(n)})


def scheduled(rows: DataFrame, weights: tuple[float, ...], max_repeat: int) -> DataFrame:
    """The copies sent of rows (row, doc_id, source, size, draw, slice, slices), with turn and finish.

    Documents of a source come in the order of their draws, again for each turn. finish is the virtual time at which a copy
    is through: the words of its source up to and with it over the source's target. At time 1 every source has sent its
    target. All copies that begin before that are sorted by finish (then source, null last, doc_id, turn) and taken until
    the total budget, all sizes (so all targets) together, is reached; the last one is taken if at least half of it fits.

    Both running totals, of a source's words and of the queue's, take two steps, so that no source and no task has to
    hold them all: sums of slices first, of the draws or of virtual time, and their running sums, then running sums inside
    each slice. Texts without words have size 0, which no turn changes. An empty table gives no rows.
    """
    parts = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sizes = parts.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeat).withColumn("budget", F.sum("source_size").over(Window.partitionBy()))
    inside = Window.partitionBy("source").orderBy("slice")
    parts = parts.select("source", "slice", (F.sum("slice_size").over(inside) - F.col("slice_size")).alias("before"))
    parts = parts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "source_size", "target", "budget")
    order = Window.partitionBy("d.source", "d.slice").orderBy("draw", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        rows.alias("d")
        .join(parts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.slice") == F.col("s.slice")))
        .select("row", "doc_id", "d.source", "size", "source_size", "target", "budget", "slices", (F.col("before") + F.sum("size").over(order)).alias("through"))
    )
    turns = F.filter(F.sequence(F.lit(0), F.lit(max_repeat - 1)), lambda k: k * F.col("source_size") + F.col("through") - F.col("size") < F.col("target"))
    copies = queued.withColumn("turn", F.explode(turns)).withColumn("finish", (F.col("turn") * F.col("source_size") + F.col("through")) / F.col("target"))
    copies = copies.withColumn("time", F.least(F.floor(F.col("finish") * F.col("slices")), F.col("slices")))
    so_far = F.sum("sent").over(Window.orderBy("time")) - F.col("sent")
    times = copies.groupBy("time").agg(F.sum("size").alias("sent")).select("time", so_far.alias("sent_before"))
    queue = Window.partitionBy("time").orderBy("finish", F.col("source").asc_nulls_last(), "doc_id", "turn", "row").rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.col("sent_before") + F.sum("size").over(queue) - F.col("size")
    return copies.join(times, "time").withColumn("ahead", ahead).where(F.col("ahead") + F.col("size") / 2 <= F.col("budget"))
