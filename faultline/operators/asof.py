"""Numbering and as-of joins over sorted rows that no single task has to hold, however hot a key is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.sources.io import settled


def same(a: str, b: str, columns: list[str]) -> Column:
    """Whether two aliased rows agree in these columns; nulls are equal."""
    found = F.lit(True)
    for c in columns:
        found = found & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return found


def sliced(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """rows with _slice: they are dealt by ranges of (by, order), so that a key with many rows lies in many slices, one after the other.

    Range partitioning samples the rows, which balances slices whatever the keys and times are; rows that are equal in all of
    these stay together. The result is checkpointed: slices must not change.
    """
    return settled(rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_slice", F.spark_partition_id()))


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place (from 1) among those of their key. Ties in order are numbered in some order.

    Rows are numbered in their slice; what the slices before hold is a sum over one row a slice and key.
    """
    dealt = sliced(rows, by, order)
    held = dealt.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    before = held.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_slice")) - F.col("_n")).drop("_n")
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(*order)))
    both = own.alias("r").join(before.alias("b"), same("r", "b", [*by, "_slice"]))
    return both.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("_before") + F.col("_own")).alias(name))


def last_before(asked: DataFrame, events: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """(by, time, value): for each distinct (by, time) that is asked, the value of the key's last event at or before that time.

    asked: by, time. events: by, time, value, one row a key and time at most. Rows without an event before are left out, and
    so are null times. A sort-merge as-of join: both sides are sorted into one sequence, in which the last event is carried
    forward; each slice of it starts with the last event of the slices before, which is one row a slice and key. There is no
    row for each pair of a question and an event, and equal questions are asked once.
    """
    right = events.where(F.col(time).isNotNull()).select(*by, time, F.struct(F.col(value)).alias("_value"))
    left = asked.where(F.col(time).isNotNull()).select(*by, time).distinct().withColumn("_value", F.lit(None).cast(right.schema["_value"].dataType))
    order = [F.col(time), F.col("_value").isNull()]  # an event at the time that is asked counts
    dealt = sliced(right.unionByName(left), by, order)
    ends = dealt.where("_value is not null").groupBy(*by, "_slice").agg(F.max_by("_value", time).alias("_end"))
    # Every slice of a key needs the last event before it, also a slice without events.
    keys = dealt.select(*by, "_slice").distinct().alias("k").join(ends.alias("e"), same("k", "e", [*by, "_slice"]), "left").select(*[F.col(f"k.{c}") for c in [*by, "_slice"]], "_end")
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = keys.select(*by, "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_start"))
    so_far = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = dealt.withColumn("_last", F.last("_value", ignorenulls=True).over(so_far)).where("_value is null")
    both = carried.alias("c").join(starts.alias("s"), same("c", "s", [*by, "_slice"]))
    found = both.select(*[F.col(f"c.{c}") for c in [*by, time]], F.coalesce("_last", "_start").alias("_found")).where("_found is not null")
    return found.select(*by, time, F.col(f"_found.{value}").alias(value))
