"""Labelled rows for training, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_column: str = "doc_id"):
    """True where crc32 of the id as text leaves 1 divided by 3; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, label double) of rows that are not held out: a pseudo-random choice of about max_rows at most.

    A document labelled more than once has the mean of its labels, 1 from one half on. The chosen ids are sent to the
    documents, which are not shuffled: max_rows bounds their size.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("label"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "doc_id")
