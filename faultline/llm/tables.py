"""Reading the corpus tables and cutting lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.io import cut_table, drop_tables, remove_folder, shared_folder

__all__ = ["cut_table", "doc_key", "drop_tables", "read", "remove_folder", "shared_folder"]

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A corpus table. Batches that go to Python are held to 8 MB, as texts are long and ten thousand of them are many MB."""
    spark.conf.set(BATCH_BYTES, str(8 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Adds key_id and key_text: rows that repeat both id and text share a key; a null id sorts last.

    Ids are whole numbers below 2**63 - 1, which stands for null.

    key_text is a hash of the text, and 0 for all rows if no id stands twice, which is counted first.
    """
    repeated = not df.groupBy(id_column).count().where("count > 1").isEmpty()
    text = F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))) if repeated else F.lit(0).cast("long")
    return df.withColumns({"key_id": F.coalesce(F.col(id_column).cast("long"), F.lit(2**63 - 1)), "key_text": text})
