"""The corpus pipeline: five stages from raw documents to a mix of sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from faultline.llm.pipeline_stages import STAGES
from faultline.llm.tables import read, remove_folder, shared_folder

#: Toxicity is a trained model and the passages follow from it: SQL can't express the stages.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each written as Parquet in the shared folder and read again by the next.

    A stage's table goes when the next one is written; the last stays, and is what is returned.
    """
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
