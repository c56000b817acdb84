"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns what goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import decontaminate, mixing, passages, simhash, toxicity
from faultline.llm.tables import read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go. Learns from the given labels and the documents at hand."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), read(spark, sf_dir, "labels"), threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in 0.8 or more of their 5-word shingles the one with the smallest id stays."""
    return simhash.near_duplicates_dropped(docs.select(*COLUMNS), shingle=5, similarity=0.8)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 50 that an earlier document holds go; documents of which nothing is left go as well."""
    out = passages.remove_passages(docs.select(*COLUMNS), window=50)
    return with_length(out.where("n_removed = 0 or n_removed < n_words"))


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside phrases of 10 words of benchmark items go; documents of which nothing is left go as well."""
    return with_length(decontaminate.remove_phrases(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"), window=10))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, with sources weighing 5, 2, 1, repeating."""
    return mixing.mix_taken(docs, weights=(5, 2, 1), max_repeat=3).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", remove_benchmark_passages),
    ("source_mixing", mix_sources),
]
