"""Investigating questions: patterns in the logs found, and tickets related to them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.config import RunConfig
from faultline.functions.text import normalize_text
from faultline.operators.filters import newest, ticket_tokens
from faultline.operators.similarity import dup_similarity


def unique_patterns(logs: DataFrame, by: tuple[str, ...] = ("question_id",), n: int = 10) -> DataFrame:
    """The first log of each question and pattern (100 characters of the normalised message), the n patterns seen first."""
    kept = [c for c in logs.columns if c not in by and c != "seq"]
    grouped = logs.withColumn("pattern", F.left(normalize_text("message"), F.lit(100))).groupBy(*by, "pattern").agg(F.min_by(F.struct("seq", *kept), "seq").alias("_f"))
    order = Window.partitionBy(*by).orderBy("seq")
    return grouped.select(*by, "pattern", "_f.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def correlate(patterns: DataFrame, tickets: DataFrame, questions: DataFrame, config: RunConfig) -> DataFrame:
    """(question_id, key, score, matched): tickets like a pattern at 0.5 or more, then the five newest that say a word
    of the question in their summary and are not among these, with score 0.

    patterns: question_id, rank, seq, message, logger, as_of, project. A ticket is reported once a question, for the
    first pattern that found it.
    """
    loose = replace(config, similarity_threshold=0.5)
    asked = patterns.select(F.xxhash64("question_id", "rank").alias("query_id"), "question_id", "rank", "project", F.col("message").alias("title"), "message", "as_of", F.lit(None).cast("string").alias("error_type"), "logger")
    found = dup_similarity(asked, tickets, loose).join(asked.select("query_id", "question_id", "rank", "message"), "query_id")
    like = found.groupBy("question_id", "key").agg(F.min_by(F.struct(F.round("score", 2).alias("score"), F.left("message", F.lit(100)).alias("matched")), "rank").alias("m"))
    like = like.select("question_id", "key", "m.score", "m.matched")
    words = F.filter(F.slice(F.split("query", " "), 1, 5), lambda w: F.char_length(w) >= 3)
    by_word = questions.select("question_id", "project", F.explode(F.array_distinct(F.transform(words, normalize_text))).alias("token"))
    titles = ticket_tokens(tickets.withColumn("description", F.lit("")))
    lists = newest(titles, ("project", "token"), 5)  # no others can be among the newest of a question
    hits = by_word.join(lists, ["project", "token"]).select("question_id", "key", "created").distinct()
    last = newest(hits, ("question_id",), 5).select("question_id", "key")
    rest = last.join(like, ["question_id", "key"], "left_anti").select("question_id", "key", F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("matched"))
    return like.unionByName(rest)
