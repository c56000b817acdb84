"""Closing and consolidating tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words by which a transition closes a ticket, in order of preference: in its target, else in its name.
CLOSE_TARGETS = ("done", "closed", "resolved", "complete", "completed", "fixed", "won't do", "won't fix")
CLOSE_NAMES = ("close", "done", "resolve", "complete", "finish", "won't do", "won't fix")
# States of tickets that need no closing.
CLOSED_STATES = ("done", "closed", "resolved", "tested", "won't do", "won't fix", "cancelled")


def pick_transition(transitions: DataFrame) -> DataFrame:
    """(issue_key, id): for each ticket the transition that closes it best; tickets without one are left out."""

    def best(column: str, words: tuple[str, ...], turn: int):
        low = F.lower(F.coalesce(column, F.lit("")))
        ranks = F.filter(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(i)) for i, w in enumerate(words)]), lambda x: x.isNotNull())
        return F.when(F.size(ranks) > 0, F.struct(F.lit(turn).alias("turn"), F.array_min(ranks).alias("rank")))

    rank = F.coalesce(best("to_status", CLOSE_TARGETS, 0), best("name", CLOSE_NAMES, 1))
    ranked = transitions.withColumn("_rank", rank).where("_rank is not null")
    return ranked.groupBy("issue_key").agg(F.min_by("id", F.struct("_rank", "pos")).alias("id"))


def consolidate(groups: DataFrame) -> DataFrame:
    """Actions (group_id, key, primary_key, action, detail) for groups (group_id, key, status) of two tickets or more.

    The ticket with the smallest number after its last dash is the primary one; others are skipped if closed, else get
    comment, link and close. One row of each group sums up (action 'summary').
    """
    number = F.coalesce(F.substring_index("key", "-", -1).try_cast("int"), F.lit(999999))
    one = groups.dropDuplicates(["group_id", "key"]).withColumn("_n", number)
    info = one.groupBy("group_id").agg(F.min(F.struct("_n", "key")).getField("key").alias("primary_key"), F.count("*").alias("_size")).where("_size >= 2")
    rows = one.join(info, "group_id").withColumn("_closed", F.lower(F.coalesce("status", F.lit(""))).isin(*CLOSED_STATES))
    others = rows.where(F.col("key") != F.col("primary_key"))
    said = F.concat(F.lit("This ticket has been identified as a duplicate of ["), "primary_key", F.lit("]."))
    steps = F.when(F.col("_closed"), F.array(F.struct(F.lit("skip").alias("action"), F.lit("already closed").alias("detail")))).otherwise(
        F.array(
            F.struct(F.lit("comment").alias("action"), said.alias("detail")),
            F.struct(F.lit("link").alias("action"), F.lit("Duplicate").alias("detail")),
            F.struct(F.lit("close").alias("action"), F.lit("Duplicate").alias("detail")),
        )
    )
    actions = others.select("group_id", "key", "primary_key", F.explode(steps).alias("s")).select("group_id", "key", "primary_key", "s.action", "s.detail")
    n_open, n_closed = F.count_if(~F.col("_closed")), F.count_if(F.col("_closed"))
    text = F.when(n_open == 0, F.concat(F.lit("No open duplicates to consolidate ("), n_closed, F.lit(" already closed)"))).otherwise(
        F.concat(F.lit("Consolidated "), n_open, F.lit(" tickets into "), F.first("primary_key"), F.when(n_closed > 0, F.concat(F.lit(" (skipped "), n_closed, F.lit(" already closed)"))).otherwise(""))
    )
    summary = others.groupBy("group_id").agg(F.first("primary_key").alias("key"), F.first("primary_key").alias("primary_key"), F.lit("summary").alias("action"), text.alias("detail"))
    return actions.unionByName(summary)
