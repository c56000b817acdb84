"""End-to-end jobs on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.config import RunConfig
from faultline.functions import payload
from faultline.operators import classify, dedup, filters, investigate, report
from faultline.operators import tickets as ticket_ops
from faultline.sources.io import settled


def candidates(logs: DataFrame, teams: DataFrame, config: RunConfig, as_of=None, answer: str | None = None) -> DataFrame:
    """Routed logs, reduced to the first of each run and key, with counts, classification and fingerprints.

    The reduction comes before anything that is costly, and carries how often the raw message occurs. Logs are dealt by seq
    before, while they are narrow: first_seen sorts the rows of a task, and a file's split of compressed rows can be many.
    Raw messages are counted before any is normalised, as Spark would normalise them for the counts too.
    """
    plain = dedup.route_to_teams(logs, teams, config)
    routed = dedup.with_keys(plain.repartition("seq"))
    counts = plain.groupBy("run_id", F.sha1(F.concat_ws("|", "logger", "message")).alias("_raw")).agg(F.count("*").alias("occurrences"))
    first = dedup.first_seen(routed).withColumn("_raw", F.sha1(F.concat_ws("|", "logger", "message")))
    first = first.join(counts, ["run_id", "_raw"], "left").drop("_raw")
    ruled = classify.analyse(first, answer) if answer else classify.classify(first)
    when = F.lit(as_of).cast("timestamp") if as_of is not None else F.col("ts")
    out = dedup.with_fingerprints(ruled).withColumns({"as_of": when, "title": F.col("ticket_title"), "cand_id": F.xxhash64("run_id", "log_key")})
    return settled(out)  # distinct errors only; all that follows reads this


def triage_job(logs: DataFrame, teams: DataFrame, tickets: DataFrame, processed: DataFrame, config: RunConfig, as_of=None, answer: str | None = None, exact: bool = True, strategies=None) -> dict[str, DataFrame]:
    """decisions (an audit row a candidate), new_tickets, fingerprints (the store after the run).

    as_of: the time that tickets are looked at from; by default each log's own. strategies: see resolve_duplicates.
    """
    cands = candidates(logs, teams, config, as_of, answer)
    processed = settled(processed.select("team_id", "fingerprint").distinct())  # read by a strategy and by the store after the run
    found = settled(dedup.resolve_duplicates(cands, tickets, processed, config, strategies))
    said = dedup.resolve_in_run(found, config.dry_run, exact)
    rows = found.drop("decision").join(said.withColumnRenamed("in_run", "decision"), "cand_id")
    made = rows.where(F.col("decision").isin("created", "simulated"))
    columns = made.columns
    new_tickets = made.select(
        "cand_id", "project", payload.ticket_title(config).alias("summary"), payload.ticket_body(columns, config).alias("description"),
        payload.ticket_labels(config).alias("labels"), F.col("severity"),
    )
    decisions = rows.select(
        F.col("as_of").alias("ts"), "fingerprint", "error_type", "severity", "create_ticket", F.col("decision").startswith("duplicate").alias("duplicate"), "decision",
        F.col("existing_key").alias("existing_issue_key"), "occurrences", "message", "strategy_name", "team_id", F.col("service").alias("team_service"), "run_id", "seq",
    )
    kept = rows.where(F.col("decision").isin("created", "duplicate-error-type") | (F.col("strategy_name") == "similarity"))
    both = F.when(F.col("decision") == "created", F.array("fingerprint", "logger_fingerprint")).otherwise(F.array("fingerprint"))
    store = processed.unionByName(kept.select("team_id", F.explode(both).alias("fingerprint"))).distinct()
    return {"decisions": decisions, "new_tickets": new_tickets, "fingerprints": store}


def investigate_job(questions: DataFrame, logs: DataFrame, tickets: DataFrame, config: RunConfig) -> dict[str, DataFrame]:
    """logs, patterns, related (tickets), summary and actions for many questions at once."""
    found = filters.rule_query_filter(logs, questions)
    patterns = settled(investigate.unique_patterns(found).join(questions.select("question_id", "project", "as_of"), "question_id"))
    related = investigate.correlate(patterns, tickets, questions, config)
    groups = related.join(tickets.select("key", "status"), "key").select(F.col("question_id").alias("group_id"), "key", "status")
    return {"logs": found, "patterns": patterns, "related": related, "summary": report.basic_analysis(found, ("question_id",), related), "actions": ticket_ops.consolidate(groups)}


def report_job(rows: DataFrame, hours: int, now, service=None, severity=None, error_type=None, decision=None, top: int = 10) -> dict[str, DataFrame]:
    """summary, by_team, counts (top values), trends."""
    own = filters.filter_audit(filters.filter_since(rows, hours, now), service, severity, error_type, decision)
    return {"summary": report.audit_summary(own), "by_team": report.audit_by_team(own), "counts": report.top_n(report.audit_counts(own), top), "trends": report.temporal_breakdown(own)}
