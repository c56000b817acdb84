"""Reports over audit rows, logs and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import stack_frame

DIMS = ("error_type", "severity", "decision", "fingerprint", "issue")


def _decision() -> Column:
    return F.lower(F.coalesce("decision", F.lit("")))


def _duplicate() -> Column:
    return _decision().startswith("duplicate")


def _totals() -> list[Column]:
    d = _decision()
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    created, dupes = F.count_if(d == "created"), F.count_if(_duplicate())
    return [
        F.count("*").alias("total"),
        F.when(created == 0, flag("ticket_created")).otherwise(created).alias("created"),
        F.when(dupes == 0, flag("duplicate")).otherwise(dupes).alias("duplicates"),
        F.count_if(d == "simulated").alias("simulated"),
        F.count_if((d == "simulated") & F.coalesce("create_ticket", F.lit(False))).alias("would_create"),
        F.count_if(d == "cap-reached").alias("cap_reached"),
        F.count_if(d == "").alias("unknown_decisions"),
    ]


def audit_summary(rows: DataFrame) -> DataFrame:
    """One row of totals. Where no decision says created (or duplicate), the older flags count instead."""
    return rows.agg(*_totals())


def audit_by_team(rows: DataFrame) -> DataFrame:
    """Totals of each team, and of all (team_id null, is_total true)."""
    return rows.rollup("team_id").agg(*_totals(), (F.grouping_id() == 1).alias("is_total"))


def dimension(dim: str) -> Column:
    if dim == "error_type":
        return F.coalesce("error_type", F.lit("<unknown>"))
    if dim in ("severity", "decision"):
        return F.lower(F.coalesce(dim, F.lit("<unknown>")))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    if dim == "fingerprint":
        return F.coalesce(filled("fingerprint"), filled("log_fingerprint"), filled("log_key"), F.lit("<none>"))
    if dim == "issue":
        return F.coalesce(filled("jira_key"), filled("existing_issue_key"), F.lit("<none>"))
    raise ValueError(f"no such dimension: {dim}")


def audit_counts(rows: DataFrame, *dims: str) -> DataFrame:
    """(dim, value, n) for the dimensions (all five by default), in one pass; counts are combined before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), dimension(d).alias("value")) for d in dims or DIMS]))
    return rows.select(pairs.alias("p")).groupBy("p.dim", "p.value").agg(F.count("*").alias("n"))


def top_n(counts: DataFrame, n: int, by: tuple[str, ...] = ("dim",)) -> DataFrame:
    """The n most frequent values of each dimension; ties by value. Adds rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def temporal_breakdown(rows: DataFrame, granularity: str = "day") -> DataFrame:
    """(bucket string, total, created, duplicates); rows without a ts don't count."""
    form = {"day": "yyyy-MM-dd", "hour": "yyyy-MM-dd'T'HH:00"}[granularity]
    at = rows.where("ts is not null").groupBy(F.date_trunc(granularity, "ts").alias("at"))
    counted = at.agg(F.count("*").alias("total"), F.count_if(_decision() == "created").alias("created"), F.count_if(_duplicate()).alias("duplicates"))
    return counted.select(F.date_format("at", form).alias("bucket"), "total", "created", "duplicates")


def metric_rollup(rows: DataFrame) -> DataFrame:
    """Counters for each team and service, each of them, and all."""
    return rows.cube("team_id", "team_service").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("total"), F.count_if(_decision() == "created").alias("created"), F.count_if(_duplicate()).alias("duplicates"))


def errors_by_hour(rows: DataFrame) -> DataFrame:
    """(hour of the day, error_type, n)."""
    return rows.where("ts is not null").groupBy(F.hour("ts").alias("hour"), F.coalesce("error_type", F.lit("<unknown>")).alias("error_type")).agg(F.count("*").alias("n"))


def message_patterns(logs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(pattern, n, first_seq) for the first 50 characters of messages."""
    return logs.groupBy(*by, F.left(F.coalesce("message", F.lit("")), F.lit(50)).alias("pattern")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def basic_analysis(logs: DataFrame, by: tuple[str, ...] = ("question_id",), tickets: DataFrame | None = None) -> DataFrame:
    """A sentence on each question's logs: how many, the most common pattern (the first on ties), related tickets."""
    top = message_patterns(logs, by).groupBy(*by).agg(F.sum("n").alias("logs"), F.max_by(F.struct("pattern", "n"), F.struct("n", -F.col("first_seq"))).alias("top"))
    if tickets is not None:
        top = top.join(tickets.groupBy(*by).agg(F.count_distinct("key").alias("tickets")), list(by), "left")
    n = F.coalesce(F.col("tickets"), F.lit(0)) if tickets is not None else F.lit(0)
    common = F.concat(F.lit("Most common pattern ("), F.col("top.n"), F.lit(" occurrences): '"), F.col("top.pattern"), F.lit("...'. "))
    summary = F.concat(
        F.lit("Found "), F.col("logs"), F.lit(" error logs. "), F.when(F.col("top.n") > 1, common).otherwise(""),
        F.when(n > 0, F.concat(F.lit("Found "), n, F.lit(" related Jira tickets."))).otherwise(""),
    )
    return top.select(*by, "logs", F.col("top.pattern").alias("pattern"), F.col("top.n").alias("n"), summary.alias("summary"))


def run_stats(outcomes: DataFrame) -> DataFrame:
    """Totals of processed logs (action, processing_s, started, ended). 0 where nothing ran."""
    action = F.lower(F.coalesce("action", F.lit("")))
    seconds = F.coalesce(F.unix_micros(F.max("ended")) - F.unix_micros(F.min("started")), F.lit(0)) / F.lit(1e6)
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return outcomes.agg(
        F.count("*").alias("processed"),
        *[F.count_if(action == a).alias(n) for a, n in (("created", "created"), ("simulated", "simulated"), ("duplicate", "duplicates"), ("error", "errors"))],
        r(seconds).alias("duration_s"), r(F.when(seconds > 0, F.count("*") / seconds)).alias("logs_per_s"),
        r(F.avg("processing_s")).alias("avg_s"), r(F.min("processing_s")).alias("min_s"), r(F.max("processing_s")).alias("max_s"),
    )


def operation_stats(samples: DataFrame, last: int = 100) -> DataFrame:
    """Milliseconds of the last samples (operation, seq, duration_s) of each operation."""
    order = Window.partitionBy("operation").orderBy(F.desc("seq"))
    recent = samples.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= last)
    ms = lambda c: F.round(c * 1000, 2)
    return recent.groupBy("operation").agg(F.count("*").alias("n"), *[ms(f("duration_s")).alias(name) for name, f in (("avg_ms", F.avg), ("min_ms", F.min), ("max_ms", F.max), ("total_ms", F.sum))])


def fault_hotspots(traces: DataFrame) -> DataFrame:
    """(service, file, line, n) of the frames named in stack traces (column detail)."""
    framed = traces.select("service", stack_frame("detail").alias("f")).where("f is not null")
    return framed.groupBy("service", F.col("f.file").alias("file"), F.col("f.line").alias("line")).agg(F.count("*").alias("n"))
