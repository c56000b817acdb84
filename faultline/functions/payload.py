"""Columns of a ticket to be made: prompt text, title, labels and body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.config import RunConfig
from faultline.functions.text import mask_pii


def _field(df_columns: list[str], name: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default)) if name in df_columns else F.lit(default)


def contextual_log(columns: list[str], hours: int = 48) -> Column:
    """The text of a log for a model: service, environment, logger, thread, message, detail, and if there are columns for
    them occurrences and severity_rules (a map, rendered in the order of its keys)."""
    line = lambda name, value: F.concat(F.lit(f"[{name}]: "), value)
    lines = [
        line("Service", _field(columns, "service", "unknown")),
        line("Environment", _field(columns, "env", "unknown")),
        line("Logger", _field(columns, "logger", "unknown.logger")),
        line("Thread", _field(columns, "thread", "unknown.thread")),
        line("Message", _field(columns, "message", "<no message>")),
        line("Detail", _field(columns, "detail", "<no detail>")),
    ]
    if "occurrences" in columns:
        lines.append(line(f"Occurrences in last {hours}h", F.coalesce(F.col("occurrences"), F.lit(1)).cast("string")))
    if "severity_rules" in columns:
        rules = F.transform(F.array_sort(F.map_entries("severity_rules")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        lines.append(F.when(F.size(F.coalesce("severity_rules", F.create_map().cast("map<string,string>"))) > 0, line("Severity hints", F.array_join(rules, ", "))))
    return F.concat_ws("\n", *lines)


def ticket_title(config: RunConfig) -> Column:
    """From ticket_title and error_type: without **, cut to the limit, with the prefix."""
    kind = F.col("error_type")
    title = F.trim(F.replace("ticket_title", F.lit("**"), F.lit("")))
    if config.aggregate_email_not_found:
        title = F.when(kind == "email-not-found", F.lit("Investigate Email Not Found errors (aggregated)")).otherwise(title)
    if config.aggregate_kafka_consumer:
        title = F.when(kind == "kafka-consumer", F.lit("Investigate Kafka Consumer errors (aggregated)")).otherwise(title)
    n = config.max_title_length
    title = F.when(F.char_length(title) > n, F.concat(F.left(title, F.lit(n - 1)), F.lit("…"))).otherwise(title)
    prefix = F.concat(F.lit("[Datadog]"), F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit("["), kind, F.lit("]"))).otherwise(F.lit("")))
    return F.trim(F.concat(prefix, F.lit(" "), title))


def ticket_labels(config: RunConfig, extra: tuple[str, ...] = ()) -> Column:
    """From team_id, env, loghash and error_type."""
    kind = F.lower(F.trim(F.coalesce("error_type", F.lit(""))))
    filled = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    labels = [
        F.lit("datadog-log"),
        filled(F.col("team_id")),
        F.concat(F.lit("env-"), filled(F.col("env"))),
        *map(F.lit, extra),
        F.concat(F.lit("loghash-"), filled(F.col("loghash"))),
        F.when(~kind.isin("", "unknown"), kind),
    ]
    if config.aggregate_email_not_found:
        labels.append(F.when(kind == "email-not-found", F.lit("aggregate-email-not-found")))
    if config.aggregate_kafka_consumer:
        labels.append(F.when(kind == "kafka-consumer", F.lit("aggregate-kafka-consumer")))
    return F.array_compact(F.array(*labels))


def ticket_body(columns: list[str], config: RunConfig) -> Column:
    """The description with the log's context, ids and links to searches."""
    has = lambda c: F.nullif(F.col(c), F.lit("")) if c in columns else F.lit(None).cast("string")
    shown = lambda c: F.coalesce(F.col(c), F.lit("N/A")) if c in columns else F.lit("N/A")
    request, user, kind, logger = has("request_id"), has("user_id"), has("event_error_type"), has("logger")
    lines = [
        F.lit("\n---"),
        F.concat(F.lit("\U0001f30d Environment: "), F.col("env")),
        F.concat(F.lit("\U0001f4e6 Service: "), F.col("service")),
        F.concat(F.lit("\U0001f552 Timestamp: "), shown("timestamp")),
        F.concat(F.lit("\U0001f9e9 Logger: "), shown("logger")),
        F.concat(F.lit("\U0001f9f5 Thread: "), shown("thread")),
        F.concat(F.lit("\U0001f4dd Original Log: "), mask_pii(shown("message"))),
        F.concat(F.lit("\U0001f50d Detail: "), mask_pii(shown("detail"))),
        F.concat(F.lit(f"\U0001f4c8 Occurrences in last {config.hours_back}h: "), F.coalesce(F.col("occurrences"), F.lit(1)).cast("string")),
        F.when(F.coalesce(request, user, kind).isNotNull(), F.lit("---")),
        F.concat(F.lit("\U0001f4cb Request ID: "), request),
        F.concat(F.lit("\U0001f464 User ID: "), user),
        F.concat(F.lit("\U0001f3f7️ Error Type: "), kind),
        F.when(F.coalesce(request, user, logger).isNotNull(), F.lit("---\n\U0001f517 Datadog Links:")),
    ]

    def link(name: str, query: Column) -> Column:
        for sign, code in ((" ", "%20"), (":", "%3A"), ("@", "%40")):
            query = F.replace(query, F.lit(sign), F.lit(code))
        return F.concat(F.lit(f"• {name}: {config.logs_url}?query="), query)

    service = F.concat(F.lit("service:"), F.col("service"))
    lines += [
        link("Request Trace", F.concat(service, F.lit(" @requestId:"), request)),
        link("User Activity", F.concat(service, F.lit(" @userId:"), user)),
        link("Similar Errors", F.concat(service, F.lit(" @logger_name:"), logger, F.lit(" status:error"))),
    ]
    return F.concat(F.trim(F.col("ticket_description")), F.lit("\n"), F.concat_ws("\n", *lines))
