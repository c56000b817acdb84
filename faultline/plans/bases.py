"""The driver's tables in the roles of logs, tickets, audit rows and teams, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schemas

#: Four teams, as configuration would name them.
TEAM_ROWS = [
    ("team-0", "Alpha", "OPS", ["en"], "prod", True, None, {"timeout": "high"}),
    ("team-1", "Beta", "OPS", ["fr", "de"], "prod", True, 5, {}),
    ("team-2", "Gamma", "WEB", ["es"], "prod", True, 0, {}),
    ("team-3", "Delta", "WEB", ["en", "fr"], "prod", False, 1, {}),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def teams(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEAM_ROWS, schemas.TEAMS)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.col("text").alias("message"), F.col("source").alias("logger"), F.col("lang").alias("service"), F.lit("prod").alias("env"),
        F.when(F.col("doc_id") % 5 == 0, "warn").otherwise("error").alias("status"), F.concat(F.lit("t-"), F.col("doc_id") % 7).alias("thread"),
        at.alias("ts"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit("").alias("detail"),
    )


LOGS = """logs AS (SELECT doc_id AS seq, text AS message, source AS logger, lang AS service, 'prod' AS env,
  CASE WHEN doc_id % 5 = 0 THEN 'warn' ELSE 'error' END AS status, 't-' || (doc_id % 7) AS thread,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS ts, '' AS detail FROM documents)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error messages made of the events: one of twelve kinds, with numbers, addresses and ids in them."""
    kinds = F.array(*map(F.lit, MESSAGES))
    e = table(spark, sf_dir, "events")
    text = F.element_at(kinds, (F.pmod(F.col("event_id"), F.lit(len(MESSAGES))) + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("{id}"), (F.col("event_id") + 100000).cast("string")), F.lit("{user}"), F.col("user_id").cast("string"))
    return e.select(
        F.col("event_id").alias("seq"), text.alias("message"), F.concat(F.lit("com.shop."), F.element_at(F.array(*map(F.lit, LOGGERS)), (F.pmod(F.col("user_id"), F.lit(len(LOGGERS))) + 1).cast("int"))).alias("logger"),
        F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.pmod(F.col("user_id"), F.lit(4)) + 1).cast("int")).alias("service"),
        F.lit("prod").alias("env"), F.lit("error").alias("status"), F.concat(F.lit("t-"), F.col("event_id") % 7).alias("thread"), F.col("ts").cast("timestamp").alias("ts"),
        F.lit("2024-01-01").alias("timestamp"), F.lit("").alias("detail"),
    )


MESSAGES = (
    "Database connection failed for user{user}@example.com after {id} ms",
    "Request timeout occurred while reading https://api.example.com/v1/orders/{id}",
    "Kafka consumer group error on partition {user}: offset commit failed",
    "Authentication failed: token expired for account {id}",
    "failed to get file size by name {id}_report.dpplan, cause: status code 404, (blobnotfound)",
    "500 internal server error from payment gateway, request {id}",
    "No space left on device /var/data/{id}: disk full",
    "Duplicate entry 'user-{id}' for key 'PRIMARY': unique constraint violation",
    "java.lang.OutOfMemoryError: heap space exceeded at com.shop.Cart.add(Cart.java:{user})",
    "File not found: /srv/files/{id}.csv",
    "Configuration error: property not found in settings.yaml for 10.0.0.{user}",
    "Unexpected failure in step {user}",
)
LOGGERS = ("payment.Gateway", "orders.Service", "auth.Login", "catalog.Search", "unknown.logger")


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


MESSAGES_SQL = f"""messages AS (SELECT event_id AS seq,
  replace(replace({_sql_list(MESSAGES)}[event_id % {len(MESSAGES)} + 1], '{{id}}', CAST(event_id + 100000 AS VARCHAR)), '{{user}}', CAST(user_id AS VARCHAR)) AS message,
  'com.shop.' || {_sql_list(LOGGERS)}[user_id % {len(LOGGERS)} + 1] AS logger, {_sql_list(("en", "fr", "de", "es"))}[user_id % 4 + 1] AS service,
  'prod' AS env, 'error' AS status, 't-' || (event_id % 7) AS thread, CAST(ts AS TIMESTAMP) AS ts, '' AS detail FROM events)"""


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("BM-"), n).alias("key"), F.when(n % 3 == 0, "WEB").otherwise("OPS").alias("project"), F.left("text", F.lit(120)).alias("summary"), F.col("text").alias("description"),
        F.when(n % 2 == 0, F.array(F.lit("datadog-log"), F.lit("timeout"))).otherwise(F.array(F.lit("manual"))).alias("labels"),
        F.timestamp_seconds(F.lit(1704067200) + n * 3600).alias("created"), F.element_at(F.array(*map(F.lit, ("Open", "Done", "In Progress", "Closed"))), (n % 4 + 1).cast("int")).alias("status"),
        F.when(n % 4 == 1, "Done").when(n % 4 == 3, "Done").otherwise("To Do").alias("status_category"), F.lit("Low").alias("priority"),
    )


TICKETS = """tickets AS (SELECT 'BM-' || item_id AS key, CASE WHEN item_id % 3 = 0 THEN 'WEB' ELSE 'OPS' END AS project, left(text, 120) AS summary, text AS description,
  CASE WHEN item_id % 2 = 0 THEN ['datadog-log', 'timeout'] ELSE ['manual'] END AS labels, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(item_id AS BIGINT)) AS created,
  ['Open', 'Done', 'In Progress', 'Closed'][item_id % 4 + 1] AS status, CASE WHEN item_id % 2 = 1 THEN 'Done' ELSE 'To Do' END AS status_category FROM benchmark)"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    decision = F.when(kind == "purchase", "created").when(kind == "error", "duplicate-jira").when(kind == "signup", "Simulated").when(kind == "view", "cap-reached")
    none = F.lit(None)
    return table(spark, sf_dir, "events").select(
        F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), user.cast("string").alias("fingerprint"), kind.alias("error_type"),
        F.when(F.col("value") < 20, "Low").when(F.col("value") < 60, "medium").otherwise("high").alias("severity"), (F.col("value") > 50).alias("create_ticket"),
        (kind == "error").alias("duplicate"), decision.alias("decision"), F.when(kind == "error", F.concat(F.lit("T-"), user % 50)).alias("existing_issue_key"),
        F.when(kind == "purchase", F.concat(F.lit("T-"), F.col("event_id") % 20)).alias("jira_key"), F.lit(1).cast("long").alias("occurrences"),
        F.concat(F.lit("team-"), user % 4).alias("team_id"), F.concat(F.lit("svc-"), user % 7).alias("team_service"), none.cast("string").alias("log_fingerprint"),
        none.cast("string").alias("log_key"), none.cast("boolean").alias("ticket_created"),
    )


AUDIT = """audit AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, CAST(user_id AS VARCHAR) AS fingerprint, event_type AS error_type,
  CASE WHEN value < 20 THEN 'Low' WHEN value < 60 THEN 'medium' ELSE 'high' END AS severity, value > 50 AS create_ticket, event_type = 'error' AS duplicate,
  CASE event_type WHEN 'purchase' THEN 'created' WHEN 'error' THEN 'duplicate-jira' WHEN 'signup' THEN 'Simulated' WHEN 'view' THEN 'cap-reached' END AS decision,
  CASE WHEN event_type = 'error' THEN 'T-' || (user_id % 50) END AS existing_issue_key, CASE WHEN event_type = 'purchase' THEN 'T-' || (event_id % 20) END AS jira_key,
  'team-' || (user_id % 4) AS team_id, 'svc-' || (user_id % 7) AS team_service FROM events)"""
