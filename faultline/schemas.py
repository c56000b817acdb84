"""Explicit schemas of what is read. Nothing is inferred."""

LOG_EVENTS = (
    "data array<struct<attributes: struct<message: string, timestamp: string, service: string, status: string, host: string, "
    "attributes: struct<logger: struct<name: string, thread_name: string>, properties: struct<Log: variant>, "
    "requestId: string, request_id: string, userId: string, user_id: string, errorType: string, error_type: string>>>>, "
    "meta struct<page: struct<after: string>>"
)
LOGS = "service string, env string, status string, logger string, thread string, message string, timestamp string, detail string, ts timestamp"
AUDIT = (
    "timestamp string, fingerprint string, error_type string, severity string, create_ticket boolean, duplicate boolean, decision string, "
    "existing_issue_key string, jira_key string, occurrences bigint, message string, strategy_name string, team_id string, team_service string, "
    "async boolean, log_fingerprint string, log_key string, ticket_created boolean"
)
TICKETS = "key string, project string, summary string, description string, labels array<string>, created timestamp, status string, status_category string, priority string"
TEAMS = (
    "team_id string, team_name string, project_key string, services array<string>, env string, enabled boolean, max_tickets_per_run int, "
    "severity_rules map<string,string>"
)
FINGERPRINTS = "team_id string, fingerprint string"
