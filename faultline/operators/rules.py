"""The rule table of the classifier, as data."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    error_type: str
    severity: str
    title: str
    patterns: tuple[str, ...]
    keywords: tuple[str, ...]


# Error types in the order in which ties are decided.
RULES = (
    Rule("database-connection", "high", "Database Connection Error", (r"database.*connection.*fail", r"connection.*timeout.*database", r"could not connect.*database", r"database.*unavailable", r"connection.*refused.*database", r"sql.*connection.*error"), ("database", "connection", "sql", "db")),
    Rule("database-constraint", "medium", "Database Constraint Violation", (r"constraint.*violation", r"unique.*constraint", r"foreign.*key.*constraint", r"check.*constraint.*failed", r"duplicate.*key.*value", r"violates.*constraint"), ("constraint", "violation", "duplicate", "key")),
    Rule("timeout", "medium", "Operation Timeout", (r"timeout.*occurred", r"request.*timeout", r"connection.*timeout", r"read.*timeout", r"socket.*timeout", r"operation.*timed.*out"), ("timeout", "timed out")),
    Rule("network-error", "high", "Network Error", (r"network.*error", r"connection.*reset", r"no.*route.*to.*host", r"network.*unreachable", r"connection.*refused", r"host.*not.*found"), ("network", "connection", "host", "unreachable")),
    Rule("http-client-error", "low", "HTTP Client Error", (r"4\d{2}.*error", r"bad.*request", r"unauthorized", r"forbidden", r"not.*found.*404", r"method.*not.*allowed"), ("400", "401", "403", "404", "405")),
    Rule("http-server-error", "high", "HTTP Server Error", (r"5\d{2}.*error", r"internal.*server.*error", r"service.*unavailable", r"gateway.*timeout", r"bad.*gateway"), ("500", "502", "503", "504")),
    Rule("authentication-error", "medium", "Authentication Error", (r"authentication.*failed", r"invalid.*credentials", r"access.*denied", r"unauthorized.*access", r"token.*expired", r"permission.*denied"), ("auth", "credentials", "token", "permission")),
    Rule("file-not-found", "low", "File Not Found", (r"file.*not.*found", r"no.*such.*file", r"path.*does.*not.*exist", r"cannot.*find.*file", r"missing.*file"), ("file", "path", "missing", "not found")),
    Rule("disk-space", "high", "Disk Space Error", (r"disk.*full", r"no.*space.*left", r"disk.*space.*exceeded", r"storage.*quota.*exceeded", r"insufficient.*disk.*space"), ("disk", "space", "full", "quota")),
    Rule("out-of-memory", "high", "Memory Error", (r"out.*of.*memory", r"memory.*allocation.*failed", r"insufficient.*memory", r"heap.*space.*exceeded", r"memory.*limit.*exceeded"), ("memory", "heap", "allocation", "oom")),
    Rule("configuration-error", "medium", "Configuration Error", (r"configuration.*error", r"missing.*configuration", r"invalid.*configuration", r"config.*not.*found", r"property.*not.*found"), ("config", "configuration", "property", "setting")),
    Rule("kafka-consumer", "medium", "Kafka Consumer Error", (r"kafka.*consumer.*error", r"failed.*to.*consume.*message", r"consumer.*group.*error", r"offset.*commit.*failed", r"partition.*assignment.*failed"), ("kafka", "consumer", "message", "partition")),
    Rule("message-queue", "medium", "Message Queue Error", (r"message.*queue.*error", r"queue.*not.*found", r"failed.*to.*publish.*message", r"message.*processing.*failed", r"dead.*letter.*queue"), ("queue", "message", "publish", "processing")),
)
# Fixed value: the rule for what none of the others is sure about.
GENERIC = Rule("unknown", "medium", "System Error", (r"error", r"exception", r"failed", r"failure"), ("error", "exception", "failed"))
# Words that set or lift a severity.
HIGH_WORDS = ("critical", "fatal", "severe", "urgent", "emergency")
MEDIUM_WORDS = ("warning", "warn", "deprecated")
CRITICAL_LOGGERS = ("payment", "security", "auth", "billing")
# Causes and actions by error type; the last is for all others.
CAUSES = {
    "database-connection": ("Database server is down or unreachable", "Network connectivity issues", "Connection pool exhausted", "Database authentication problems", "Firewall blocking database connections"),
    "timeout": ("External service is slow or unresponsive", "Network latency issues", "Resource contention", "Configuration timeout values too low", "System overload"),
    "authentication-error": ("Invalid or expired credentials", "Permission configuration issues", "Token expiration", "Authentication service unavailable", "User account locked or disabled"),
    "file-not-found": ("File was moved or deleted", "Incorrect file path configuration", "Permission issues accessing file", "File system corruption", "Network drive disconnected"),
    "out-of-memory": ("Memory leak in application", "Insufficient system memory", "Memory configuration too low", "Large data processing without proper handling", "Memory fragmentation"),
    "": ("System configuration issues", "External dependency problems", "Resource constraints", "Network connectivity issues", "Application logic errors"),
}
ACTIONS = {
    "database-connection": ("Check database server status and logs", "Verify network connectivity to database", "Review connection pool configuration", "Check database authentication credentials", "Monitor database performance metrics"),
    "timeout": ("Check external service status", "Review timeout configuration values", "Monitor system resource usage", "Investigate network latency", "Consider implementing retry mechanisms"),
    "authentication-error": ("Verify user credentials and permissions", "Check token expiration and renewal", "Review authentication service logs", "Validate configuration settings", "Test authentication flow manually"),
    "file-not-found": ("Verify file existence and location", "Check file permissions and ownership", "Review file path configuration", "Monitor file system health", "Implement file existence checks"),
    "out-of-memory": ("Review application memory usage patterns", "Increase available system memory", "Optimize memory-intensive operations", "Implement proper resource cleanup", "Monitor memory usage trends"),
    "": ("Review system logs for additional context", "Check configuration settings", "Monitor system resource usage", "Verify external dependencies", "Implement proper error handling"),
}
