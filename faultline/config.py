"""Parameters of a run, and teams."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RunConfig:
    """Defaults as the jobs use them; every field is a plain parameter."""

    similarity_threshold: float = 0.82
    direct_log_threshold: float = 0.90
    partial_log_threshold: float = 0.70
    search_max_results: int = 200
    search_window_days: int = 365
    max_tickets_per_run: int = 3
    comment_cooldown_minutes: int = 120
    max_title_length: int = 120
    error_type_days: int = 7
    hours_back: int = 48
    project_key: str = "OPS"
    dry_run: bool = False
    aggregate_email_not_found: bool = False
    aggregate_kafka_consumer: bool = False
    logs_url: str = "https://logs.example.com/logs"

    @property
    def candidates(self) -> int:
        """Tickets looked at for one message: fewer where the threshold is high."""
        t, n = self.similarity_threshold, self.search_max_results
        return min(n, 50) if t >= 0.9 else min(n, 100) if t >= 0.8 else n

    @property
    def window_days(self) -> int:
        return min(self.search_window_days, 180)


@dataclass(frozen=True)
class Team:
    team_id: str
    team_name: str
    project_key: str
    services: tuple[str, ...]
    env: str = "prod"
    enabled: bool = True
    max_tickets_per_run: int | None = None
    severity_rules: dict[str, str] = field(default_factory=dict)
