"""All thresholds, windows and names in one place, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # rule scorer
    rule_threshold: float = 0.65

    # composite scorer
    bucket_seconds: int = 10
    window_seconds: int = 300
    min_buckets: int = 3
    zscore_threshold: float = 2.0
    composite_threshold: float = 0.3
    blast_window_seconds: int = 300
    immediate_dedup_seconds: int = 300
    immediate_floor: float = 0.65

    # traces
    trace_row_cap: int = 200
    trace_wait_seconds: int = 10
    trace_forget_seconds: int = 900

    # incidents
    ticket_min_score: float = 0.5
    ticket_dedup_seconds: int = 900
    ticket_group_size: int = 5
    evidence_rows: int = 50
    similar_rows: int = 3
    duplicate_token_share: float = 0.6
    incident_retention_days: int = 97

    # tables and topics
    default_tenant: str = "dev-local"
    dlq_topic: str = "dead-letter-queue"
    raw_topic: str = "raw-logs"
    enriched_topic: str = "enriched-logs"
    anomaly_topic: str = "anomaly-events"
    log_retention_days: int = 9
    anomaly_retention_days: int = 97

    # routing: severity -> platforms; an empty list means every enabled platform
    routing: dict = field(
        default_factory=lambda: {"critical": [], "high": [], "medium": [], "low": []}
    )

    # quotas per tenant and minute
    ingest_quota_rpm: int = 6000
    query_quota_rpm: int = 300


DEFAULTS = Params()
