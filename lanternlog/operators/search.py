"""Filtered and full-text search, pages and newest rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.functions import fixed
from lanternlog.functions.text import is_error, matches_any, needed_tokens, query_tokens, tokens
from lanternlog.operators.tenancy import for_tenant

LOG_FIELDS = ["ts", "service", "level", "message", "trace_id", "span_id", "host_name"]
ANOMALY_FIELDS = [
    "ts", "event_id", "service", "severity", "anomaly_score", "z_score", "anomaly_type", "title",
    "description", "detection_mode", "error_rate", "message",
]
LOG_LIMIT = 200
ANOMALY_LIMIT = 100
INCIDENT_LIMIT = 200


def clamp(limit: int | None, default: int, cap: int) -> int:
    return min(limit or default, cap)


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Exact filters; empty values and 'all' do not filter, lists match any member."""
    for name, value in values.items():
        if value is None or value == "" or value == "all":
            continue
        df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return df


def in_time(df: DataFrame, start: datetime | Column | None, end: datetime | Column | None, column: str = "ts") -> DataFrame:
    """Rows of a time range; a table with daily partitions reads only their days."""
    if start is not None:
        start = start if isinstance(start, Column) else F.lit(start)
        df = df.where(F.col(column) >= start)
        if "dt" in df.columns:
            df = df.where(F.col("dt") >= F.to_date(start))
    if end is not None:
        end = end if isinstance(end, Column) else F.lit(end)
        df = df.where(F.col(column) <= end)
        if "dt" in df.columns:
            df = df.where(F.col("dt") <= F.to_date(end))
    return df


def full_text(df: DataFrame, query: str | None, fields: list[str]) -> DataFrame:
    """Rows with any word of the query in any of the fields."""
    if not query:
        return df
    return df.where(matches_any(tokens(*[_text(df, f) for f in fields if f in df.columns]), query))


def share_text(df: DataFrame, query: str, fields: list[str], share: float = 0.6) -> DataFrame:
    """Rows with the given share of the query's words in one of the fields."""
    words = query_tokens(query)
    needed = F.greatest(needed_tokens(len(words), share), F.lit(1))
    hit = F.lit(False)
    for name in fields:
        hit = hit | (F.size(F.array_intersect(tokens(F.col(name)), F.array(*[F.lit(w) for w in words]))) >= needed)
    return df.where(hit)


def _text(df: DataFrame, name: str) -> Column:
    return F.array_join(name, " ") if df.schema[name].dataType.typeName() == "array" else F.col(name)


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.select(*[f for f in fields if f in df.columns])


def search_logs(
    logs: DataFrame, tenant: str | None = None, service=None, level=None, query: str | None = None,
    start=None, end=None, limit: int | None = None, fields: list[str] | None = None, cap: int = LOG_LIMIT,
) -> DataFrame:
    """Newest rows that match all filters, ``limit`` of them and no more than ``cap``."""
    rows = where_equal(in_time(for_tenant(logs, tenant), start, end), service=service, level=level)
    rows = full_text(rows, query, ["message", "service", "host_name"])
    rows = rows.orderBy(F.desc("ts"), F.desc("log_seq")).limit(clamp(limit, 50, cap))
    return project(rows, fields or LOG_FIELDS)


def search_anomalies(events: DataFrame, tenant=None, service=None, severity=None, limit=None, fields=None, cap: int = ANOMALY_LIMIT) -> DataFrame:
    rows = where_equal(for_tenant(events, tenant), service=service, severity=severity)
    rows = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(clamp(limit, 20, cap))
    return project(rows, fields or ANOMALY_FIELDS)


def match_incidents(
    incidents: DataFrame, tenant=None, state=None, severity=None, urgency=None, service=None, priority=None,
    query: str | None = None, not_states: list[str] | None = None,
) -> DataFrame:
    rows = where_equal(
        for_tenant(incidents, tenant), state=state, severity=severity, urgency=urgency, service=service,
        priority=priority,
    )
    if not_states:
        rows = rows.where(~F.col("state").isin(not_states))
    return full_text(rows, query, ["title", "description", "service", "tags"])


def search_incidents(
    incidents: DataFrame, sort: str = "created_at", ascending: bool = False, offset: int = 0,
    limit: int | None = None, cap: int = INCIDENT_LIMIT, **filters,
) -> DataFrame:
    """One page of matching incidents."""
    order = F.asc(sort) if ascending else F.desc(sort)
    rows = match_incidents(incidents, **filters).orderBy(order, F.desc("id"))
    return rows.offset(offset).limit(clamp(limit, 50, cap))


def page_info(matching: DataFrame, offset: int, limit: int) -> DataFrame:
    """Total of a match and whether rows follow the page."""
    return matching.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"),
        (F.lit(offset + limit) < F.col("total")).alias("has_more"),
    )


def get_incident(incidents: DataFrame, incident_id: str, tenant: str | None = None) -> DataFrame:
    return for_tenant(incidents, tenant).where(F.col("id") == incident_id)


def newest(df: DataFrame, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc(tie)).limit(n)


def newest_errors(logs: DataFrame, n: int = 50) -> DataFrame:
    return newest(logs.where(is_error(F.col("level"))), n, "log_seq")
