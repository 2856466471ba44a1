"""Checks of uploaded logs and of the table contracts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.functions import fixed


def validate_logs(rows: DataFrame) -> DataFrame:
    """Checks of flat log rows (column ``f``: map of their fields), over all rows.

    One row of counts.  A field is missing when no row carries it; content
    is unreadable when no row has a text longer than three characters.
    """
    def has(name):
        return F.coalesce(F.try_element_at("f", F.lit(name)), F.lit("")) != ""

    level = F.upper(F.coalesce(F.try_element_at("f", F.lit("level")), F.lit("")))
    stamp = F.try_element_at("f", F.lit("timestamp"))
    readable = F.exists(F.map_values("f"), lambda v: F.length(v) > 3)
    counted = rows.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(has(n)).alias(f"n_{n}") for n in fixed.REQUIRED_FIELDS + fixed.RECOMMENDED_FIELDS],
        F.count_if((level != "") & ~level.isin(fixed.UPLOAD_LEVELS)).alias("bad_levels"),
        F.count_if(readable).alias("readable"),
        F.count_if((F.coalesce(stamp, F.lit("")) != "") & F.try_to_timestamp(stamp).isNull()).alias("bad_timestamps"),
    )
    missing = lambda names: F.array_compact(F.array(*[F.when(F.col(f"n_{n}") == 0, n) for n in names]))
    return counted.select(
        "total",
        ((F.col("total") > 0) & (F.size(missing(fixed.REQUIRED_FIELDS)) == 0) & (F.col("readable") > 0)).alias("valid"),
        F.array_join(missing(fixed.REQUIRED_FIELDS), ",").alias("missing_required"),
        F.array_join(missing(fixed.RECOMMENDED_FIELDS), ",").alias("missing_recommended"),
        "bad_levels", "readable", "bad_timestamps",
    )


@dataclass(frozen=True)
class Contract:
    """What a table promises: fields that must be filled, value sets, unit ranges."""

    required: list[str]
    allowed: dict[str, list[str]] = field(default_factory=dict)
    unit_range: list[str] = field(default_factory=list)
    known: list[str] | None = None


LOG_CONTRACT = Contract(
    required=["ts", "log_id", "level", "message", "service", "tenant_id"],
    allowed={"level": fixed.LEVELS},
    unit_range=["anomaly_score"],
)
ANOMALY_CONTRACT = Contract(
    required=["event_id", "ts", "anomaly_type", "anomaly_score", "severity", "service", "tenant_id"],
    allowed={
        "severity": fixed.SEVERITIES,
        "status": ["open", "acknowledged", "resolved"],
        "detection_mode": ["immediate", "windowed"],
    },
    unit_range=["anomaly_score", "error_rate"],
    known=[
        "event_id", "ts", "anomaly_type", "anomaly_score", "severity", "service", "tenant_id", "detected_at",
        "environment", "message", "description", "trace_id", "span_ids", "affected_services", "affected_endpoint",
        "causal_chain", "evidence_logs", "z_score", "error_rate", "status", "error_message", "error_category",
        "detection_mode", "signal_weights",
    ],
)
INCIDENT_CONTRACT = Contract(
    required=["id", "created_at", "title", "severity", "state", "service", "tenant_id"],
    allowed={
        "severity": fixed.SEVERITIES,
        "state": fixed.STATES,
        "urgency": fixed.URGENCIES,
        "priority": ["P1", "P2", "P3", "P4", "P5"],
    },
    unit_range=["anomaly_score"],
    known=[
        "id", "created_at", "title", "severity", "urgency", "priority", "state", "service", "tenant_id", "environment", "description",
        "anomaly_type", "anomaly_score", "affected_services", "affected_endpoint", "trace_id", "evidence_logs", "causal_chain",
        "error_message", "error_category", "updated_at", "resolved_at",
    ],
)


def contract_rules(df: DataFrame, contract: Contract) -> dict[str, Column]:
    """Rule name -> condition that holds for a row that breaks it."""
    rules = {}
    for name in contract.required:
        if name not in df.columns:
            rules[f"missing:{name}"] = F.lit(True)
        else:
            value = F.col(name)
            empty = value.isNull()
            if df.schema[name].dataType.typeName() == "string" and name != "message":
                empty = empty | (value == "")
            rules[f"missing:{name}"] = empty
    for name, values in contract.allowed.items():
        if name in df.columns:
            rules[f"value:{name}"] = F.coalesce(~F.col(name).isin(values), F.lit(False))
    for name in contract.unit_range:
        if name in df.columns:
            rules[f"range:{name}"] = F.coalesce((F.col(name) < 0) | (F.col(name) > 1), F.lit(False))
    if contract.known is not None:
        for name in df.columns:
            if name not in contract.known:
                rules[f"unknown:{name}"] = F.lit(True)
    return rules


def contract_report(df: DataFrame, contract: Contract) -> DataFrame:
    """(rule, broken, total) in one pass over the table."""
    rules = contract_rules(df, contract)
    counts = df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())]
    )
    pairs = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("broken")) for i, n in enumerate(rules)]
    )
    return counts.select(F.inline(pairs), "total")


def contract_rejects(df: DataFrame, contract: Contract) -> DataFrame:
    """Rows that break a rule, with the names of the rules they break."""
    rules = {n: c for n, c in contract_rules(df, contract).items() if not n.startswith("unknown:")}
    broken = F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))
    return df.withColumn("broken_rules", broken).where(F.size("broken_rules") > 0)
