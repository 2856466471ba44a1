"""Stateless additive scorer: level, message pattern, service features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.functions import fixed
from lanternlog.functions.signals import ladder, optional
from lanternlog.functions.text import first_keyword_class
from lanternlog.params import DEFAULTS, Params


def _by_level(level: Column, position: int, default):
    out = None
    for row in fixed.RULE_LEVELS:
        hit = level == row[0]
        out = F.when(hit, F.lit(row[position])) if out is None else out.when(hit, F.lit(row[position]))
    return out.otherwise(F.lit(default))


def rule_scores(logs: DataFrame, threshold: float | None = None) -> DataFrame:
    """Add the score parts of every row, of rows that reach the threshold when one is given."""
    level = F.upper(F.coalesce(F.col("level"), F.lit("INFO")))
    message = F.coalesce(F.col("message"), F.lit(""))
    level_type = _by_level(level, 2, "unknown")
    level_score = _by_level(level, 1, 0.0)
    pattern = F.when(message.rlike(fixed.RULE_CRITICAL), 2).when(message.rlike(fixed.RULE_ERROR), 1).otherwise(0)
    critical, error = F.col("_pattern") == 2, F.col("_pattern") == 1
    pattern_score = (
        F.when(critical, F.lit(fixed.RULE_CRITICAL_SCORE)).when(error, F.lit(fixed.RULE_ERROR_SCORE)).otherwise(F.lit(0.0))
    )
    anomaly_type = (
        F.when(critical, first_keyword_class(message, fixed.RULE_TYPES, level_type))
        .when(level_type.isin("error", "unknown") & error, F.lit("request_failure"))
        .otherwise(level_type)
    )
    features, feature_limit = F.lit(0.0), 0.0
    if "ml_features" in logs.columns:
        rate = F.coalesce(F.col("ml_features.error_rate_1h"), F.lit(0.0))
        history = F.coalesce(F.col("ml_features.anomaly_history_count"), F.lit(0))
        step = F.lit(fixed.RULE_FEATURE_SCORE)
        features = F.when(rate > fixed.RULE_ERROR_RATE_LIMIT, step).otherwise(0.0) + F.when(
            history > fixed.RULE_HISTORY_LIMIT, step
        ).otherwise(0.0)
        feature_limit = 2 * fixed.RULE_FEATURE_SCORE
    rows = logs
    if threshold is not None:
        # most rows cannot reach the threshold by their level; no pattern is tried on them
        best = level_score + F.lit(fixed.RULE_CRITICAL_SCORE + feature_limit + 1e-9)
        rows = rows.where(best >= threshold)
    # a generated column: the optimizer would copy a plain one, and its patterns, to every place of use
    rows = rows.select("*", F.inline(F.array(F.struct(pattern.alias("_pattern")))))
    if threshold is not None:
        rows = rows.where(level_score + pattern_score + features >= threshold)
    return rows.withColumns(
        {
            "severity_score": level_score,
            "pattern_score": pattern_score,
            "ml_score": features,
            "anomaly_type": anomaly_type,
            "detection_mode": F.when((level == "FATAL") | critical, "immediate").otherwise("windowed"),
        }
    ).withColumn("raw_score", F.col("severity_score") + F.col("pattern_score") + F.col("ml_score")).drop("_pattern")


def rule_score(logs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Anomaly events of rows whose score reaches the threshold.

    Rows that are dead letters or already scored are skipped.
    """
    rows = logs
    for flag in ("_dlq", "anomaly_score"):
        if flag in logs.columns:
            rows = rows.where(F.col(flag).isNull())
    scored = rule_scores(rows, p.rule_threshold)
    score = F.least(F.col("raw_score"), F.lit(1.0))
    severity = ladder(F.col("raw_score"), fixed.RULE_SEVERITY, "medium")
    span = optional(rows, "span_id")
    return scored.withColumns({"anomaly_score": score, "severity": severity}).select(
        F.md5(F.concat_ws("|", F.lit("rule"), "tenant_id", "service", "log_seq", F.unix_micros("ts").cast("string"))).alias(
            "event_id"
        ),
        "ts",
        F.col("ts").alias("detected_at"),
        "log_seq",
        "tenant_id",
        "service",
        "anomaly_type",
        "anomaly_score",
        "severity",
        F.lit("open").alias("status"),
        F.coalesce(optional(rows, "environment"), F.col("tenant_id")).alias("environment"),
        "message",
        F.format_string(
            "%s anomaly detected in %s (score=%.2f, severity=%s): %s",
            F.col("anomaly_type"), F.col("service"), F.col("anomaly_score"), F.col("severity"),
            F.substring("message", 1, 200),
        ).alias("description"),
        optional(rows, "trace_id").alias("trace_id"),
        "detection_mode",
        F.create_map(
            F.lit("severity_score"), "severity_score", F.lit("pattern_score"), "pattern_score",
            F.lit("ml_score"), "ml_score", F.lit("total"), "anomaly_score",
        ).alias("signal_weights"),
        F.when(F.coalesce(span, F.lit("")) != "", F.array(span)).otherwise(F.array().cast("array<string>")).alias("span_ids"),
        F.array("service").alias("causal_chain"),
        F.array("service").alias("affected_services"),
        F.array(
            F.struct(
                F.col("ts").alias("timestamp"), F.col("service"), F.upper("level").alias("level"),
                F.substring("message", 1, 500).alias("message"),
            )
        ).alias("evidence_logs"),
    )
