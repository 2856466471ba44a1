"""Hourly service features and their join to log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.functions.text import is_error
from lanternlog.operators.asof import asof
from lanternlog.operators.sequence import exact_ranks

KEYS = ["tenant_id", "service"]


FEATURES = ["error_rate_1h", "p99_latency_1h", "request_rate_1h", "anomaly_history_count"]


def hourly_features(logs: DataFrame, anomalies: DataFrame, seconds: int = 3600) -> DataFrame:
    """Error rate, p99 latency, request count and past anomaly count per service and hour (or other ``seconds``).

    The p99 is the exact nearest-rank value; latencies are ranked in
    thousandths of their unit, by counts and not by sorting a service's rows.
    """
    hour = F.timestamp_seconds(F.unix_seconds("ts") - F.unix_seconds("ts") % seconds).alias("hour")
    base = logs.groupBy(*KEYS, hour).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_error(F.col("level"))).alias("errors")
    )
    latency = logs.select(*KEYS, hour, F.round(F.col("latency_ms") * 1000).cast("long").alias("lat"))
    p99 = exact_ranks(latency, [*KEYS, "hour"], "lat", {"p99": F.ceil(F.col("n") * 0.99)})
    found = anomalies.groupBy(*KEYS, hour).agg(F.count(F.lit(1)).alias("found"))
    joined = base.join(p99.drop("n"), [*KEYS, "hour"], "left").join(found, [*KEYS, "hour"], "left")
    return joined.select(
        *KEYS, "hour",
        (F.col("errors") / F.col("n")).alias("error_rate_1h"),
        (F.coalesce("p99", F.lit(0)) / 1000.0).alias("p99_latency_1h"),
        F.col("n").cast("double").alias("request_rate_1h"),
        F.coalesce("found", F.lit(0)).cast("int").alias("anomaly_history_count"),
        F.timestamp_seconds(F.unix_seconds("hour") + seconds).alias("computed_at"),
    )


def latest_features(features: DataFrame) -> DataFrame:
    """The newest feature row per service."""
    row = F.struct(*FEATURES)
    return features.groupBy(*KEYS).agg(F.max_by(row, "hour").alias("feat"), F.max("computed_at").alias("computed_at"))


def with_ml_features(rows: DataFrame) -> DataFrame:
    """Turn the joined ``feat`` into ``ml_features``, with defaults where there is none."""
    missing = F.col("feat").isNull()
    return rows.withColumn(
        "ml_features",
        F.struct(
            F.coalesce("feat.error_rate_1h", F.lit(0.0)).alias("error_rate_1h"),
            F.coalesce("feat.p99_latency_1h", F.lit(0.0)).alias("p99_latency_1h"),
            F.coalesce("feat.request_rate_1h", F.lit(0.0)).alias("request_rate_1h"),
            F.coalesce("feat.anomaly_history_count", F.lit(0)).alias("anomaly_history_count"),
            F.when(missing, "default").alias("_source"),
        ),
    ).drop("feat")


def enrich(logs: DataFrame, features: DataFrame) -> DataFrame:
    """Log rows with ``ml_features``; defaults where a service has none.

    The newest features count, as a live job sees them.  The feature side has
    one row per service, so whether it is broadcast is left to its measured size.
    """
    found = latest_features(features).select(*KEYS, "feat") if "feat" not in features.columns else features.select(*KEYS, "feat")
    return with_ml_features(logs.join(found, KEYS, "left"))


def enrich_asof(logs: DataFrame, features: DataFrame, block_seconds: int = 10) -> DataFrame:
    """Log rows with the features that were computed when they came; a replay sees what the live job saw."""
    return with_ml_features(asof(logs, features, KEYS, "ts", "computed_at", FEATURES, "feat", block_seconds))


def not_enriched(rows: DataFrame) -> DataFrame:
    """Rows that have not been enriched before."""
    return rows.where(F.col("enriched_at").isNull()) if "enriched_at" in rows.columns else rows


def feature_freshness(features: DataFrame, now: Column, limit_seconds: int = 3600) -> DataFrame:
    """Age of the newest features and whether they are stale; no features are stale."""
    newest = features.agg(F.max("computed_at").alias("newest"))
    age = F.unix_seconds(now) - F.unix_seconds("newest")
    return newest.select(
        "newest", age.alias("age_seconds"), F.coalesce(age > limit_seconds, F.lit(True)).alias("stale")
    )
