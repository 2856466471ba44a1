"""Composite scorer: immediate events, then windowed events.

An immediate event is a row with a pattern of a dying process.  Within one
tenant, service and pattern only the first row per suppression window is
emitted; rows it suppresses are scored again with the window statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.functions.numbers import round_exact
from lanternlog.functions.signals import (
    composite_score,
    composite_severity,
    optional,
    signal_list,
    signal_map,
    top_signals,
    with_signals,
)
from lanternlog.functions.text import error_category, error_template, is_error, template_key
from lanternlog.operators.sequence import greedy_windows
from lanternlog.operators.windows import (
    blast_weight,
    erroring_services,
    piece_context,
    recurrence,
    velocity_weight,
    with_bucket_count,
    with_window_statistics,
)
from lanternlog.params import DEFAULTS, Params
from lanternlog.session import cut_lineage

SUPPRESS_KEYS = ["tenant_id", "service", "pattern"]


def immediate_rows(logs: DataFrame, p: Params = DEFAULTS, history: DataFrame | None = None) -> DataFrame:
    """Rows emitted at once: (log_seq, tenant_id, service, pattern, sec).

    Candidates are reduced to the first row per key and second before the
    suppression windows are laid.  ``history`` holds the last emission of
    each key (tenant_id, service, pattern, sec) of earlier runs.  The few
    emitted rows are written out, because several later steps read them.
    """
    rows = with_signals(logs.select(*_needed(logs))).where("immediate")
    first = (
        rows.select("tenant_id", "service", F.col("sig_pattern").alias("pattern"), F.unix_seconds("ts").alias("sec"), "ts", "log_seq")
        .groupBy(*SUPPRESS_KEYS, "sec")
        .agg(F.min(F.struct("ts", "log_seq"))["log_seq"].alias("log_seq"))
    )
    first = cut_lineage(first, "candidates")
    marks = first.select(*SUPPRESS_KEYS, "sec")
    if history is not None:
        marks = marks.unionByName(history.select(*SUPPRESS_KEYS, "sec"))
    openings = greedy_windows(marks, SUPPRESS_KEYS, p.immediate_dedup_seconds).where("sec = open_sec")
    if history is not None:
        openings = openings.join(history.select(*SUPPRESS_KEYS, "sec"), [*SUPPRESS_KEYS, "sec"], "left_anti")
    return cut_lineage(first.join(openings.select(*SUPPRESS_KEYS, "sec"), [*SUPPRESS_KEYS, "sec"]), "emitted")


def _needed(logs: DataFrame) -> list[str]:
    wanted = [
        "tenant_id", "service", "ts", "log_seq", "level", "message", "http_status",
        "exception_type", "exception_message", "exception_stacktrace", "endpoint", "trace_id",
    ]
    return [c for c in wanted if c in logs.columns]


def immediate(logs: DataFrame, p: Params = DEFAULTS, emitted: DataFrame | None = None) -> DataFrame:
    """Events of the rows emitted at once."""
    emitted = immediate_rows(logs, p) if emitted is None else emitted
    rows = with_signals(logs.select(*_needed(logs))).where("immediate")
    rows = rows.join(emitted.select("log_seq"), "log_seq", "left_semi")
    score = composite_score(floor=p.immediate_floor)
    return anomaly_event(
        rows.withColumns(
            {
                "score": score,
                "detection_mode": F.lit("immediate"),
                "z_score": F.lit(None).cast("double"),
                "current_rate": F.lit(0.0),
                "mean_rate": F.lit(0.0),
                "std_rate": F.lit(0.0),
                "buckets": F.lit(None).cast("long"),
                "signals": signal_list(),
            }
        )
    )


def statistical_signals() -> dict[str, Column]:
    """Windowed rate signals; exactly one of them can be present."""
    flat = F.col("std_rate") == 0
    return {
        "zscore:sustained_failure": F.when(
            flat & (F.col("mean_rate") >= 0.5), F.least(F.col("mean_rate") * 2.0, F.lit(1.0))
        ),
        "zscore:elevated_baseline": F.when(
            flat & (F.col("mean_rate") < 0.5) & (F.col("mean_rate") >= 0.1), F.col("mean_rate")
        ),
        "zscore:spike": F.when(F.col("spike"), F.least(F.col("z_score") / 5.0, F.lit(1.0))),
    }


def windowed_scores(
    logs: DataFrame,
    p: Params = DEFAULTS,
    emitted: DataFrame | None = None,
    bucket_history: DataFrame | None = None,
    error_history: DataFrame | None = None,
    template_history: DataFrame | None = None,
) -> DataFrame:
    """All rows with enough buckets, their windowed signals and their score.

    The counts per piece of a bucket are written out once; the rows are then
    shuffled once by piece, and the error rows once more, without the other
    columns, to find new templates.
    """
    emitted = immediate_rows(logs, p) if emitted is None else emitted
    base = logs.select(*_needed(logs))
    context = cut_lineage(piece_context(base, p, bucket_history), "context")
    done = emitted.select("log_seq")
    rows = (
        with_window_statistics(base, p, context=context)
        .join(done, "log_seq", "left_anti")
        .where(F.col("buckets") >= p.min_buckets)
        .withColumn("sec", F.unix_seconds("ts"))
    )
    rows = with_signals(rows)
    services = erroring_services(base, p, error_history)
    errors = base.where(is_error(F.col("level"))).select("tenant_id", "service", "ts", "log_seq", "message")
    errors = with_bucket_count(errors, context, p).where(F.col("buckets") >= p.min_buckets)
    novel = recurrence(
        errors.join(done, "log_seq", "left_anti").withColumn("template_id", template_key(error_template(F.col("message")))),
        template_history,
    )
    rows = rows.join(services, ["tenant_id", "sec"], "left").join(novel, "log_seq", "left")
    rows = rows.withColumns(
        {
            "spike": F.coalesce(F.col("z_score") >= p.zscore_threshold, F.lit(False)),
            "blast_w": F.when(F.col("is_error"), blast_weight(F.col("services"))),
            "velocity_w": F.when(
                F.col("is_error"),
                velocity_weight(F.col("run_errors"), F.col("window_errors"), F.col("window_n")),
            ),
        }
    )
    statistical = F.coalesce(*statistical_signals().values())
    context = F.greatest("blast_w", "velocity_w", "recurrence_w")
    return rows.withColumn("score", composite_score(statistical, context, p.immediate_floor))


def windowed(logs: DataFrame, p: Params = DEFAULTS, scores: DataFrame | None = None, **kwargs) -> DataFrame:
    """Events of the rows whose composite score reaches the threshold."""
    scores = windowed_scores(logs, p, **kwargs) if scores is None else scores
    extra = {
        **statistical_signals(),
        "context:blast_radius": F.col("blast_w"),
        "context:velocity": F.col("velocity_w"),
        "context:recurrence": F.col("recurrence_w"),
    }
    rows = scores.where(F.col("score") >= p.composite_threshold)
    return anomaly_event(rows.withColumns({"detection_mode": F.lit("windowed"), "signals": signal_list(extra)}))


def composite(logs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Immediate and windowed events together."""
    emitted = immediate_rows(logs, p)
    return immediate(logs, p, emitted).unionByName(windowed(logs, p, emitted=emitted))


def anomaly_event(rows: DataFrame) -> DataFrame:
    """Event fields of scored rows; the text differs with and without a z-score."""
    rows = rows.withColumns(
        {
            "severity": composite_severity(F.col("score")),
            "signal_summary": top_signals(F.col("signals")),
            "has_z": F.col("z_score").isNotNull(),
        }
    )
    spike_text = F.format_string(
        "Error rate spike detected for service '%s': z-score=%.2f, current_rate=%.3f, mean_rate=%.3f, std=%.3f",
        "service", "z_score", "current_rate", "mean_rate", "std_rate",
    )
    signal_text = F.format_string(
        "Incident signal detected for service '%s': score=%.2f, severity=%s, mode=%s, signals=[%s]",
        "service", "score", "severity", "detection_mode", "signal_summary",
    )
    spike_message = F.format_string("Error rate spike: z=%.2f rate=%.3f for %s", "z_score", "current_rate", "service")
    signal_message = F.format_string("Anomaly detected: score=%.2f [%s] for %s", "score", "signal_summary", "service")
    return rows.select(
        F.md5(
            F.concat_ws("|", "detection_mode", "tenant_id", "service", "log_seq", F.unix_micros("ts").cast("string"))
        ).alias("event_id"),
        "ts",
        F.col("ts").alias("detected_at"),
        "log_seq",
        "tenant_id",
        F.lit("error_rate_spike").alias("anomaly_type"),
        "severity",
        "service",
        F.when(F.col("has_z"), spike_message).otherwise(signal_message).alias("message"),
        F.when(F.col("has_z"), spike_text).otherwise(signal_text).alias("description"),
        round_exact(F.col("score"), 2).alias("anomaly_score"),
        F.coalesce(optional(rows, "endpoint"), F.lit("")).alias("affected_endpoint"),
        F.array("service").alias("affected_services"),
        F.lit("open").alias("status"),
        F.col("tenant_id").alias("environment"),
        round_exact(F.col("z_score"), 2).alias("z_score"),
        round_exact(F.col("current_rate"), 4).alias("error_rate"),
        "detection_mode",
        signal_map(F.col("signals")).alias("signal_weights"),
        error_template(F.col("message")).alias("error_template"),
        error_category(F.col("message")).alias("error_category"),
        F.col("buckets").cast("long").alias("window_buckets"),
        optional(rows, "trace_id").alias("trace_id"),
    )


def union_events(*streams: DataFrame) -> DataFrame:
    """Events of several detectors as one table; missing fields are null."""
    out = streams[0]
    for other in streams[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
