"""Every registered query: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lanternlog.functions import ids, otlp, signals, text
from lanternlog.operators import (
    composite, features, incidents, lifecycle, parse, quality, reports, rule_score, search, tenancy, trace, windows,
)
from lanternlog.params import Params
from lanternlog.plans import views
from lanternlog.session import cut_lineage, work_path
from lanternlog.sources import readers, store, writers
from lanternlog.sources.logview import log_view, spread, table
from lanternlog.streaming import late, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Event time the reports of the test view take as "now".
SPARK_EPOCH = 1704067200
# Rows a task gets where decoding a row costs much.
DECODED_ROWS = 100_000


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def epoch(name: str):
    return F.unix_seconds(name).alias("epoch")


def joined_map(m):
    return F.array_join(
        F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.3f", e["value"])))), ","
    )


# --- scorers -----------------------------------------------------------------


@query
def rule_score_by_service(spark, sf):
    """Which services raise anomalies, and how severe they are."""
    events = rule_score.rule_score(log_view(spark, sf))
    return events.groupBy("service", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.max("anomaly_score").alias("top_score")
    )


@query
def rule_score_events(spark, sf):
    events = rule_score.rule_score(log_view(spark, sf))
    return events.select(
        "log_seq", "tenant_id", "service", "anomaly_type", F.round("anomaly_score", 4).alias("anomaly_score"),
        "severity", "detection_mode", "description", "trace_id", F.array_join("span_ids", ",").alias("span_ids"),
        F.round(F.col("signal_weights")["pattern_score"], 4).alias("pattern_score"),
    )


@query
def rule_score_enriched(spark, sf):
    """Rule scores with the service features joined on."""
    logs = log_view(spark, sf)
    enriched = features.enrich(logs, features.hourly_features(logs, rule_score.rule_score(logs)))
    events = rule_score.rule_score(enriched)
    return events.groupBy("tenant_id", "service", "anomaly_type", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("anomaly_score"), 4).alias("top_score")
    )


@query
def signal_vector(spark, sf):
    rows = signals.with_signals(log_view(spark, sf)).where("is_error")
    return rows.select(
        "log_seq", joined_map(signals.signal_map(signals.signal_list())).alias("signals"),
        signals.composite_score().alias("score"), "immediate",
        signals.top_signals(signals.signal_list()).alias("top_signals"),
    )


@query
def http_stack_signals(spark, sf):
    logs = log_view(spark, sf)
    marker = F.element_at(F.array(*[F.lit(m) for m in ("\n\tat a", "\n  File b", "\ngoroutine c", "\n    at d")]), (F.col("log_seq") % 4 + 1).cast("int"))
    stack = F.repeat(marker, (F.col("log_seq") % 20).cast("int"))
    rows = logs.select(
        signals.http_signal(F.col("http_status").cast("string")).alias("h"), signals.frame_count(stack).alias("frames"),
        signals.stack_weight(stack).alias("stack_w"),
    )
    return rows.groupBy(F.col("h.name").alias("http"), F.col("h.weight").alias("http_w"), "frames", "stack_w").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def document_signals(spark, sf):
    """Patterns and categories found in the whole document texts."""
    docs = spread(table(spark, sf, "documents"), "doc_id").select("doc_id", "source", F.col("text").alias("message"), F.lit("ERROR").alias("level"))
    rows = signals.with_signals(docs)
    return rows.groupBy("source", "sig_pattern", "sig_category").agg(F.count(F.lit(1)).alias("n"))


@query
def zscore_labels(spark, sf):
    rows = windows.with_window_statistics(log_view(spark, sf)).where("z_score is not null")
    return rows.select(signals.zscore_label(F.col("z_score")).alias("l")).groupBy("l.severity", "l.confidence").agg(
        F.count(F.lit(1)).alias("n")
    )


# --- message text ------------------------------------------------------------


@query
def error_templates(spark, sf):
    t = windows.error_templates(log_view(spark, sf))
    return t.select(
        "tenant_id", "template", "template_id", "n", F.unix_seconds("first_seen").alias("first_epoch"),
        F.unix_seconds("last_seen").alias("last_epoch"),
    )


@query
def error_categories(spark, sf):
    rows = log_view(spark, sf).where(text.is_error(F.col("level")))
    return rows.groupBy("tenant_id", text.error_category(F.col("message")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query
def document_templates(spark, sf):
    """Template hash of every whole document text."""
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return docs.select("doc_id", text.template_key(text.error_template(F.col("text"))).alias("template_id"))


@query
def level_normalize(spark, sf):
    rows = log_view(spark, sf).select(views.level_variant().alias("raw"))
    return rows.groupBy("raw", text.normalize_level(F.col("raw")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


# --- parsing -----------------------------------------------------------------


@query
def otlp_roundtrip(spark, sf):
    """Logs encoded to batches and parsed back."""
    logs = log_view(spark, sf)
    raw = parse.to_batches(logs, attributes={"http.status_code": F.col("http_status"), "seq": F.col("log_seq")})
    rows = parse.good_rows(parse.parsed_rows(raw))
    return rows.select(
        F.col("attrs")["seq"].cast("long").alias("log_seq"), epoch("ts"), "log_id", "level", "message", "service",
        "tenant_id", "environment", "trace_id", "span_id", F.col("attrs")["http_status_code"].alias("http_status"),
    )


@query
def dlq_route(spark, sf):
    """Raw messages of five forms, by where they go."""
    rows = parse.parsed_rows(views.raw_messages(spark, sf))
    return rows.groupBy(
        F.when(F.col("_dlq"), "dlq").otherwise("log").alias("target"), F.coalesce("reason", F.lit("")).alias("reason")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("original", "message"))).alias("chars"))


@query
def parsed_messages(spark, sf):
    """Canonical rows of raw batches, single records and canonical messages."""
    rows = parse.good_rows(parse.parsed_rows(views.raw_messages(spark, sf)))
    return rows.select(
        "log_id", epoch("ts"), "level", "message", "service", "tenant_id", "environment", "scope_name", "trace_id",
        F.array_join(F.array_sort(F.map_keys("attrs")), ",").alias("attr_names"),
        F.col("attrs")["http_status_code"].alias("http_status"),
    )


@query
def attr_flatten(spark, sf):
    """Attribute lists with all value kinds, flattened; core names stay untouched."""
    logs = log_view(spark, sf, DECODED_ROWS)
    n = F.col("user_id").cast("string")
    body = F.concat(
        F.lit('[{"key":"http.route","value":{"stringValue":"/u/'), n, F.lit('"}},{"key":"retry.count","value":{"intValue":'), n,
        F.lit('}},{"key":"ok","value":{"boolValue":true}},{"key":"level","value":{"stringValue":"x"}},'
              '{"key":"ids","value":{"arrayValue":{"values":[{"intValue":1},{"stringValue":"b"}]}}},'
              '{"key":"kv","value":{"kvlistValue":{"values":[{"key":"a\\"b","value":{"boolValue":false}}]}}},'
              '{"key":"http.route","value":{"stringValue":"/last"}},{"key":"retry_count","value":{"intValue":7}}]'),
    )
    logs = logs.select("log_seq", F.from_json(body, otlp.ATTRIBUTES).alias("attributes"))
    attrs = F.col("attributes")
    logs = logs.select("log_seq", "attributes", otlp.attribute_map(attrs).alias("m"))
    flat = F.map_filter(otlp.flat_names(F.col("m")), lambda k, v: ~k.isin(parse.CORE_NAMES))
    res = otlp.flat_names(F.col("m"), "resource_")
    merged = parse.merge_attributes(flat, res)
    line = F.array_join(
        F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";"
    )
    return logs.select("log_seq", line.alias("attrs"), otlp.attribute(attrs, "retry.count").alias("retries"))


@query
def attr_nesting(spark, sf):
    """Attribute values nested 2 to 24 levels deep, decoded."""
    depth = (F.col("log_seq") % 12 + 1).cast("int")
    inner = F.concat(F.lit('{"intValue":"'), F.col("log_seq").cast("string"), F.lit('"}'))
    opening = F.repeat(F.lit('{"arrayValue":{"values":[{"kvlistValue":{"values":[{"key":"k","value":'), depth)
    value = F.concat(opening, inner, F.repeat(F.lit("}]}},{}]}}"), depth))
    listed = F.concat(F.lit('[{"key":"nested","value":'), value, F.lit("}]"))
    rows = log_view(spark, sf, DECODED_ROWS).select("log_seq", otlp.attribute_map(F.from_json(listed, otlp.ATTRIBUTES))["nested"].alias("value"))
    return rows


@query
def tenant_inject(spark, sf):
    """Caller-set tenants replaced by the verified one; tenant fields stripped from requests."""
    logs = log_view(spark, sf)
    body = F.concat(F.lit('[{"key":"tenant_id","value":{"stringValue":"spoof"}},{"key":"service.name","value":{"stringValue":"'),
                    F.col("service"), F.lit('"}}]'))
    injected = tenancy.inject_tenant(F.from_json(body, otlp.ATTRIBUTES), F.col("tenant_id"))
    fields = tenancy.strip_tenant(
        F.create_map(F.lit("tenant_id"), F.lit("spoof"), F.lit("tenantId"), F.lit("spoof"), F.lit("q"), F.col("service"))
    )
    asked = F.when(F.col("log_seq") % 3 == 0, F.lit(None)).otherwise(F.col("tenant_id"))
    return logs.select(
        F.size(injected).alias("n_attrs"), otlp.attribute(injected, "tenant_id").alias("injected"),
        F.array_join(F.map_keys(fields), ",").alias("fields"), tenancy.default_tenant(asked).alias("defaulted"),
    ).groupBy("n_attrs", "injected", "fields", "defaulted").agg(F.count(F.lit(1)).alias("n"))


@query
def trace_headers(spark, sf):
    """Trace and span ids of W3C headers."""
    logs = log_view(spark, sf)
    header = F.when(F.col("log_seq") % 4 == 3, "00-short-01").otherwise(
        F.concat(F.lit("00-"), "trace_id", F.lit("-"), "span_id", F.lit("-01"))
    )
    got = ids.traceparent(header)
    return logs.select("log_seq", got["trace_id"].alias("trace_id"), got["span_id"].alias("span_id"))


# --- windows -----------------------------------------------------------------


@query
def bucket_rates(spark, sf):
    return windows.bucket_rates(log_view(spark, sf)).select(
        "tenant_id", "service", "bucket", "total", "errors", F.round(F.col("errors") / F.col("total"), 6).alias("rate")
    )


@query
def zscore_rows(spark, sf):
    rows = windows.with_window_statistics(log_view(spark, sf))
    return rows.where("buckets >= 3").select(
        "log_seq", F.col("buckets").cast("long").alias("buckets"), F.round("current_rate", 6).alias("current_rate"),
        F.round("mean_rate", 6).alias("mean_rate"), F.round("std_rate", 6).alias("std_rate"),
        F.round("z_score", 5).alias("z_score"),
    )


@query
def velocity(spark, sf):
    rows = windows.with_window_statistics(log_view(spark, sf)).where(text.is_error(F.col("level")))
    w = windows.velocity_weight(F.col("run_errors"), F.col("window_errors"), F.col("window_n"))
    return rows.select("log_seq", F.col("run_errors").cast("long").alias("run_errors"), w.alias("velocity_w"))


@query
def recurrence(spark, sf):
    errors = log_view(spark, sf).where(text.is_error(F.col("level")))
    errors = errors.withColumn("template_id", text.template_key(text.error_template(F.col("message"))))
    return windows.recurrence(errors)


@query
def erroring_services(spark, sf):
    s = windows.erroring_services(log_view(spark, sf))
    return s.select("tenant_id", "sec", "services", windows.blast_weight(F.col("services")).alias("blast_w"))


@query
def late_repair(spark, sf):
    """Bucket scores after the repair of what late rows touch.

    Every 13th row arrives six blocks of 100 seconds after its own; rows older
    than their block's watermark are late.
    """
    logs = log_view(spark, sf)
    late_ = _is_late()
    counts, side = windows.bucket_rates(logs.where(~late_)), windows.bucket_rates(logs.where(late_))
    scores = windows.bucket_scores(counts).withColumn("version", F.lit(0))
    scores = scores.unionByName(late.corrections(counts, side).withColumn("version", F.lit(1)))
    return late.newest(scores).select(
        "tenant_id", "service", "bucket", "total", "errors", F.col("buckets").cast("long").alias("buckets"),
        F.round("mean_rate", 6).alias("mean_rate"), F.round("std_rate", 6).alias("std_rate"), F.round("z_score", 5).alias("z_score"),
    )


def _watermark_ms():
    arrival = F.expr("log_seq div 400") + F.when(F.col("log_seq") % 13 == 0, 6).otherwise(0)
    return (F.lit(SPARK_EPOCH - 121) + 100 * arrival) * 1000


def _is_late():
    return F.unix_millis("ts") < _watermark_ms()


@query
def late_counts(spark, sf):
    logs = log_view(spark, sf).withColumn("watermark_ms", _watermark_ms())
    return late.late_counts(logs.where(F.unix_millis("ts") < F.col("watermark_ms")))


# --- composite scorer --------------------------------------------------------


def _event_columns(events):
    return events.select(
        "log_seq", "tenant_id", "service", "severity", "anomaly_score", "detection_mode", "error_category",
        "error_template", (F.col("z_score") + 0.0).alias("z_score"), "error_rate", joined_map(F.col("signal_weights")).alias("signals"),
        "window_buckets",
    )


@query
def immediate_events(spark, sf):
    return _event_columns(composite.immediate(log_view(spark, sf)))


@query
def windowed_events(spark, sf):
    return _event_columns(composite.windowed(log_view(spark, sf)))


@query
def anomaly_union(spark, sf):
    """Events of all detectors by type, mode and severity."""
    logs = log_view(spark, sf)
    events = composite.union_events(rule_score.rule_score(logs), composite.composite(logs), trace.request_failures(logs))
    return events.groupBy("anomaly_type", "detection_mode", "severity").agg(F.count(F.lit(1)).alias("n"))


# --- features ----------------------------------------------------------------


@query
def hourly_features(spark, sf):
    logs = log_view(spark, sf)
    f = features.hourly_features(logs, rule_score.rule_score(logs))
    return f.select(
        "tenant_id", "service", F.unix_seconds("hour").alias("hour_epoch"), F.round("error_rate_1h", 6).alias("error_rate_1h"),
        "p99_latency_1h", "request_rate_1h", F.col("anomaly_history_count").cast("long").alias("anomaly_history_count"),
    )


@query
def feature_enrich(spark, sf):
    """Rows by the features they got; a service without features gets defaults."""
    logs = log_view(spark, sf)
    f = features.hourly_features(logs, rule_score.rule_score(logs)).where("service <> 'svc-3'")
    rows = features.enrich(logs, f)
    return rows.groupBy(
        "tenant_id", "service", F.round("ml_features.error_rate_1h", 6).alias("error_rate_1h"),
        F.col("ml_features.p99_latency_1h").alias("p99_latency_1h"), F.col("ml_features._source").alias("source"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def feature_asof(spark, sf):
    """Rows with the five-minute features that were computed by their own time."""
    logs = log_view(spark, sf)
    f = features.hourly_features(logs, rule_score.rule_score(logs), seconds=300)
    rows = features.enrich_asof(logs.select("log_seq", "ts", "tenant_id", "service"), f)
    return rows.select(
        "log_seq", F.round("ml_features.error_rate_1h", 6).alias("error_rate"), F.col("ml_features.request_rate_1h").alias("request_rate"),
        F.col("ml_features.anomaly_history_count").cast("long").alias("anomalies"), F.col("ml_features._source").alias("source"),
    )


@query
def feature_freshness(spark, sf):
    logs = log_view(spark, sf)
    f = features.hourly_features(logs, rule_score.rule_score(logs))
    now = F.timestamp_seconds(F.lit(SPARK_EPOCH + 40 * 3600))
    return features.feature_freshness(f, now).select(F.unix_seconds("newest").alias("newest_epoch"), "age_seconds", "stale")


# --- traces ------------------------------------------------------------------


@query
def trace_timeline(spark, sf):
    t = trace.timelines(log_view(spark, sf))
    line = F.array_join(
        F.transform("request_trace", lambda r: F.concat_ws(" ", r["service"], r["level"], r["log_seq"].cast("string"))), "|"
    )
    return t.select("tenant_id", "trace_id", F.size("request_trace").alias("n_rows"), line.alias("steps"),
                    F.md5(trace.trace_text(F.col("request_trace"))).alias("text_hash"))


@query
def trace_steps(spark, sf):
    s = trace.trace_steps(trace.trace_rows(log_view(spark, sf)))
    return s.select("tenant_id", "trace_id", "log_seq", F.col("seq").cast("long").alias("seq"), "gap_ms", "offset_ms")


@query
def request_flow(spark, sf):
    logs = log_view(spark, sf)
    t = trace.flows(logs).join(trace.timelines(logs), trace.KEYS)
    return t.select(
        "tenant_id", "trace_id", F.array_join("request_flow", ">").alias("flow"),
        F.array_join("error_flow", ">").alias("error_flow"), F.array_join("span_ids", ",").alias("span_ids"),
    )


@query
def dependency_edges(spark, sf):
    return trace.dependency_edges(trace.flows(log_view(spark, sf)))


@query
def causal_root(spark, sf):
    t = trace.flows(log_view(spark, sf))
    return t.select(
        "tenant_id", "trace_id", "root_cause_service", "root_cause_span_id", F.array_join("causal_chain", ">").alias("chain"),
        F.col("causal_category").alias("category"),
    )


def _long_traces(spark, sf):
    """The log view with traces of about a thousand rows per tenant."""
    trace_id = F.md5(F.concat(F.lit("long"), F.expr("log_seq div 2000").cast("string")))
    return log_view(spark, sf).withColumn("trace_id", trace_id)


@query
def long_trace_roots(spark, sf):
    """Root cause and flow of long traces, with how much of them an event shows."""
    e = trace.request_failures(_long_traces(spark, sf))
    return e.select(
        "tenant_id", "trace_id", "root_cause_service", "root_cause_span_id", F.array_join("causal_chain", ">").alias("chain"),
        F.array_join("request_flow", ">").alias("flow"), "error_category", F.size("request_trace").cast("long").alias("shown"),
        "trace_rows", "trace_cut", F.unix_seconds("ts").alias("epoch"), "log_seq",
    )


@query
def long_trace_steps(spark, sf):
    s = trace.trace_steps(trace.trace_rows(_long_traces(spark, sf)))
    return s.select("tenant_id", "trace_id", "log_seq", F.col("seq").cast("long").alias("seq"), "gap_ms", "offset_ms")


@query
def long_trace_edges(spark, sf):
    return trace.dependency_edges(trace.flows(_long_traces(spark, sf)))


@query
def error_fingerprints(spark, sf):
    f = trace.error_fingerprints(log_view(spark, sf))
    return f.select("tenant_id", "trace_id", "trigger_level", "error_template", "error_category")


@query
def blast_radius(spark, sf):
    t = trace.flows(log_view(spark, sf))
    b = trace.blast_radius(trace.dependency_edges(t), t.select("tenant_id", F.col("root_cause_service").alias("root")))
    return b.select(
        "tenant_id", "root", F.array_join("affected_downstream", ",").alias("affected"),
        F.round("impact_score", 2).alias("impact_score"), "estimated_user_impact",
    )


@query
def request_failures(spark, sf):
    e = trace.request_failures(log_view(spark, sf))
    return e.select(
        "tenant_id", "trace_id", "severity", "service", "description", "anomaly_score", "error_message",
        "error_category", F.array_join("causal_chain", ">").alias("chain"),
        F.array_join("affected_services", ">").alias("affected"), F.col("blast_radius.estimated_user_impact").alias("impact"),
    )


# --- incidents ---------------------------------------------------------------


@query
def ticket_windows(spark, sf):
    """Tickets of rule-scored events: openings, group sizes and drops per key."""
    t = incidents.open_tickets(rule_score.rule_score(log_view(spark, sf)))
    return t.select(
        "tenant_id", "dedup_key", "open_sec", "n_events", F.col("grouped").cast("long").alias("grouped"),
        F.col("dropped").cast("long").alias("dropped"), "log_seq",
    )


@query
def incident_numbers(spark, sf):
    """Ticket numbers in opening order, continuing after 100."""
    t = incidents.open_tickets(rule_score.rule_score(log_view(spark, sf)), start_number=100)
    return t.select("id", F.col("number").cast("long").alias("number"), "log_seq")


@query
def incidents_open(spark, sf):
    """Stored incidents of the rule-scored events, with their evidence rows."""
    logs = log_view(spark, sf)
    tickets = incidents.open_tickets(rule_score.rule_score(logs))
    built = incidents.build_incidents(tickets, incidents.evidence_arrays(incidents.evidence_logs(tickets, logs)))
    return built.select(
        "id", "number", "tenant_id", "service", "severity", "urgency", "priority", "state", "title", "anomaly_type",
        F.array_join("tags", ",").alias("tags"), F.col("similar_count").cast("long").alias("similar_count"),
        F.size("evidence_logs").alias("n_evidence"), F.size("timeline").alias("n_timeline"),
        F.unix_seconds("created_at").alias("created_epoch"), F.unix_seconds("updated_at").alias("updated_epoch"),
    )


@query
def parse_to_incidents(spark, sf):
    """From raw messages to tickets: parse, score by all detectors, correlate, deduplicate."""
    attributes = {"http.status_code": F.col("http_status"), "latency_ms": F.col("latency_ms")}
    raw = parse.to_batches(log_view(spark, sf), 1, attributes, offsets=True)
    rows = cut_lineage(parse.scoring_columns(parse.good_rows(parse.parsed_rows(raw))), "parsed")
    events = composite.union_events(rule_score.rule_score(rows), composite.composite(rows), trace.request_failures(rows))
    tickets = incidents.open_tickets(cut_lineage(events, "events"))
    return tickets.select(
        "tenant_id", "dedup_key", "open_sec", "n_events", F.col("similar_count").cast("long").alias("similar_count"),
        F.col("dropped").cast("long").alias("dropped"),
    )


@query
def parsed_features(spark, sf):
    """Hourly features of parsed rows."""
    attributes = {"http.status_code": F.col("http_status"), "latency_ms": F.col("latency_ms")}
    rows = parse.scoring_columns(parse.good_rows(parse.parsed_rows(parse.to_batches(log_view(spark, sf), 1000, attributes))))
    rows = cut_lineage(rows, "parsed")
    f = features.hourly_features(rows, rule_score.rule_score(rows))
    return f.select(
        "tenant_id", "service", F.unix_seconds("hour").alias("hour_epoch"), F.round("error_rate_1h", 6).alias("error_rate_1h"),
        "p99_latency_1h", "request_rate_1h", F.col("anomaly_history_count").cast("long").alias("anomaly_history_count"),
    )


@query
def failure_incidents(spark, sf):
    """Incidents of failed requests: kept traces and steps to reproduce."""
    tickets = incidents.open_tickets(trace.request_failures(log_view(spark, sf)))
    built = incidents.build_incidents(tickets)
    return built.select(
        "id", "tenant_id", "service", "priority", "title", F.array_join("tags", ",").alias("tags"), "error_type",
        F.size("request_traces").alias("n_traces"), F.array_join("reproduce_steps", "|").alias("steps"),
        F.col("similar_count").cast("long").alias("similar_count"), F.size("evidence_logs").alias("n_evidence"),
    )


@query
def incident_evidence(spark, sf):
    """The fifty newest problem rows of the service of every incident."""
    logs = log_view(spark, sf)
    asked = views.incidents(spark, sf).select("id", "tenant_id", "service", "log_seq")
    e = incidents.evidence_logs(asked, logs)
    return e.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.min("log_seq").alias("oldest"), F.max("log_seq").alias("newest"),
        F.sum("log_seq").alias("seq_sum"),
    )


@query
def similar_resolved(spark, sf):
    inc = views.incidents(spark, sf)
    asked = inc.select(F.col("id").alias("ask_id"), "tenant_id", "service", F.col("description").alias("text"))
    s = incidents.similar_resolved(asked, inc)
    return s.select("ask_id", "similar_id", F.col("rank").cast("long").alias("rank"))


@query
def recent_duplicates(spark, sf):
    """Failed traces that repeat an unresolved incident of their service."""
    logs = log_view(spark, sf)
    rows = logs.where(text.is_error(F.col("level"))).select(
        "tenant_id", "service", "ts", F.col("log_seq").cast("string").alias("event_id"),
        text.error_template(F.col("message")).alias("text"),
    )
    d = incidents.recent_duplicates(rows, views.incidents(spark, sf))
    return d.select(F.col("event_id").cast("long").alias("log_seq"), "incident_id", F.unix_seconds("created_at").alias("created_epoch"))


@query
def routing(spark, sf):
    inc = views.incidents(spark, sf)
    names = ["pagerduty", "jira", "servicenow", "opsgenie", "slack", "email"]
    regions = table(spark, sf, "region")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("r_regionkey").cast("int") + 1)
    platforms = regions.select(name.alias("platform"), (F.col("r_regionkey") != 2).alias("enabled"))
    p = Params(routing={"critical": ["pagerduty", "slack", "servicenow"], "high": ["jira"], "medium": [], "low": []})
    return incidents.route(inc, platforms, p).groupBy("severity", "platform").agg(F.count(F.lit(1)).alias("n"))


@query
def priority_matrix(spark, sf):
    inc = views.incidents(spark, sf)
    return inc.groupBy("severity", "urgency", "priority").agg(F.count(F.lit(1)).alias("n"))


@query
def incident_context(spark, sf):
    """Rows and errors of the service ten minutes around every incident."""
    inc = views.incidents(spark, sf).select("id", "tenant_id", "service", "created_at")
    c = incidents.incident_context(inc, log_view(spark, sf))
    return c.select("id", "n_logs", "n_errors", F.unix_seconds("first_error_at").alias("first_epoch"), "first_error_message")


@query
def correlated_traces(spark, sf):
    """Number of failed traces within ten minutes around every incident."""
    inc = views.incidents(spark, sf).select("id", "tenant_id", "service", "created_at")
    return incidents.correlated_trace_counts(inc, log_view(spark, sf))


@query
def burst_incidents(spark, sf):
    b = incidents.burst_incidents(rule_score.rule_score(log_view(spark, sf)))
    return b.select("tenant_id", "service", F.unix_seconds("window_start").alias("window_epoch"), "n_anomalies",
                    "n_services", F.round("top_score", 4).alias("top_score"), "severity")


@query
def fingerprints(spark, sf):
    """Dedup keys of failed requests."""
    e = trace.request_failures(log_view(spark, sf))
    return e.groupBy("tenant_id", incidents.dedup_key(e).alias("dedup_key")).agg(F.count(F.lit(1)).alias("n"))


# --- lifecycle ---------------------------------------------------------------


def _requests(inc):
    """Two requested actions for two of three incidents."""
    step = F.when(F.col("number") % 2 == 0, F.array(F.lit("acknowledge"), F.lit("resolve"))).otherwise(
        F.array(F.lit("investigate"), F.lit("mitigate"))
    )
    return inc.where("number % 3 <> 0").select(
        "id", F.posexplode(step).alias("pos", "action"), F.col("created_at").alias("c"), F.col("number").alias("k")
    ).select("id", "action", F.timestamp_seconds(F.unix_seconds("c") + 100 + F.col("pos") * 60 + F.col("k") % 7).alias("at"),
             F.lit("ops").alias("actor"))


@query
def transitions(spark, sf):
    inc = views.incidents(spark, sf)
    out = lifecycle.apply_transitions(inc, _requests(inc))
    return out.select(
        "id", "state", *[F.unix_seconds(c).alias(c) for c in ("acknowledged_at", "mitigated_at", "resolved_at", "updated_at")],
        "mttr_seconds", F.size("timeline").alias("n_timeline"), F.element_at("timeline", -1)["message"].alias("last_message"),
    )


@query
def batch_transitions(spark, sf):
    """Bulk requests over many ids: known, unknown and invalid, sixty a batch."""
    inc = views.incidents(spark, sf)
    logs = log_view(spark, sf).select(
        F.floor(F.col("log_seq") / 60).alias("batch_id"), (F.col("log_seq") % 60).alias("pos"),
        F.concat(F.lit("TICK-"), F.lpad(F.col("log_seq").cast("string"), 8, "0")).alias("id"),
        F.when(F.col("log_seq") % 9 == 0, "explode").otherwise("acknowledge").alias("action"),
    )
    r = lifecycle.batch_results(inc, logs)
    return r.groupBy("ok", "result").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last_pos"))


@query
def batch_apply(spark, sf):
    """Batches of requests applied: results, new states and audit rows."""
    inc = views.incidents(spark, sf)
    requests = _requests(inc).withColumn("batch_id", F.substring("id", 1, 11)).withColumn("pos", F.unix_seconds("at"))
    results, after, audit = lifecycle.batch_apply(inc, requests)
    states = after.where("changed").select(F.lit("state").alias("kind"), "id", F.col("state").alias("detail"), F.size("timeline").cast("long").alias("n"))
    steps = audit.select(
        F.lit("audit").alias("kind"), F.col("incident_id").alias("id"),
        F.concat(F.col("details")["from"], F.lit(">"), F.col("details")["to"], F.lit(" by "), "actor").alias("detail"), F.lit(1).cast("long").alias("n"),
    )
    told = results.groupBy(F.lit("result").alias("kind"), F.lit("").alias("id"), F.col("result").alias("detail")).agg(F.count(F.lit(1)).alias("n"))
    return states.unionByName(steps).unionByName(told)


def _patches(inc):
    return inc.where("number % 4 = 1").select(
        "id", F.timestamp_seconds(F.unix_seconds("created_at") + 500).alias("at"), F.lit("ops").alias("actor"),
        F.create_map(F.lit("urgency"), F.lit("low"), F.lit("assigned_to"), F.concat(F.lit("u"), F.col("number").cast("string"))).alias("fields"),
        F.array(F.lit("patched"), F.col("service")).alias("tags"),
        F.create_map(F.lit("note"), F.lit("n")).alias("custom_fields"),
    )


@query
def patch(spark, sf):
    inc = views.incidents(spark, sf)
    out = lifecycle.patch_incidents(inc, _patches(inc))
    return out.select(
        "id", "urgency", "priority", "assigned_to", F.array_join("tags", ",").alias("tags"),
        F.array_join(F.array_sort(F.map_keys("custom_fields")), ",").alias("custom_names"),
        F.size("timeline").alias("n_timeline"), F.unix_seconds("updated_at").alias("updated_epoch"),
        F.element_at("timeline", -1)["message"].alias("last_message"),
    )


@query
def patch_audit(spark, sf):
    inc = views.incidents(spark, sf)
    a = lifecycle.patch_audit(inc, _patches(inc))
    d = F.col("details")
    return a.select("incident_id", "action", "actor", d["field"].alias("field"), d["from"].alias("old"), d["to"].alias("new"))


@query
def timeline_notes(spark, sf):
    """Timelines, one row per entry, after notes were added."""
    inc = views.incidents(spark, sf)
    notes = inc.select("id", F.timestamp_seconds(F.unix_seconds("created_at") + 60).alias("at"),
                       F.concat(F.lit("note on "), "service").alias("message"), F.lit("ops").alias("actor"))
    rows = lifecycle.timeline_rows(lifecycle.add_notes(inc, notes))
    return rows.select("incident_id", F.col("pos").cast("long").alias("pos"), F.unix_seconds("timestamp").alias("at_epoch"),
                       "type", "state", "message", "actor")


@query
def audit_latest(spark, sf):
    """The three newest audit entries per service."""
    logs = log_view(spark, sf)
    audit = logs.select(F.concat_ws("/", "tenant_id", "service").alias("incident_id"), F.col("ts").alias("at"),
                        F.col("log_seq").alias("seq"), F.col("event_type").alias("action"))
    a = lifecycle.latest_audit(audit, 3)
    return a.select("incident_id", "seq", "action", F.col("rank").cast("long").alias("rank"))


@query
def retention_purge(spark, sf):
    """Incidents kept and expired when the retention ends in the middle of the data."""
    inc = views.incidents(spark, sf)
    now = F.timestamp_seconds(F.lit(SPARK_EPOCH + 97 * 86400 + 600))
    kept = lifecycle.purge_incidents(inc, now).groupBy(F.lit("kept").alias("what"), "service").agg(F.count(F.lit(1)).alias("n"))
    gone = lifecycle.expired_incidents(inc, now).groupBy(F.lit("expired").alias("what"), "service").agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(gone)


# --- search ------------------------------------------------------------------


@query
def search_logs(spark, sf):
    """Newest rows of one tenant and service with a word of the query, in a time range."""
    r = search.search_logs(
        log_view(spark, sf), tenant="t0", service="svc-1", level=["ERROR", "FATAL"], query="timeout deadlock handler",
        start=F.timestamp_seconds(F.lit(SPARK_EPOCH)), end=F.timestamp_seconds(F.lit(SPARK_EPOCH + 86400)), limit=100,
        fields=["ts", "log_seq", "service", "level", "message"],
    )
    return r.select("log_seq", epoch("ts"), "service", "level", "message")


@query
def search_fulltext(spark, sf):
    """Documents with any word of a query, over whole texts."""
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return search.full_text(docs, "license error password", ["text", "source"]).select("doc_id", "source", "n_chars")


@query
def search_60pct(spark, sf):
    """Documents with at least sixty percent of the query's words."""
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return search.share_text(docs, "the data and with error", ["text"]).select("doc_id", "lang")


@query
def search_anomalies(spark, sf):
    r = search.search_anomalies(
        rule_score.rule_score(log_view(spark, sf)), tenant="t1", severity="critical", limit=100,
        fields=["log_seq", "ts", "service", "severity", "anomaly_score", "anomaly_type"],
    )
    # the tie of equal times is broken by the event id, which the SQL recomputes
    return r.select("log_seq", epoch("ts"), "service", "severity", F.round("anomaly_score", 4).alias("anomaly_score"), "anomaly_type")


@query
def page_incidents(spark, sf):
    """Second page of the unresolved incidents of one tenant, by score."""
    r = search.search_incidents(
        views.incidents(spark, sf), tenant="t0", severity=["critical", "high"], not_states=["resolved", "mitigated"],
        query="memory timeout", sort="number", ascending=True, offset=20, limit=20,
    )
    return r.select("id", "number", "state", "severity", "title")


@query
def incident_get(spark, sf):
    """The first incident of tenant t1, by its id."""
    inc = views.incidents(spark, sf)
    first = inc.where("tenant_id = 't1'").agg(F.min("id")).head()[0]
    return search.get_incident(inc, first, "t1").select("id", "tenant_id", "service", "state", "severity", "title")


@query
def page_totals(spark, sf):
    m = search.match_incidents(views.incidents(spark, sf), tenant="t0", state="resolved")
    return search.page_info(m, 40, 20)


@query
def latest_logs(spark, sf):
    return search.newest(log_view(spark, sf), 100, "log_seq").select("log_seq", epoch("ts"), "service", "level", "message")


@query
def latest_errors(spark, sf):
    return search.newest_errors(log_view(spark, sf), 50).select("log_seq", epoch("ts"), "service", "level", "message")


# --- reports -----------------------------------------------------------------


@query
def overview_24h(spark, sf):
    logs = log_view(spark, sf)
    o = reports.overview(logs, rule_score.rule_score(logs), F.timestamp_seconds(F.lit(SPARK_EPOCH)),
                         F.timestamp_seconds(F.lit(SPARK_EPOCH + 86400)))
    return o.withColumn("error_rate", F.round("error_rate", 6))


@query
def log_facets(spark, sf):
    return reports.log_facets(log_view(spark, sf)).select("facet", "value", "n", F.col("rank").cast("long").alias("rank"))


@query
def incident_facets(spark, sf):
    return reports.incident_facets(views.incidents(spark, sf)).select("facet", "value", "n", F.col("rank").cast("long").alias("rank"))


@query
def mttr(spark, sf):
    """Times to resolve, acknowledge and mitigate over resolved incidents."""
    return reports.time_to(views.incidents(spark, sf), F.timestamp_seconds(F.lit(SPARK_EPOCH + 86400)))


@query
def mttr_by_service(spark, sf):
    inc = views.incidents(spark, sf)
    return reports.time_to(inc, F.timestamp_seconds(F.lit(SPARK_EPOCH + 86400)), service="svc-1", severity="high")


@query
def mean_mttr(spark, sf):
    return reports.mean_resolve_seconds(views.incidents(spark, sf)).withColumn("mean_mttr_seconds", F.round("mean_mttr_seconds", 4))


@query
def distribution(spark, sf):
    return reports.distribution(log_view(spark, sf))


@query
def bar_shares(spark, sf):
    return reports.bar_shares(log_view(spark, sf)).withColumn("share", F.round("share", 6))


@query
def stage_totals(spark, sf):
    """Stage counters with one of them missing, and stored rows by table."""
    logs = log_view(spark, sf)
    counters = logs.groupBy("event_type").agg(F.count(F.lit(1)).alias("value")).select(
        F.element_at(
            F.create_map(F.lit("error"), F.lit("received"), F.lit("click"), F.lit("produced"), F.lit("view"), F.lit("indexed")),
            F.col("event_type"),
        ).alias("name"), "value",
    )
    stored = logs.groupBy(F.when(text.is_error(F.col("level")), "anomalies-").otherwise("logs-").alias("table")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return reports.stage_totals(counters, stored)


@query
def lag_sum(spark, sf):
    """Consumer lag from offsets, one row per event and partition."""
    logs = log_view(spark, sf)
    offsets = logs.select(
        F.col("event_type").alias("group_id"), F.concat(F.lit("topic-"), (F.col("user_id") % 3).cast("string")).alias("topic"),
        (F.col("log_seq") % 13).alias("lag"),
    )
    return reports.consumer_lag(offsets)


@query
def tenant_quota(spark, sf):
    q = tenancy.tenant_quota(log_view(spark, sf), quota=120)
    return q.select("tenant_id", F.unix_seconds("minute").alias("minute_epoch"), "requests", "over_quota")


@query
def api_key_resolve(spark, sf):
    keys, projects = views.key_tables(spark, sf)
    r = tenancy.resolve_keys(views.key_requests(spark, sf), keys, projects)
    return r.select("request_id", "key_prefix", "project_id", "tenant_id", "org_id")


@query
def api_key_reject(spark, sf):
    keys, projects = views.key_tables(spark, sf)
    return tenancy.rejected_requests(views.key_requests(spark, sf), keys, projects).select("request_id", "api_key")


# --- quality -----------------------------------------------------------------


@query
def validate_logs(spark, sf):
    return quality.validate_logs(views.flat_fields(spark, sf))


@query
def flat_upload(spark, sf):
    """Flat upload rows normalised to canonical rows; those with an unreadable time are counted apart."""
    rows = parse.flat_rows(views.flat_fields(spark, sf)).withColumn("epoch", F.when(~F.col("bad_time"), F.unix_seconds("ts")))
    return rows.groupBy("service", "level", "tenant_id", "bad_time").agg(
        F.count(F.lit(1)).alias("n"), F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch")
    )


@query
def schema_check(spark, sf):
    """Contract rules over logs with bad levels and empty services."""
    logs = log_view(spark, sf)
    bad = logs.withColumns({
        "level": F.when(F.col("log_seq") % 17 == 0, "VERBOSE").otherwise(F.col("level")),
        "service": F.when(F.col("log_seq") % 29 == 0, "").otherwise(F.col("service")),
        "anomaly_score": F.when(F.col("log_seq") % 31 == 0, 1.5),
    }).select("ts", "log_id", "level", "message", "service", "tenant_id", "anomaly_score")
    return quality.contract_report(bad, quality.LOG_CONTRACT)


@query
def incident_check(spark, sf):
    """Contract rules over stored incidents, some broken, with a field the contract does not know."""
    inc = views.incidents(spark, sf).select(
        "id", "created_at", F.when(F.col("number") % 7 != 0, F.col("title")).alias("title"), "severity", "urgency", "service", "tenant_id",
        F.when(F.col("number") % 5 == 0, "P9").otherwise(F.col("priority")).alias("priority"),
        F.when(F.col("number") % 3 == 0, "done").otherwise(F.col("state")).alias("state"), "anomaly_score", "number",
    )
    return quality.contract_report(inc, quality.INCIDENT_CONTRACT)


@query
def schema_rejects(spark, sf):
    """Anomaly events that break their contract, with the broken rules."""
    ev = rule_score.rule_score(log_view(spark, sf)).withColumn(
        "severity", F.when(F.col("log_seq") % 5 == 0, "severe").otherwise(F.col("severity"))
    ).withColumn("anomaly_score", F.when(F.col("log_seq") % 7 == 0, 2.0).otherwise(F.col("anomaly_score")))
    r = quality.contract_rejects(ev, quality.ANOMALY_CONTRACT)
    return r.groupBy(F.array_join("broken_rules", ",").alias("broken")).agg(F.count(F.lit(1)).alias("n"))


# --- sources and sinks -------------------------------------------------------


@query
def export_json(spark, sf):
    """Incidents as JSON lines, read back."""
    inc = views.incidents(spark, sf).select("id", "title", "severity", "state", "created_at", "tags", "custom_fields")
    lines = writers.export_json(inc)
    read = F.from_json("line", inc.schema)
    return lines.select("id", read["title"].alias("title"), read["state"].alias("state"), F.unix_seconds(read["created_at"]).alias("created_epoch"),
                        F.array_join(read["tags"], ",").alias("tags"), read["custom_fields"]["trace"].alias("trace"))


@query
def upload_encode(spark, sf):
    """Flat uploads encoded to batches and parsed: other fields become attributes, the host has a name."""
    logs = log_view(spark, sf)
    f = F.create_map(
        F.lit("message"), "message", F.lit("level"), F.lower("level"), F.lit("service"), "service", F.lit("timestamp"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("trace_id"), "trace_id", F.lit("host"), F.concat(F.lit("h"), "service"),
        F.lit("seq"), F.col("log_seq").cast("string"), F.lit("region"), "tenant_id",
    )
    rows = parse.good_rows(parse.parsed_rows(parse.fields_to_batches(logs.select(f.alias("f")))))
    return rows.select(
        F.col("attrs")["seq"].cast("long").alias("log_seq"), epoch("ts"), "level", "message", "service", "trace_id",
        F.col("host_name").alias("host"), F.col("attrs")["region"].alias("region"),
    )


@query
def export_csv(spark, sf):
    """Incident export lines in three forms."""
    inc = views.incidents(spark, sf)
    short = writers.export_lines(inc).select(F.lit("short").alias("form"), "id", "line")
    long = writers.export_lines(inc, writers.LONG_EXPORT).select(F.lit("long").alias("form"), "id", "line")
    table_ = writers.export_markdown(inc).select(F.lit("markdown").alias("form"), "id", "line")
    return short.unionByName(long).unionByName(table_)


@query
def archive_roundtrip(spark, sf):
    """Messages archived by topic, day and hour, read back for one range and parsed."""
    logs = log_view(spark, sf)
    raw = parse.to_batches(logs, attributes={"seq": F.col("log_seq")})
    stamp = F.get_json_object("value", "$.resourceLogs[0].scopeLogs[0].logRecords[0].timeUnixNano").cast("bigint")
    messages = raw.withColumn("timestamp", F.timestamp_seconds(F.floor(stamp / 1e9)))
    path = work_path(spark, "archive")
    writers.write_archive(writers.archive_rows(messages, "raw-logs"), path)
    back = readers.read_archive(spark, path, "raw-logs", F.timestamp_seconds(F.lit(SPARK_EPOCH)))
    rows = parse.good_rows(parse.parsed_rows(back))
    return rows.groupBy("tenant_id", "service", "level").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("attrs")["seq"].cast("bigint")).alias("seq_sum")
    )


@query
def file_formats(spark, sf):
    """Flat rows written as CSV, line JSON and text, read back by their format."""
    logs = log_view(spark, sf)
    flat = logs.select("message", "level", "service", writers.iso(F.col("ts")).alias("timestamp"))
    base = work_path(spark, "files")
    flat.write.option("header", True).option("escape", '"').csv(f"{base}/rows.csv")
    flat.write.json(f"{base}/rows.ndjson")
    flat.select("message").write.text(f"{base}/rows.txt")
    out = None
    for name in ("rows.csv", "rows.ndjson", "rows.txt"):
        kind = readers.file_format(spark, f"{base}/{name}")
        rows = parse.flat_rows(readers.read_log_files(spark, f"{base}/{name}", kind))
        counted = rows.groupBy(F.lit(kind).alias("format"), "level", "service").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.length("message")).alias("chars")
        )
        out = counted if out is None else out.unionByName(counted)
    return out


@query
def typed_rejects(spark, sf):
    """Rows for a typed sink, some poisoned: what is stored, and what is rejected why."""
    logs = log_view(spark, sf)
    rows = logs.select(
        F.when(F.col("log_seq") % 101 != 3, F.col("log_id")).alias("log_id"),
        F.when(F.col("log_seq") % 97 == 5, "yesterday").otherwise(F.col("ts").cast("string")).alias("ts"), "level", "message",
        F.when(F.col("log_seq") % 89 == 7, "5xx").otherwise(F.col("http_status").cast("string")).alias("http_status"),
    )
    good, bad = sinks.split(rows, sinks.LOG_TYPES, sinks.LOG_REQUIRED)
    stored = good.groupBy(F.lit("stored").alias("result")).agg(F.count(F.lit(1)).alias("n"), F.sum("http_status").alias("sum"))
    told = bad.groupBy(F.array_join("reasons", ", ").alias("result")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("sum"))
    return stored.unionByName(told)


@query
def compact_table(spark, sf):
    """A daily table of many small files, packed: its rows by day, and whether each day has no more files than it needs."""
    path = work_path(spark, "compact-table")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("log_seq") % 3).cast("int"))
    logs = log_view(spark, sf).select("log_seq", "service", "message", day.alias("dt"))
    logs.repartition(6, "log_seq").write.partitionBy("dt").parquet(path)
    store.compact_days(spark, path, "log_seq")
    left = store.scattered_days(store.file_sizes(spark, path), store.TARGET_BYTES).select("dt", F.lit(True).alias("scattered"))
    rows = spark.read.parquet(path).groupBy("dt").agg(F.count(F.lit(1)).alias("n"), F.sum("log_seq").alias("seq_sum"), F.sum(F.length("message")).alias("chars"))
    return rows.join(left, "dt", "left").select(
        F.date_format("dt", "yyyy-MM-dd").alias("day"), "n", "seq_sum", "chars", F.col("scattered").isNull().alias("packed")
    )


@query
def json_array_upload(spark, sf):
    """JSON arrays of 1,000 logs, every 50th broken, written and read back in ranges: rows and rejects."""
    logs = log_view(spark, sf).select("log_seq", "level", "service", "message")
    element = F.when(F.col("log_seq") % 50 == 7, F.concat(F.lit('{"message": nope '), "service", F.lit("}"))).otherwise(
        F.to_json(F.struct("level", "service", F.concat("message", F.lit(' } ] "{ \\')).alias("message")))
    )
    arrays = logs.groupBy(F.expr("log_seq div 1000").alias("part")).agg(F.sort_array(F.collect_list(F.struct("log_seq", element.alias("e")))).alias("rows"))
    path = work_path(spark, "json-arrays")
    arrays.select(F.concat(F.lit("["), F.array_join("rows.e", ","), F.lit("]")).alias("value"), "part").write.partitionBy("part").text(path)
    read = readers.parsed_elements(readers.json_elements(spark, path))
    return read.groupBy(
        F.coalesce("reason", F.lit("read")).alias("result"), F.coalesce(F.col("f")["level"], F.lit("-")).alias("level"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length(F.col("f")["message"]), F.length("original"))).alias("chars"))


@query
def daily_upsert(spark, sf):
    """Logs stored twice by day; the second time adds nothing."""
    logs = log_view(spark, sf).select("ts", "log_id", "tenant_id", "service", "level", "message", "trace_id", "span_id")
    path = work_path(spark, "logs")
    writers.upsert_daily(writers.with_log_key(logs.where("level <> 'INFO'")), path)
    writers.upsert_daily(writers.with_log_key(logs), path)
    stored = readers.read_dated(spark, path, F.timestamp_seconds(F.lit(SPARK_EPOCH)))
    name = ids.dated_name("logs", F.col("ts"))
    return stored.groupBy(name.alias("table_name"), "level").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("_key").alias("n_keys")
    )


@query
def anomaly_store(spark, sf):
    """Anomaly events with their storage keys; the fallback key where the id is missing."""
    ev = rule_score.rule_score(log_view(spark, sf))
    ev = ev.withColumn("event_id", F.when(F.col("log_seq") % 2 == 0, F.col("event_id")).otherwise(F.lit("")))
    keyed = writers.with_anomaly_key(ev)
    return keyed.select("log_seq", F.col("_key").alias("store_key"), F.col("dt").cast("string").alias("day"))
