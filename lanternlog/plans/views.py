"""Tables the registered queries read, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lanternlog.functions import fixed
from lanternlog.operators.incidents import priority, timeline_entry, urgency
from lanternlog.operators.rule_score import rule_score
from lanternlog.sources.logview import log_view, table


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident per rule-scored anomaly, in a state set by its number."""
    ev = rule_score(log_view(spark, sf_dir))
    step = F.col("log_seq") % 50
    stage = F.col("log_seq") % 5

    def after(times, least):
        at = F.timestamp_seconds(F.unix_seconds("ts") + step * 60 * times)
        return F.when(stage >= least, at)

    urgent = urgency(F.col("severity"))
    none = F.lit(None).cast("string")
    return ev.select(
        F.concat(F.lit("TICK-"), F.lpad(F.col("log_seq").cast("string"), 8, "0")).alias("id"),
        F.col("log_seq").alias("number"),
        "tenant_id", "service", "severity", "anomaly_type", "anomaly_score", "log_seq",
        F.lit("identified").alias("opened_as"),
        F.element_at(F.array(*[F.lit(s) for s in fixed.STATES]), (stage + 1).cast("int")).alias("state"),
        urgent.alias("urgency"),
        priority(F.col("severity"), urgent).alias("priority"),
        F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "service", F.lit(" - "), F.substring("description", 1, 120)).alias("title"),
        "description",
        F.when(stage >= 3, F.concat(F.lit("cause "), "anomaly_type")).alias("root_cause"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        after(1, 1).alias("acknowledged_at"),
        after(2, 3).alias("mitigated_at"),
        after(3, 4).alias("resolved_at"),
        F.when(stage >= 4, step * 180).alias("mttr_seconds"),
        none.alias("assigned_to"), none.alias("commander"), none.alias("impact"),
        none.alias("communication_channel"), none.alias("runbook_url"),
        F.array("service", "anomaly_type", "severity").alias("tags"),
        F.create_map(F.lit("trace"), F.col("trace_id")).alias("custom_fields"),
        F.array(
            timeline_entry(F.col("ts"), "state_change", F.lit("identified"),
                           F.concat(F.lit("Anomaly detected: "), F.substring("description", 1, 100)), F.lit("system"), F.col("event_id"))
        ).alias("timeline"),
    ).drop("opened_as")


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw message per event, in five forms: batch, record, canonical, unknown, broken."""
    logs = log_view(spark, sf_dir)
    form = F.col("log_seq") % 5
    nanos = (F.unix_micros("ts") * 1000).cast("string")

    def text(v):
        return F.struct(v.cast("string").alias("stringValue"))

    def attr(key, v):
        return F.struct(F.lit(key).alias("key"), text(v).alias("value"))

    record = F.struct(
        nanos.alias("timeUnixNano"), F.col("level").alias("severityText"), text(F.col("message")).alias("body"),
        F.array(attr("http.status_code", F.col("http_status")), attr("level", F.lit("x"))).alias("attributes"),
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"),
    )
    resource = F.struct(
        F.array(attr("service.name", F.col("service")), attr("tenant_id", F.col("tenant_id")),
                attr("deployment.environment", F.lit("prod")), attr("k8s.pod", F.col("user_id"))).alias("attributes")
    )
    scope = F.struct(F.struct(F.lit("app").alias("name")).alias("scope"), F.array(record).alias("logRecords"))
    batch = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(scope).alias("scopeLogs"))).alias("resourceLogs")))
    canonical = F.to_json(
        F.struct(
            F.col("log_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("@timestamp"), "level", "message",
            "service", "tenant_id", "trace_id", "span_id", F.col("http_status").cast("string").alias("http_status_code"),
        )
    )
    unknown = F.to_json(F.struct(F.col("user_id").alias("a")))
    broken = F.concat(F.lit("{bad "), F.repeat(F.lit("x"), F.lit(5000)))
    value = (
        F.when(form == 0, batch).when(form == 1, F.to_json(record)).when(form == 2, canonical)
        .when(form == 3, unknown).otherwise(broken)
    )
    return logs.select("log_seq", value.alias("value"))


def key_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """API keys from customers, projects from nations."""
    customers = table(spark, sf_dir, "customer")
    keys = customers.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key_prefix"),
        F.sha2(F.concat(F.lit("key-"), F.col("c_custkey").cast("string")), 256).alias("key_hash"),
        F.col("c_nationkey").cast("long").alias("project_id"),
        (F.col("c_custkey") % 7 == 0).alias("revoked"),
    )
    nations = table(spark, sf_dir, "nation")
    projects = nations.select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("tenant_id"),
        F.concat(F.lit("org"), F.col("n_regionkey").cast("string")).alias("org_id"),
    )
    return keys, projects


def key_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order; some name a key that does not exist."""
    orders = table(spark, sf_dir, "orders")
    number = F.when(F.col("o_orderkey") % 11 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    return orders.select(
        F.col("o_orderkey").alias("request_id"), F.concat(F.lit("key-"), number.cast("string")).alias("api_key")
    )


def flat_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat upload rows as field maps, some with odd levels or times."""
    logs = log_view(spark, sf_dir)
    level = F.when(F.col("log_seq") % 17 == 0, "VERBOSE").when(F.col("log_seq") % 19 == 0, "").otherwise(F.col("level"))
    stamp = F.when(F.col("log_seq") % 23 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return logs.select(
        F.create_map(
            F.lit("message"), "message", F.lit("level"), level, F.lit("service"), "service", F.lit("timestamp"), stamp
        ).alias("f")
    )


def level_variant() -> Column:
    """A raw level name per event."""
    names = ["critical", "Warning", "", "alert", "Emergency", "info", "warn", "error", "fatal", "debug", "TRACE"]
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("log_seq") % len(names) + 1).cast("int"))
