"""Trace correlation: timeline, service flow, root cause, blast radius.

All rows of a trace count, however long it is.  A trace is folded in two
steps: rows to one entry per service with its first row, first error and
counts (combined where the rows are read, so a long trace reaches the shuffle
as a few entries), then the services of a trace to its flow and root.  Only
the list of rows that is shown with a trace is shortened, and says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lanternlog.functions import fixed
from lanternlog.functions.numbers import round_exact
from lanternlog.functions.text import error_category, error_template, is_error
from lanternlog.params import DEFAULTS, Params
from lanternlog.session import cut_lineage

KEYS = ["tenant_id", "trace_id"]
ROW = ["ts", "log_seq", "service", "level", "message", "span_id"]
PIECE_SECONDS = 60
SALTS = 16


def traced(logs: DataFrame) -> DataFrame:
    return logs.where(F.coalesce(F.col("trace_id"), F.lit("")) != "")


def failed_traces(logs: DataFrame) -> DataFrame:
    """Traces with an error row, and the first such row as the trigger."""
    rows = traced(logs).where(is_error(F.col("level")))
    first = F.min_by(F.struct(*ROW), F.struct("ts", "log_seq"))
    return rows.groupBy(*KEYS).agg(first.alias("trigger"))


def trace_rows(logs: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """All rows of the failed traces.

    The traces are few columns wide; where they are not small enough to be
    broadcast, the join is salted, so a long trace is not one task.
    """
    failed = traced(logs).where(is_error(F.col("level"))).select(*KEYS).distinct() if failed is None else failed.select(*KEYS)
    salted = failed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = traced(logs).select(*KEYS, *ROW).withColumn("salt", F.pmod("log_seq", F.lit(SALTS)).cast("int"))
    return rows.join(salted, [*KEYS, "salt"], "left_semi").drop("salt")


def trace_steps(rows: DataFrame) -> DataFrame:
    """Rows of a trace in order, with the time since the trace's previous row.

    A trace is cut into minutes; what lies before a minute is found from one
    row per minute, so no task holds a long trace.
    """
    cut = rows.withColumn("piece", F.floor(F.unix_seconds("ts") / PIECE_SECONDS))
    place = [*KEYS, "piece"]
    pieces = cut.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("from"), F.max("ts").alias("to"))
    earlier = W.partitionBy(*KEYS).orderBy("piece")
    pieces = pieces.select(
        *place,
        (F.sum("n").over(earlier) - F.col("n")).alias("before"),
        F.lag("to").over(earlier).alias("last"),
        F.first("from").over(earlier).alias("begin"),
    )
    inside = W.partitionBy(*place).orderBy("ts", "log_seq")
    previous = F.coalesce(F.lag("ts").over(inside), F.col("last"))
    return cut.join(pieces, place).withColumns(
        {
            "seq": F.col("before") + F.row_number().over(inside),
            "gap_ms": (F.unix_micros("ts") - F.unix_micros(previous)) / 1000.0,
            "offset_ms": (F.unix_micros("ts") - F.unix_micros("begin")) / 1000.0,
        }
    ).drop("piece", "before", "last", "begin")


def timelines(logs: DataFrame, p: Params = DEFAULTS, failed: DataFrame | None = None) -> DataFrame:
    """One row per failed trace with its first ``trace_row_cap`` log rows in order, and their spans."""
    order = W.partitionBy(*KEYS).orderBy("ts", "log_seq")
    first = trace_rows(logs, failed).withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= p.trace_row_cap)
    shown = first.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(*ROW))).alias("request_trace"))
    spans = F.filter(F.transform("request_trace", lambda r: r["span_id"]), lambda s: F.coalesce(s, F.lit("")) != "")
    return shown.withColumn("span_ids", F.array_sort(F.array_distinct(spans)))


def service_entries(logs: DataFrame) -> DataFrame:
    """Per trace and service: first row, first error row, counts and last row."""
    place = F.struct("ts", "log_seq")
    erring = is_error(F.col("level"))
    rows = traced(logs).select(*KEYS, *ROW).withColumn("service", F.coalesce("service", F.lit("unknown")))
    return rows.groupBy(*KEYS, "service").agg(
        F.min(place).alias("first"),
        F.max(place).alias("last"),
        F.min_by(F.struct("span_id", "message"), F.when(erring, place)).alias("error"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(erring).alias("n_errors"),
    )


def flows(logs: DataFrame) -> DataFrame:
    """Failed traces: services by first appearance, those that erred, and the root cause.

    The root cause is the erring service that appears last in the flow; the
    chain runs from it back through the erring services before it.
    """
    services = service_entries(logs).groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("first", "service", "n_errors", "error"))).alias("services"),
        F.max("last").alias("last"),
        F.min("first.ts").alias("first_ts"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_errors").alias("n_errors"),
    )
    erred = F.filter("services", lambda s: s["n_errors"] > 0)
    root = F.element_at("erred", -1)
    return services.where("n_errors > 0").withColumn("erred", erred).select(
        *KEYS, "first_ts", F.col("last.ts").alias("last_ts"), F.col("last.log_seq").alias("last_seq"), "n_rows", "n_errors",
        F.col("services.service").alias("request_flow"),
        F.col("erred.service").alias("error_flow"),
        F.reverse("erred.service").alias("causal_chain"),
        root["service"].alias("root_cause_service"),
        F.coalesce(root["error"]["span_id"], F.lit("")).alias("root_cause_span_id"),
        error_category(root["error"]["message"]).alias("causal_category"),
    )


def dependency_edges(traces: DataFrame) -> DataFrame:
    """Caller and callee pairs of adjacent services in a flow, with counts."""
    n = F.size("request_flow")
    pairs = F.arrays_zip(
        F.slice("request_flow", F.lit(1), n - 1).alias("caller"), F.slice("request_flow", F.lit(2), n - 1).alias("callee")
    )
    return (
        traces.where(n > 1)
        .select("tenant_id", F.inline(pairs).alias("caller", "callee"))
        .groupBy("tenant_id", "caller", "callee")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge_edges(*parts: DataFrame) -> DataFrame:
    """Dependency counts of several runs added up."""
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other.select(*rows.columns))
    return rows.groupBy("tenant_id", "caller", "callee").agg(F.sum("n").alias("n"))


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Services reachable from each root along caller -> callee, root excluded.

    Breadth first: each round joins only the services found in the round
    before.  A round is written once, so a lost executor repeats one round,
    and what was found is read from the rounds.
    """
    hops = cut_lineage(edges.select("tenant_id", F.col("caller").alias("svc"), F.col("callee").alias("next")).distinct())
    found = frontier = cut_lineage(roots.select("tenant_id", "root", F.col("root").alias("svc")).distinct())
    while True:
        step = frontier.join(hops, ["tenant_id", "svc"]).select("tenant_id", "root", F.col("next").alias("svc")).distinct()
        frontier = cut_lineage(step.join(found, ["tenant_id", "root", "svc"], "left_anti"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found.where(F.col("svc") != F.col("root"))


def blast_radius(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Services affected by a failure of each root: those it reaches and its direct callers."""
    reached = reach(edges, roots)
    callers = roots.select("tenant_id", "root").distinct().join(
        edges.select("tenant_id", F.col("callee").alias("root"), F.col("caller").alias("svc")), ["tenant_id", "root"]
    )
    callers = callers.where(F.col("svc") != F.col("root"))
    affected = (
        reached.unionByName(callers)
        .groupBy("tenant_id", "root")
        .agg(F.array_sort(F.collect_set("svc")).alias("affected_downstream"))
    )
    totals = (
        edges.select("tenant_id", F.explode(F.array("caller", "callee")).alias("svc"))
        .distinct()
        .groupBy("tenant_id")
        .agg(F.count(F.lit(1)).alias("total_services"))
    )
    n = F.size("affected_downstream")
    return (
        roots.select("tenant_id", "root")
        .distinct()
        .join(affected, ["tenant_id", "root"], "left")
        .join(totals, "tenant_id", "left")
        .withColumn("affected_downstream", F.coalesce("affected_downstream", F.array().cast("array<string>")))
        .select(
            "tenant_id", "root", "affected_downstream",
            round_exact(n / F.greatest(F.coalesce("total_services", F.lit(0)), F.lit(1)), 2).alias("impact_score"),
            F.when(n > 3, "high").when(n > 1, "medium").otherwise("low").alias("estimated_user_impact"),
        )
    )


def error_fingerprints(logs: DataFrame) -> DataFrame:
    """Template and category of the error row that made a trace fail."""
    return failed_traces(logs).select(
        *KEYS,
        F.col("trigger.level").alias("trigger_level"),
        F.col("trigger.message").alias("trigger_message"),
        error_template(F.col("trigger.message")).alias("error_template"),
        error_category(F.col("trigger.message")).alias("error_category"),
    )


def request_failures(logs: DataFrame, p: Params = DEFAULTS, known_edges: DataFrame | None = None) -> DataFrame:
    """One event per failed trace with flow, root cause and blast radius.

    ``request_trace`` shows the first rows; ``trace_rows`` is their true
    number and ``trace_cut`` tells whether some are not shown.
    ``known_edges`` adds service dependencies found in earlier runs.
    """
    traces = cut_lineage(flows(logs), "traces")
    edges = dependency_edges(traces)
    if known_edges is not None:
        edges = merge_edges(edges, known_edges)
    blast = blast_radius(edges, traces.select("tenant_id", F.col("root_cause_service").alias("root")))
    blast = blast.withColumnRenamed("root", "root_cause_service")
    joined = traces.join(timelines(logs, p, traces), KEYS).join(error_fingerprints(logs), KEYS).join(blast, ["tenant_id", "root_cause_service"], "left")
    level = F.upper("trigger_level")

    def by_level(position):
        out = None
        for row in fixed.FAILURE_LEVELS:
            out = F.when(level == row[0], F.lit(row[position])) if out is None else out.when(level == row[0], F.lit(row[position]))
        return out.otherwise(F.lit(fixed.FAILURE_DEFAULT[position - 1]))

    category = F.when(F.col("causal_category") != "unknown", F.col("causal_category")).otherwise(F.col("error_category"))
    cascade = F.when(F.size("causal_chain") > 0, F.array_join("causal_chain", " -> ")).otherwise(F.col("root_cause_service"))
    return (
        joined.withColumn("error_category", category)
        .select(
            F.md5(F.concat_ws("|", F.lit("request_failure"), *KEYS)).alias("event_id"),
            F.col("last_ts").alias("ts"),
            F.col("last_seq").alias("log_seq"),
            "tenant_id",
            F.lit("request_failure").alias("anomaly_type"),
            by_level(1).alias("severity"),
            F.col("root_cause_service").alias("service"),
            F.concat(
                F.lit("Request failure in "), "root_cause_service", F.lit(" ("), "error_category",
                F.lit(") causing cascade: "), cascade,
            ).alias("description"),
            by_level(2).alias("anomaly_score"),
            "trace_id", "span_ids",
            F.col("request_flow").alias("affected_services"),
            "request_flow", "request_trace",
            F.col("n_rows").alias("trace_rows"),
            (F.col("n_rows") > F.size("request_trace")).alias("trace_cut"),
            F.col("error_template").alias("error_message"),
            F.substring("trigger_message", 1, 500).alias("raw_error_message"),
            F.col("trigger_message").alias("whole_error_message"),
            "causal_chain", "root_cause_service", "root_cause_span_id", "error_category",
            F.struct("impact_score", "affected_downstream", "estimated_user_impact").alias("blast_radius"),
            F.lit("").alias("root_cause"),
            F.lit("open").alias("status"),
            F.col("tenant_id").alias("environment"),
        )
    )


def trace_text(request_trace: Column) -> Column:
    """A trace as text, one line per row."""
    return F.array_join(
        F.transform(
            request_trace,
            lambda r: F.concat(
                F.lit("  ["), F.date_format(r["ts"], "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] ["), r["service"],
                F.lit("] ["), r["level"], F.lit("] "), r["message"], F.lit(" (span:"),
                F.coalesce(r["span_id"], F.lit("")), F.lit(")"),
            ),
        ),
        "\n",
    )
