"""Overviews, facets, times to resolve, totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lanternlog.functions.numbers import round_exact
from lanternlog.functions.text import is_error
from lanternlog.operators.search import where_equal
from lanternlog.operators.sequence import exact_ranks


def overview(logs: DataFrame, anomalies: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Totals of a time range: rows, error share in percent, services, anomalies."""
    in_range = _between(logs, start, end)
    base = in_range.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.count_if(is_error(F.col("level"))).alias("errors"),
        F.countDistinct("service").alias("service_count"),
    )
    found = _between(anomalies, start, end).agg(F.count(F.lit(1)).alias("anomaly_count"))
    return _one_row(base, found).select(
        "total_logs",
        F.when(F.col("total_logs") > 0, F.col("errors") / F.col("total_logs") * 100).otherwise(0.0).alias("error_rate"),
        "service_count", "anomaly_count",
    )


def _one_row(*parts: DataFrame) -> DataFrame:
    """Columns of several one-row tables side by side."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def _between(df: DataFrame, start: Column | None, end: Column | None) -> DataFrame:
    df = df if start is None else df.where(F.col("ts") >= start)
    return df if end is None else df.where(F.col("ts") <= end)


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows per value of each column, in one pass: (facet, value, n)."""
    grouped = df.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")
    )
    # grouping id has the bit of every column that is aggregated away
    all_bits = (1 << len(names)) - 1
    facet, value = None, None
    for i, name in enumerate(names):
        hit = F.col("gid") == (all_bits ^ (1 << (len(names) - 1 - i)))
        facet = F.when(hit, name) if facet is None else facet.when(hit, name)
        value = F.when(hit, F.col(name).cast("string")) if value is None else value.when(hit, F.col(name).cast("string"))
    return grouped.select(facet.alias("facet"), value.alias("value"), "n").where(F.col("value").isNotNull())


def facets(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Top values per facet column, by count: (facet, value, n, rank).

    The largest size is a constant, by which Spark limits each facet before the shuffle.
    """
    rows = value_counts(df, list(sizes))
    size = F.coalesce(*[F.when(F.col("facet") == n, k) for n, k in sizes.items()])
    rank = F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "value"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= max(sizes.values()))
    return rows.where(F.col("rank") <= size)


def incident_facets(incidents: DataFrame) -> DataFrame:
    return facets(incidents, {"state": 10, "severity": 10, "urgency": 10, "priority": 10, "service": 20})


def log_facets(logs: DataFrame) -> DataFrame:
    return facets(logs, {"level": 10, "service": 20})


def time_to(incidents: DataFrame, now: Column | None = None, days: int = 30, service=None, severity=None) -> DataFrame:
    """Minutes to resolve, acknowledge and mitigate of resolved incidents.

    Average, upper median, p95 (from five values on, else the maximum),
    minimum, maximum and count per measure; exact over all rows.
    """
    rows = where_equal(incidents, state="resolved", service=service, severity=severity)
    if now is not None:
        rows = rows.where(F.col("resolved_at") >= F.timestamp_seconds(F.unix_seconds(now) - days * 86400))
    measures = [("mttr", "resolved_at"), ("mtta", "acknowledged_at"), ("mttm", "mitigated_at")]
    long = rows.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("metric"),
                        F.greatest(F.unix_micros(c) - F.unix_micros("created_at"), F.lit(0)).alias("us"),
                    )
                    for m, c in measures
                ]
            )
        ).alias("x"),
        *[F.col(c).isNotNull().alias(f"has_{m}") for m, c in measures],
    )
    kept = reduce(lambda a, b: a | b, [(F.col("x.metric") == m) & F.col(f"has_{m}") for m, _ in measures])
    values = long.where(kept).select("x.metric", "x.us")
    ranks = exact_ranks(
        values, ["metric"], "us",
        {
            "median": F.call_function("div", F.col("n"), F.lit(2)) + 1,
            "p95": F.when(F.col("n") >= 5, F.floor(F.col("n") * 0.95) + 1).otherwise(F.col("n")),
        },
    )
    base = values.groupBy("metric").agg(
        F.avg("us").alias("avg"), F.min("us").alias("lo"), F.max("us").alias("hi"), F.count(F.lit(1)).alias("sample_size")
    )

    def minutes(c):
        return round_exact(F.col(c) / 60e6, 1)

    return base.join(ranks.drop("n"), "metric").select(
        "metric", minutes("avg").alias("avg_minutes"), minutes("median").alias("median_minutes"),
        minutes("p95").alias("p95_minutes"), minutes("lo").alias("min_minutes"), minutes("hi").alias("max_minutes"),
        "sample_size",
    )


def mean_resolve_seconds(incidents: DataFrame) -> DataFrame:
    """Mean of the positive resolve times."""
    positive = F.col("mttr_seconds") > 0
    return incidents.agg(
        F.avg(F.when(positive, F.col("mttr_seconds"))).alias("mean_mttr_seconds"), F.count_if(positive).alias("n")
    )


def distribution(logs: DataFrame) -> DataFrame:
    """Rows by level and by service, and the number of traces: (kind, value, n)."""
    by_value = value_counts(logs, ["level", "service"]).withColumnRenamed("facet", "kind")
    traces = logs.agg(F.countDistinct("trace_id").alias("n")).select(
        F.lit("traces").alias("kind"), F.lit("distinct").alias("value"), "n"
    )
    return by_value.unionByName(traces)


def bar_shares(logs: DataFrame, n: int = 8) -> DataFrame:
    """The busiest services and their share of the busiest one."""
    top = logs.groupBy("service").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "service").limit(n)
    best = F.greatest(F.max("n").over(W.partitionBy()), F.lit(1))
    return top.select("service", "n", (F.col("n") / best).alias("share"))


def stage_totals(counters: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows per pipeline stage; a missing counter falls back to the next one.

    ``counters``: (name, value), added up; ``stored``: (table, n_rows).
    """
    def counter(name):
        return F.nullif(F.sum(F.when(F.col("name") == name, F.col("value"))), F.lit(0)).alias(name)

    names = ["received", "produced", "detected", "indexed", "index_errors"]
    c = counters.agg(*[counter(n) for n in names])
    s = stored.agg(
        F.coalesce(F.sum(F.when(F.col("table").startswith("logs"), F.col("n_rows"))), F.lit(0)).alias("logs"),
        F.coalesce(F.sum(F.when(F.col("table").startswith("anomalies"), F.col("n_rows"))), F.lit(0)).alias("anomalies"),
    )
    return _one_row(c, s).select(
        F.coalesce("received", "produced", "logs").alias("ingest"),
        F.coalesce("produced", "logs").alias("stream"),
        F.coalesce("produced", "logs").alias("process"),
        F.coalesce("index_errors", F.lit(0)).alias("process_errors"),
        F.coalesce("indexed", F.col("logs") + F.col("anomalies")).alias("index"),
        F.coalesce("detected", "anomalies").alias("detect"),
        F.coalesce("produced", "logs").alias("enrich"),
    )


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """Lag per consumer group and topic, over partitions and clusters."""
    return offsets.groupBy("group_id", "topic").agg(F.sum("lag").alias("lag"))
