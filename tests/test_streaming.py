import time

import pytest
from pyspark.sql import functions as F

from lanternlog.operators import composite as cp, incidents as inc, parse as ps, rule_score as rs
from lanternlog.params import Params
from lanternlog.sources import readers
from lanternlog.sources.logview import log_view
from lanternlog.streaming import pipelines as pl, traces as st

COLUMNS = ["ts", "log_seq", "log_id", "tenant_id", "service", "level", "message", "http_status", "trace_id", "span_id", "environment"]


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """The log view in four files, in time order."""
    base = tmp_path_factory.mktemp("parts")
    logs = log_view(spark, sf).select(*COLUMNS)
    edges = [0, 190, 500, 777, 10**9]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        logs.where((F.col("log_seq") >= a) & (F.col("log_seq") < b)).coalesce(1).write.mode("append").parquet(f"{base}/logs")
        time.sleep(1.1)  # the file source takes files in the order of their times
    return f"{base}/logs", logs


def source(spark, path, logs):
    return readers.read_table_stream(spark, path, logs.schema, files_per_batch=1)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_rule_events_batch_equals_stream(spark, parts, tmp_path):
    path, logs = parts
    out = str(tmp_path / "events")
    for _ in range(2):  # the second start finds nothing new
        pl.store_events(pl.rule_events(source(spark, path, logs)), out, str(tmp_path / "cp"), None).awaitTermination()
    got = spark.read.parquet(out)
    assert rows(got, "event_id", "anomaly_score") == rows(rs.rule_score(logs), "event_id", "anomaly_score")


def test_composite_batch_equals_stream(spark, parts, tmp_path):
    path, logs = parts
    runner = pl.CompositeStream(spark, str(tmp_path / "out"), str(tmp_path / "state"))
    pl.start(source(spark, path, logs), runner, str(tmp_path / "cp")).awaitTermination()
    columns = ("log_seq", "detection_mode", "anomaly_score", "z_score")

    def clean(df):
        return rows(df.withColumn("z_score", F.coalesce(F.round("z_score", 1), F.lit(-99.0))), *columns)

    got = spark.read.parquet(str(tmp_path / "out"))
    # the blast radius looks at errors of the same second, which one file may split
    assert clean(got) == clean(cp.composite(logs))
    assert got.select("batch").distinct().count() == 4


def test_composite_batch_can_run_again(spark, parts, tmp_path):
    _, logs = parts
    runner = pl.CompositeStream(spark, str(tmp_path / "out"), str(tmp_path / "state"))
    first, second = logs.where("log_seq < 500"), logs.where("log_seq >= 500")
    runner(first, 0)
    runner(second, 1)
    once = rows(spark.read.parquet(str(tmp_path / "out")), "event_id")
    runner(second, 1)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "event_id") == once


def test_tickets_batch_equals_stream(spark, parts, tmp_path):
    _, logs = parts
    events = rs.rule_score(logs)
    p = Params(ticket_dedup_seconds=60)
    runner = pl.TicketStream(spark, str(tmp_path / "out"), str(tmp_path / "state"), p)
    for i, (a, b) in enumerate([(0, 300), (300, 310), (310, 10**9)]):
        runner(events.where((F.col("log_seq") >= a) & (F.col("log_seq") < b)), i)
    keyed = inc.keyed_events(events, p)
    expected = inc.ticket_members(keyed, inc.ticket_windows(keyed, p), p)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got.where("rank = 1"), "tenant_id", "dedup_key", "open_sec") == rows(expected.where("rank = 1"), "tenant_id", "dedup_key", "open_sec")
    assert rows(got.groupBy("tenant_id", "dedup_key", "open_sec").count(), "tenant_id", "dedup_key", "open_sec", "count") == rows(
        expected.groupBy("tenant_id", "dedup_key", "open_sec").count(), "tenant_id", "dedup_key", "open_sec", "count"
    )


def test_parse_stream_splits_good_and_dead(spark, parts, tmp_path):
    _, logs = parts
    raw = ps.to_batches(logs, batch_rows=100)
    bad = spark.createDataFrame([("{bad",), ('{"x":1}',)], "value string")
    raw.unionByName(bad).repartition(3).write.text(str(tmp_path / "raw"))
    listener = pl.CounterListener()
    spark.streams.addListener(listener)
    stream = pl.counted(readers.read_topic_files(spark, str(tmp_path / "raw"), 1), "received", empty=F.col("value") == "")
    for _ in range(2):
        pl.parse_to_tables(stream, str(tmp_path / "logs"), str(tmp_path / "dead"), str(tmp_path / "cp")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "logs"))
    assert rows(stored, "log_id", "level", "message") == rows(logs, "log_id", "level", "message")
    assert rows(spark.read.parquet(str(tmp_path / "dead")), "reason") == [("parse_error",), ("unknown_format",)]
    deadline = time.time() + 20
    while listener.totals.get("received.rows", 0) < raw.count() + 2 and time.time() < deadline:
        time.sleep(0.2)
    assert listener.totals["received.rows"] == raw.count() + 2
    assert listener.table(spark).count() == 2
    spark.streams.removeListener(listener)


def test_enrich_reads_features_per_batch(spark, parts, tmp_path):
    path, logs = parts
    features = spark.createDataFrame([("t0", "svc-0", 0.5, 1.0, 2.0, 7)], "tenant_id string, service string, error_rate_1h double, p99_latency_1h double, request_rate_1h double, anomaly_history_count int")
    features.select("tenant_id", "service", F.struct("error_rate_1h", "p99_latency_1h", "request_rate_1h", "anomaly_history_count").alias("feat")).write.parquet(str(tmp_path / "f"))

    def sink(df, batch_id):
        df.select("log_seq", "service", "tenant_id", "ml_features.*").write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch_id}")

    pl.enrich_each(source(spark, path, logs), str(tmp_path / "f"), sink, str(tmp_path / "cp"), None).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == logs.count()
    assert got.where("_source = 'default'").count() == logs.where("not (tenant_id = 't0' and service = 'svc-0')").count()


def test_bucket_stream_and_repeats(spark, parts, tmp_path):
    path, logs = parts
    stream = pl.bucket_stream(source(spark, path, logs))
    q = stream.writeStream.format("memory").queryName("buckets").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "a")).start()
    q.awaitTermination()
    from lanternlog.operators.windows import bucket_rates

    assert rows(spark.table("buckets"), "tenant_id", "service", "bucket", "total", "errors") == rows(bucket_rates(logs), "tenant_id", "service", "bucket", "total", "errors")
    twice = source(spark, path, logs).select("ts", "log_id")
    twice = pl.without_repeats(twice.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))))
    q = twice.writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "b")).start()
    q.awaitTermination()
    assert spark.table("once").count() == logs.count()


def test_failed_traces_wait_then_correlate(spark, parts, tmp_path):
    path, logs = parts
    stored = str(tmp_path / "logs")
    logs.withColumn("dt", F.to_date("ts")).write.partitionBy("dt").parquet(stored)
    p = Params(trace_wait_seconds=1)
    due = st.failed_trace_stream(readers.read_table_stream(spark, path, logs.schema), p)
    q = st.correlate_each(due, stored, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp"), p, "1 second")
    from lanternlog.operators.trace import failed_traces

    wanted = rows(failed_traces(logs), "tenant_id", "trace_id")
    deadline, got = time.time() + 120, []
    while time.time() < deadline and got != wanted and q.isActive:
        time.sleep(2)
        try:
            got = rows(spark.read.parquet(str(tmp_path / "out")), "tenant_id", "trace_id")
        except Exception:
            got = []
    q.stop()
    assert got == wanted
