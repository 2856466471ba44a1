"""Rows that cannot be stored, bounded batches, and the size of keyed state."""

import json
import time

from pyspark.sql import functions as F

from lanternlog.params import Params
from lanternlog.sources import readers
from lanternlog.sources.logview import log_view
from lanternlog.streaming import pipelines as pl, sinks, windows as wn


def poisoned(spark, n, bad):
    rows = [(f"id{i}", "2024-01-01 00:00:00" if i != bad else "noon", "INFO", f"m{i}", str(i)) for i in range(n)]
    return spark.createDataFrame(rows, "log_id string, ts string, level string, message string, http_status string")


def test_one_poisoned_row(spark, tmp_path):
    """999 rows are stored, one is rejected whole with its reason, and a restart adds nothing."""
    poisoned(spark, 1000, 417).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = readers.read_table_stream(spark, f"{tmp_path}/in", poisoned(spark, 1, 5).schema)
    for checkpoint in ("cp", "cp", "other"):  # the last one reads all again
        sinks.store_typed(source, f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/{checkpoint}", None).awaitTermination()
        stored = spark.read.parquet(f"{tmp_path}/out")
        assert stored.count() == stored.select("log_id").distinct().count() == 999
        bad = spark.read.parquet(f"{tmp_path}/bad").collect()
        assert [r.reasons for r in bad] == [["ts: not a timestamp"]]
        assert json.loads(bad[0].original)["log_id"] == "id417"
    assert stored.schema["http_status"].dataType.typeName() == "integer"


def test_reasons(spark):
    rows = spark.createDataFrame([(None, None, "x"), ("a", "2024-01-01", "7"), ("b", "?", None)], "log_id string, ts string, http_status string")
    good, bad = sinks.split(rows, sinks.LOG_TYPES, sinks.LOG_REQUIRED)
    assert [r.log_id for r in good.collect()] == ["a"] and set(sinks.LOG_TYPES) <= set(good.columns)
    assert sorted(r.reasons for r in bad.collect()) == [["http_status: not a int", "log_id: missing", "ts: missing"], ["ts: not a timestamp"]]
    empty = spark.createDataFrame([], rows.schema)
    assert [df.count() for df in sinks.split(empty, sinks.LOG_TYPES, sinks.LOG_REQUIRED)] == [0, 0]


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    rows = poisoned(spark, 400, -1)
    for i in range(4):
        rows.where(F.col("http_status").cast("int") % 4 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = readers.read_table_stream(spark, f"{tmp_path}/in", rows.schema, bytes_per_batch=1)
    query = sinks.store_typed(source, f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/cp", None)
    query.awaitTermination()
    assert [p.numInputRows for p in query.recentProgress if p.numInputRows] == [100] * 4
    options = readers.kafka_options("t", "s", min_records=500, max_delay="5s", max_records=1000)
    assert (options["minOffsetsPerTrigger"], options["maxTriggerDelay"], options["maxOffsetsPerTrigger"]) == ("500", "5s", "1000")


def test_state_size_is_kept(spark, sf, tmp_path):
    """Rows of state per micro-batch and the store that holds them, as the queries set it themselves."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    logs = log_view(spark, sf)
    for low, high in ((0, 500), (500, 10**9)):
        logs.where((F.col("log_seq") >= low) & (F.col("log_seq") < high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    listener = pl.StateListener()
    spark.streams.addListener(listener)
    source = readers.read_table_stream(spark, f"{tmp_path}/in", logs.schema, files_per_batch=1)
    changes = wn.emission_changes(source, Params(immediate_dedup_seconds=20), "1 hour", 50)
    wn.store_changes(changes, f"{tmp_path}/out", f"{tmp_path}/cp", name="emissions").awaitTermination()
    deadline = time.time() + 20
    while len(listener.rows) < 4 and time.time() < deadline:
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    rows = listener.table(spark).where("query = 'emissions'").collect()
    sizes = {(r.batch_id, r.operator.split(":")[1]): r for r in rows}
    windows = [sizes[b, o].rows for b, o in sorted(sizes) if o.startswith("transformWithState")]
    assert len(windows) >= 2 and 0 < windows[0] < windows[1]
    assert {r.provider for r in rows} == {"rocksdb"}
    assert all(r.memory_bytes > 0 and r.late == 0 for r in rows)
