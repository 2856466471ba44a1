"""Failed traces of a stream: wait, then correlate.

The first error of a trace starts a wait, so that the trace's other rows can
arrive.  After it the trace is handed on once and is not taken up again for
a while.  The state per trace is one small row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lanternlog.functions.text import is_error
from lanternlog.operators.trace import dependency_edges, flows, merge_edges, request_failures
from lanternlog.params import DEFAULTS, Params
from lanternlog.sources.readers import read_dated
from lanternlog.streaming.pipelines import start
from lanternlog.streaming.state import StateTables, write_batch

TRIGGER = StructType(
    [
        StructField("tenant_id", StringType()),
        StructField("trace_id", StringType()),
        StructField("level", StringType()),
        StructField("message", StringType()),
        StructField("first_us", LongType()),
    ]
)


class WaitForTrace(StatefulProcessor):
    """Emits each failed trace once, ``wait_ms`` after its first error arrived."""

    def __init__(self, wait_ms: int, forget_ms: int):
        self.wait_ms = wait_ms
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = "level string, message string, first_us bigint"
        self.waiting = handle.getValueState("waiting", fields)
        self.done = handle.getValueState("done", "at bigint", ttlDurationMs=self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            row = part.loc[part["first_us"].idxmin()]
            if best is None or row["first_us"] < best["first_us"]:
                best = row
        if best is not None and not self.done.exists():
            if not self.waiting.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
                self.waiting.update((best["level"], best["message"], int(best["first_us"])))
            elif int(best["first_us"]) < self.waiting.get()[2]:
                self.waiting.update((best["level"], best["message"], int(best["first_us"])))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            level, message, first_us = self.waiting.get()
            self.waiting.clear()
            self.done.update((timerValues.getCurrentProcessingTimeInMs(),))
            yield pd.DataFrame(
                [[key[0], key[1], level, message, first_us]], columns=[f.name for f in TRIGGER.fields]
            )

    def close(self) -> None:
        pass


def failed_trace_stream(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Stream of failed traces, each after its wait.  Needs the RocksDB state store."""
    errors = rows.where(is_error(F.col("level")) & (F.coalesce("trace_id", F.lit("")) != "")).select(
        "tenant_id", "trace_id", "level", "message", F.unix_micros("ts").alias("first_us")
    )
    return errors.groupBy("tenant_id", "trace_id").transformWithStateInPandas(
        WaitForTrace(p.trace_wait_seconds * 1000, p.trace_forget_seconds * 1000),
        outputStructType=TRIGGER,
        outputMode="append",
        timeMode="ProcessingTime",
    )


def correlate_each(
    traces: DataFrame, logs_path: str, out_path: str, state_path: str, checkpoint: str, p: Params = DEFAULTS,
    interval="5 seconds",
):
    """Request-failure events of the traces that are due, from the stored logs.

    Only the days around the traces' first errors are read.  The service
    dependencies of all traces so far are kept as a state table.
    """
    state = StateTables(traces.sparkSession, state_path)

    def each(batch: DataFrame, batch_id: int) -> None:
        due = batch.select("tenant_id", "trace_id", "first_us").persist()
        try:
            span = due.agg(F.min("first_us").alias("a"), F.max("first_us").alias("b")).head()
            if span["a"] is None:
                return
            day = 86400 * 1000000
            logs = read_dated(
                batch.sparkSession, logs_path,
                F.timestamp_micros(F.lit(span["a"] - day)), F.timestamp_micros(F.lit(span["b"] + day)),
            )
            logs = logs.join(due.select("tenant_id", "trace_id"), ["tenant_id", "trace_id"], "left_semi")
            if "log_seq" not in logs.columns:
                logs = logs.withColumn("log_seq", F.xxhash64("log_id"))
            known = state.read(batch_id).get("edges")
            write_batch(request_failures(logs, p, known), out_path, batch_id)
            edges = dependency_edges(flows(logs))
            state.write(batch_id, {"edges": edges if known is None else merge_edges(edges, known)})
        finally:
            due.unpersist()

    return start(traces, each, checkpoint, interval, "correlate")
