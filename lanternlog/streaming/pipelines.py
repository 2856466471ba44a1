"""Streaming forms of the operators.

Stateless steps use the batch functions on the stream as they are.  Stateful
detection runs the batch operators per micro-batch together with small state
tables (recent buckets, recent error seconds, last emissions, template
counts, open tickets), so it splits hot services in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lanternlog.functions import fixed
from lanternlog.functions.text import error_template, is_error, template_key
from lanternlog.operators import composite as cp, features as ft, incidents as inc, parse as ps, rule_score as rs
from lanternlog.operators.windows import bucket_rates
from lanternlog.params import DEFAULTS, Params
from lanternlog.session import cut_lineage
from lanternlog.sources.readers import read_dated
from lanternlog.sources.writers import upsert_daily, with_anomaly_key, with_log_key
from lanternlog.streaming.state import StateTables, write_batch

WATERMARK = "10 minutes"
LATENESS_SECONDS = 600
TEMPLATE_IDLE_SECONDS = 3600


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of queries that start from here on in RocksDB, with changelog checkpoints."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def start(stream: DataFrame, each_batch, checkpoint: str, interval: str | None = None, name: str | None = None):
    """Run a function per micro-batch: every ``interval``, or over what is there now and then stop."""
    use_rocksdb(stream.sparkSession)
    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


# --- stateless ---------------------------------------------------------------


def parse_to_tables(raw: DataFrame, logs_path: str, dead_path: str, checkpoint: str, p: Params = DEFAULTS, interval=None):
    """Raw messages to the daily log table and the dead letters; each message is parsed once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        order = [c for c in ("partition", "offset") if c in batch.columns]
        rows = ps.parsed_rows(batch.select("value", *order), p).persist()
        try:
            good = ps.good_rows(rows)
            # places of one micro-batch come again in the next one; without offsets a hash tells rows apart
            good = good if "offset" in order else good.withColumn("log_seq", F.xxhash64("log_id"))
            upsert_daily(with_log_key(good), logs_path)
            write_batch(ps.dead_letters(rows), dead_path, batch_id)
        finally:
            rows.unpersist()

    return start(raw, each, checkpoint, interval, "parse")


def store_events(events: DataFrame, path: str, checkpoint: str, interval: str | None = "5 seconds"):
    """Anomaly events to their daily table; repeated events add nothing."""

    def each(batch: DataFrame, batch_id: int) -> None:
        upsert_daily(with_anomaly_key(batch), path)

    return start(events, each, checkpoint, interval, "events")


def rule_events(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Rule-scored events of a stream of log rows."""
    return rs.rule_score(rows, p)


def enrich_each(rows: DataFrame, features_path: str, sink, checkpoint: str, interval: str | None = "60 seconds", replay: bool = False):
    """Join the stored features, read anew for every micro-batch, and hand the rows to ``sink``.

    A replay joins the features that were computed by a row's own time.
    """
    join = ft.enrich_asof if replay else ft.enrich

    def each(batch: DataFrame, batch_id: int) -> None:
        fresh = ft.not_enriched(batch)
        found = batch.sparkSession.read.parquet(features_path)
        sink(join(fresh, found).withColumn("enriched_at", F.current_timestamp()), batch_id)

    return start(rows, each, checkpoint, interval, "enrich")


def without_repeats(rows: DataFrame, key: str = "log_id") -> DataFrame:
    """Stream without rows whose key was seen within the watermark."""
    return rows.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark([key])


def bucket_stream(rows: DataFrame, slide: bool = False, p: Params = DEFAULTS) -> DataFrame:
    """Rows and errors per bucket, or per sliding window with a bucket's step, as buckets close."""
    width, step = f"{p.bucket_seconds} seconds", f"{p.window_seconds} seconds"
    span = F.window("ts", step, width) if slide else F.window("ts", width)
    return (
        rows.withWatermark("ts", WATERMARK)
        .groupBy("tenant_id", "service", span.alias("w"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(is_error(F.col("level"))).alias("errors"))
        .select("tenant_id", "service", F.unix_seconds("w.start").alias("bucket"), "total", "errors")
    )


def late_rows(batch: DataFrame, newest_seen: Column, lateness: int = LATENESS_SECONDS) -> DataFrame:
    """Rows of a micro-batch that are older than the lateness allows, counted per service."""
    return (
        batch.where(F.unix_seconds("ts") < newest_seen - lateness)
        .groupBy("tenant_id", "service")
        .agg(F.count(F.lit(1)).alias("late"))
    )


# --- composite scorer --------------------------------------------------------


class CompositeStream:
    """Immediate and windowed events of a stream, with its state in tables."""

    def __init__(self, spark: SparkSession, out_path: str, state_path: str, p: Params = DEFAULTS):
        self.out_path = out_path
        self.state = StateTables(spark, state_path)
        self.p = p

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        p = self.p
        batch = cut_lineage(batch, "batch")
        if batch.isEmpty():
            return
        old = self.state.read(batch_id)
        emitted = cp.immediate_rows(batch, p, old.get("emissions"))
        scores = cut_lineage(
            cp.windowed_scores(
                batch, p, emitted=emitted, bucket_history=old.get("buckets"), error_history=old.get("errors"),
                template_history=old.get("templates"),
            ),
            "scores",
        )
        events = cp.immediate(batch, p, emitted).unionByName(cp.windowed(batch, p, scores=scores))
        write_batch(events, self.out_path, batch_id)
        self.state.write(batch_id, self._next(batch, emitted, scores, old))

    def _next(self, batch, emitted, scores, old) -> dict[str, DataFrame]:
        """State after the batch: what later rows can still need."""
        p = self.p
        newest = batch.agg(F.max(F.unix_seconds("ts")).alias("s")).head()["s"]
        if "clock" in old:
            newest = max(newest, old["clock"].head()["newest"])
        since = newest - LATENESS_SECONDS

        def merged(name, rows):
            return old[name].select(*rows.columns).unionByName(rows) if name in old else rows

        buckets = merged("buckets", bucket_rates(batch, p)).groupBy("tenant_id", "service", "bucket").agg(
            F.sum("total").alias("total"), F.sum("errors").alias("errors")
        )
        errors = batch.where(is_error(F.col("level"))).select("tenant_id", "service", F.unix_seconds("ts").alias("sec"))
        emissions = merged("emissions", emitted.select(*cp.SUPPRESS_KEYS, "sec")).groupBy(*cp.SUPPRESS_KEYS).agg(
            F.max("sec").alias("sec")
        )
        seen = scores.where("is_error").groupBy(
            "tenant_id", template_key(error_template(F.col("message"))).alias("template_id")
        ).agg(F.count(F.lit(1)).alias("seen"), F.max("sec").alias("last_sec"))
        templates = merged("templates", seen).groupBy("tenant_id", "template_id").agg(
            F.least(F.sum("seen"), F.lit(fixed.RECURRENCE_LAST)).alias("seen"), F.max("last_sec").alias("last_sec")
        )
        return {
            "buckets": buckets.where(F.col("bucket") >= since - p.window_seconds - p.bucket_seconds),
            "errors": merged("errors", errors).distinct().where(F.col("sec") >= since - p.blast_window_seconds),
            "emissions": emissions.where(F.col("sec") >= since - p.immediate_dedup_seconds),
            "templates": templates.where(F.col("last_sec") >= since - TEMPLATE_IDLE_SECONDS),
            "clock": batch.sparkSession.createDataFrame([(newest,)], "newest bigint"),
        }


# --- tickets -----------------------------------------------------------------


class TicketStream:
    """Opens tickets of a stream of events and groups events into open ones.

    Output per micro-batch: the kept events with their ticket (``open_sec``)
    and rank; rank 1 opens the ticket.  Later events of a full ticket only
    count.  Sub-second parts of a ticket that spans micro-batches stay exact,
    because the rank goes on from the count so far.
    """

    def __init__(self, spark: SparkSession, out_path: str, state_path: str, p: Params = DEFAULTS):
        self.out_path = out_path
        self.state = StateTables(spark, state_path)
        self.p = p

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        p = self.p
        events = cut_lineage(inc.keyed_events(batch, p), "events")
        if events.isEmpty():
            return
        old = self.state.read(batch_id)
        open_ = old.get("tickets")
        seconds = events.groupBy(*inc.KEYS, "sec").agg(F.count(F.lit(1)).alias("n_events"))
        marks = seconds.select(*inc.KEYS, "sec")
        if open_ is not None:
            marks = marks.unionByName(open_.select(*inc.KEYS, F.col("open_sec").alias("sec")))
        spans = inc.greedy_windows(marks, inc.KEYS, p.ticket_dedup_seconds)
        windows = cut_lineage(seconds.join(spans, [*inc.KEYS, "sec"]), "windows")
        kept = inc.ticket_members(events, windows, p)
        if open_ is not None:
            before = open_.select(*inc.KEYS, "open_sec", F.col("n_events").alias("before"))
            kept = kept.join(before, [*inc.KEYS, "open_sec"], "left").withColumn(
                "rank", F.col("rank") + F.coalesce("before", F.lit(0))
            ).where(F.col("rank") <= p.ticket_group_size).drop("before")
        kept = kept.withColumn("rank", F.col("rank").cast("long"))
        write_batch(kept, self.out_path, batch_id)
        totals = windows.groupBy(*inc.KEYS, "open_sec").agg(F.sum("n_events").alias("n_events"))
        if open_ is not None:
            totals = totals.unionByName(open_.select(*totals.columns)).groupBy(*inc.KEYS, "open_sec").agg(
                F.sum("n_events").alias("n_events")
            )
        newest = events.agg(F.max("sec").alias("s")).head()["s"]
        horizon = newest - p.ticket_dedup_seconds - LATENESS_SECONDS
        last = totals.groupBy(*inc.KEYS).agg(F.max_by(F.struct("open_sec", "n_events"), "open_sec").alias("t"))
        self.state.write(
            batch_id, {"tickets": last.select(*inc.KEYS, "t.open_sec", "t.n_events").where(F.col("open_sec") >= horizon)}
        )


# --- counters ----------------------------------------------------------------


def counted(rows: DataFrame, name: str, **measures: Column) -> DataFrame:
    """Attach named counters to a stream; read them with ``CounterListener``."""
    exprs = [F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in measures.items()]]
    return rows.observe(name, *exprs)


class CounterListener(StreamingQueryListener):
    """Adds up the counters of all micro-batches, per counter name."""

    def __init__(self):
        self.totals: dict[str, int] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        for name, row in event.progress.observedMetrics.items():
            for field, value in row.asDict().items():
                key = f"{name}.{field}"
                self.totals[key] = self.totals.get(key, 0) + (value or 0)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """Counters as (name, value) rows, as ``stage_totals`` reads them."""
        return spark.createDataFrame(sorted(self.totals.items()), "name string, value bigint")


class StateListener(StreamingQueryListener):
    """Size of the keyed state after every micro-batch, per query and stateful operator."""

    FIELDS = "query string, batch_id bigint, operator string, rows bigint, updated bigint, late bigint, memory_bytes bigint, provider string"

    def __init__(self):
        self.rows: dict[tuple, tuple] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        for i, op in enumerate(p.stateOperators):
            rocks = any(name.lower().startswith("rocksdb") for name in op.customMetrics)
            row = (op.numRowsTotal, op.numRowsUpdated, op.numRowsDroppedByWatermark, op.memoryUsedBytes, "rocksdb" if rocks else "memory")
            self.rows[p.name or str(p.id), p.batchId, f"{i}:{op.operatorName}"] = row

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(*key, *row) for key, row in sorted(self.rows.items())], self.FIELDS)
