"""Rows that come after their watermark: a side table, counts, and the repair of what they touch.

Which rows are late is decided by the watermark that the query itself logged for the micro-batch, so a batch that runs
again after a failure splits its rows in the same way. Late rows and bucket counts are written per micro-batch; counts
of batches and of late rows add up. A late row bears on its own bucket and on those whose window holds it; only these are
scored again, from the buckets around them, and are written as a new version beside the old one.

Defined results: a row without a time is late; it is kept, but lies in no bucket. Before the first watermark no row with a
time is late. Scores that were repaired equal those of all rows at once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanternlog.operators.windows import KEYS, bucket_rates, bucket_scores
from lanternlog.params import DEFAULTS, Params
from lanternlog.streaming.pipelines import WATERMARK, start
from lanternlog.streaming.state import write_batch


def batch_watermark(spark: SparkSession, checkpoint: str, batch_id: int) -> int:
    """Milliseconds of the watermark with which a micro-batch began, from the query's offset log."""
    lines = spark.read.text(f"{checkpoint}/offsets/{batch_id}").where(F.col("value").startswith('{"batchWatermarkMs"'))
    return json.loads(lines.head()["value"])["batchWatermarkMs"]


class LateRows:
    """Micro-batch function that sets late rows aside and hands the others to ``sink(rows, batch_id)``."""

    def __init__(self, sink: Callable[[DataFrame, int], None], late_path: str, checkpoint: str):
        self.sink, self.late_path, self.checkpoint = sink, late_path, checkpoint

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        watermark = batch_watermark(batch.sparkSession, self.checkpoint, batch_id)
        late = F.coalesce(F.unix_millis("ts") < watermark, F.lit(True))
        rows = batch.persist()
        try:
            write_batch(rows.where(late).withColumn("watermark_ms", F.lit(watermark).cast("bigint")), self.late_path, batch_id)
            self.sink(rows.where(~late), batch_id)
        finally:
            rows.unpersist()


def start_with_late(rows: DataFrame, sink, late_path: str, checkpoint: str, delay: str = WATERMARK, interval: str | None = None):
    """Run a sink on a stream's rows in time, with the late ones in a side table."""
    return start(rows.withWatermark("ts", delay), LateRows(sink, late_path, checkpoint), checkpoint, interval, None)


def bucket_sink(path: str, p: Params = DEFAULTS):
    """Sink that writes a micro-batch's rows and errors per bucket."""
    return lambda rows, batch_id: write_batch(bucket_rates(rows, p), path, batch_id)


def late_counts(late: DataFrame) -> DataFrame:
    """Late rows per tenant and service, with the longest delay behind the watermark."""
    delay = (F.col("watermark_ms") - F.unix_millis("ts")) / 1000.0
    return late.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("late"), F.max(delay).alias("most_seconds"))


def merged_buckets(*parts: DataFrame) -> DataFrame:
    """Bucket counts of several micro-batches added up."""
    rows = parts[0].select(*KEYS, "bucket", "total", "errors")
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*rows.columns))
    return rows.groupBy(*KEYS, "bucket").agg(F.sum("total").alias("total"), F.sum("errors").alias("errors"))


def around(buckets: DataFrame, back: int, ahead: int, p: Params) -> DataFrame:
    """The distinct buckets of each service from ``back`` seconds before to ``ahead`` seconds after the given ones."""
    span = F.sequence(F.col("bucket") - back, F.col("bucket") + ahead, F.lit(p.bucket_seconds).cast("bigint"))
    return buckets.select(*KEYS, F.explode(span).alias("bucket")).distinct()


def corrections(on_time: DataFrame, late: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Scores of the buckets that late rows bear on, from bucket counts in time and late."""
    place = [*KEYS, "bucket"]
    touched = late.select(*place).distinct()
    needed = around(touched, p.window_seconds, p.window_seconds, p)
    parts = [counts.join(needed, place, "left_semi") for counts in (on_time, late)]
    return bucket_scores(merged_buckets(*parts), p).join(around(touched, 0, p.window_seconds, p), place, "left_semi")


def write_version(scores: DataFrame, path: str, version: int) -> None:
    """A version of bucket scores; running it again replaces it."""
    scores.write.mode("overwrite").parquet(f"{path}/version={version}")


def newest(scores: DataFrame) -> DataFrame:
    """The newest version of each bucket's scores."""
    columns = [c for c in scores.columns if c not in (*KEYS, "bucket", "version")]
    found = scores.groupBy(*KEYS, "bucket").agg(F.max_by(F.struct(*columns), "version").alias("row"), F.max("version").alias("version"))
    return found.select(*KEYS, "bucket", "row.*", "version")


def repair(spark: SparkSession, counts_path: str, late_path: str, scores_path: str, version: int, p: Params = DEFAULTS) -> None:
    """Write the scores that the late rows so far change as a new version."""
    late = bucket_rates(spark.read.parquet(late_path).where("ts is not null"), p)
    write_version(corrections(spark.read.parquet(counts_path), late, p), scores_path, version)
