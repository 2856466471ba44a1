"""Bucket rates and the windowed signals built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lanternlog.functions import fixed
from lanternlog.functions.signals import ladder
from lanternlog.functions.text import error_template, is_error, template_key
from lanternlog.operators.sequence import PIECE, PIECE_BITS
from lanternlog.params import DEFAULTS, Params

KEYS = ["tenant_id", "service"]
HOUR = 3600
BLOCK_SECONDS = 3600


def bucket_start(p: Params) -> Column:
    second = F.unix_seconds("ts")
    return second - second % p.bucket_seconds


def bucket_rates(logs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Rows and errors per tenant, service and bucket."""
    return (
        logs.withColumn("bucket", bucket_start(p))
        .groupBy(*KEYS, "bucket")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(is_error(F.col("level"))).alias("errors"))
    )


def bucket_history(buckets: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Add what the earlier buckets of the window hold.

    The frame reaches back to ``window - bucket`` seconds.  A row exactly at
    its bucket's start also still sees the bucket one full window earlier,
    unless the window is already full (``edge_*`` columns).

    A service's buckets are cut into blocks of an hour, and the last window
    of a block is copied to the next one, so no task holds a service's whole
    time.  Deviations are summed from the frame's own mean.
    """
    length = max(BLOCK_SECONDS, p.window_seconds)
    block = F.floor(F.col("bucket") / length)
    near_end = F.col("bucket") % length >= length - p.window_seconds
    places = F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))
    cut = buckets.withColumn("block", F.explode(places))
    by = W.partitionBy(*KEYS, "block").orderBy("bucket")
    before = by.rangeBetween(-(p.window_seconds - p.bucket_seconds), -p.bucket_seconds)
    edge = by.rangeBetween(-p.window_seconds, -p.window_seconds)
    rate = F.col("errors") / F.col("total")
    capacity = p.window_seconds // p.bucket_seconds
    prev_n = F.count(F.lit(1)).over(before)
    edge_n = F.count(F.lit(1)).over(edge)
    out = cut.withColumns(
        {
            "prev_n": prev_n,
            "prev_rates": F.collect_list(rate).over(before),
            "prev_rate": F.coalesce(F.sum(rate).over(before), F.lit(0.0)),
            "prev_errors": F.coalesce(F.sum("errors").over(before), F.lit(0)),
            "edge_n": F.when(prev_n <= capacity - 2, edge_n).otherwise(F.lit(0)),
            "edge_rate": F.coalesce(F.sum(rate).over(edge), F.lit(0.0)),
            "edge_errors": F.coalesce(F.sum("errors").over(edge), F.lit(0)),
        }
    ).where(F.col("block") == block)
    mean = F.col("prev_rate") / F.col("prev_n")
    squares = F.aggregate("prev_rates", F.lit(0.0), lambda total, r: total + (r - mean) * (r - mean))
    return out.withColumn("prev_m2", squares).drop("block", "prev_rates")


def piece_context(logs: DataFrame, p: Params = DEFAULTS, history: DataFrame | None = None) -> DataFrame:
    """Per piece of a bucket: the bucket's window and the counts before the piece.

    ``history`` holds buckets counted in earlier runs; a bucket found there
    goes on from its counts.
    """
    pieces = (
        logs.select(*KEYS, "ts", "log_seq", "level")
        .withColumns(
            {
                "bucket": bucket_start(p),
                "pc_sec": F.unix_seconds("ts"),
                "pc_block": F.shiftright("log_seq", PIECE_BITS),
            }
        )
        .groupBy(*KEYS, "bucket", "pc_sec", "pc_block")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(is_error(F.col("level"))).alias("errors"))
    )
    if history is not None:
        older = history.select(
            *KEYS, "bucket", F.lit(-1).cast("long").alias("pc_sec"), F.lit(-1).cast("long").alias("pc_block"),
            "total", "errors",
        )
        pieces = pieces.unionByName(older)
    inside = W.partitionBy(*KEYS, "bucket").orderBy("pc_sec", "pc_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.select(
        *KEYS, "bucket", "pc_sec", "pc_block",
        F.coalesce(F.sum("total").over(inside), F.lit(0)).alias("total_before"),
        F.coalesce(F.sum("errors").over(inside), F.lit(0)).alias("errors_before"),
    )
    buckets = pieces.groupBy(*KEYS, "bucket").agg(F.sum("total").alias("total"), F.sum("errors").alias("errors"))
    return offsets.join(bucket_history(buckets, p).drop("total", "errors"), [*KEYS, "bucket"]).where("pc_sec >= 0")


def erroring_services(
    logs: DataFrame, p: Params = DEFAULTS, history: DataFrame | None = None
) -> DataFrame:
    """Services of a tenant with an error in the last ``blast_window_seconds``.

    One row (tenant_id, sec, services) per second in which an error occurs.
    An event-time second is the unit; both ends of the window count.  Errors
    are first reduced to distinct seconds, each service's seconds are merged
    to active intervals, and interval ends are summed up within one tenant
    and hour.
    """
    span = p.blast_window_seconds
    seconds = logs.where(is_error(F.col("level"))).select(*KEYS, F.unix_seconds("ts").alias("sec")).distinct()
    asked = seconds.select("tenant_id", "sec").distinct()
    if history is not None:
        seconds = seconds.unionByName(history.select(*KEYS, "sec")).distinct()
    parts = seconds.select(
        *KEYS, "sec",
        F.explode(F.sequence(F.floor(F.col("sec") / HOUR), F.floor((F.col("sec") + span) / HOUR))).alias("hr"),
    ).select(
        *KEYS, "hr",
        F.greatest("sec", F.col("hr") * HOUR).alias("lo"),
        F.least(F.col("sec") + span, F.col("hr") * HOUR + HOUR - 1).alias("hi"),
    )
    per_service = W.partitionBy(*KEYS, "hr").orderBy("lo")
    islands = (
        parts.withColumn("reach", F.max("hi").over(per_service.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("new", (F.col("reach").isNull() | (F.col("lo") > F.col("reach"))).cast("int"))
        .withColumn("island", F.sum("new").over(per_service))
        .groupBy(*KEYS, "hr", "island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    changes = (
        islands.select(
            "tenant_id", "hr",
            F.explode(
                F.array(
                    F.struct(F.col("lo").alias("sec"), F.lit(1).alias("d")),
                    F.struct((F.col("hi") + 1).alias("sec"), F.lit(-1).alias("d")),
                )
            ).alias("c"),
        )
        .groupBy("tenant_id", "hr", F.col("c.sec").alias("sec"))
        .agg(F.sum("c.d").alias("d"))
        .withColumn("ask", F.lit(False))
    )
    asks = asked.select(
        "tenant_id", F.floor(F.col("sec") / HOUR).alias("hr"), "sec", F.lit(0).cast("long").alias("d"),
        F.lit(True).alias("ask"),
    )
    level = F.sum("d").over(W.partitionBy("tenant_id", "hr").orderBy("sec"))
    return (
        changes.unionByName(asks).withColumn("services", level).where("ask").select("tenant_id", "sec", "services")
    )


def blast_weight(services: Column) -> Column:
    return ladder(services, fixed.BLAST_WEIGHTS)


def velocity_weight(current: Column, prev_errors: Column, prev_n: Column) -> Column:
    """Weight of the current bucket's errors against the mean of earlier buckets."""
    mean = prev_errors / prev_n
    by_count = ladder(current, fixed.VELOCITY_COUNT_WEIGHTS)
    by_ratio = ladder(current / mean, fixed.VELOCITY_RATIO_WEIGHTS)
    return F.when(prev_n >= 1, F.when(mean < 1, by_count).otherwise(by_ratio))


def recurrence(errors: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The first five occurrences of each error template of a tenant.

    Input: error rows with ``template_id``.  Output: (log_seq, occurrence,
    recurrence_w); rows not in the output are later occurrences, of no
    weight.  Each input partition keeps only five rows per template before
    the shuffle.  ``history`` counts occurrences of earlier runs.
    """
    order = W.partitionBy("tenant_id", "template_id").orderBy("ts", "log_seq")
    first = (
        errors.select("tenant_id", "template_id", "ts", "log_seq")
        .withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= fixed.RECURRENCE_LAST)
    )
    occurrence = F.col("rn").cast("long")
    if history is not None:
        first = first.join(history.select("tenant_id", "template_id", "seen"), ["tenant_id", "template_id"], "left")
        occurrence = occurrence + F.coalesce(F.col("seen"), F.lit(0))
    return first.withColumn("occurrence", occurrence).where(F.col("occurrence") <= fixed.RECURRENCE_LAST).select(
        "log_seq",
        "occurrence",
        F.when(F.col("occurrence") == 1, F.lit(fixed.RECURRENCE_FIRST))
        .otherwise(F.lit(fixed.RECURRENCE_NEXT))
        .alias("recurrence_w"),
    )


def error_templates(logs: DataFrame) -> DataFrame:
    """Count, first and last time of each error template of a tenant."""
    return (
        logs.where(is_error(F.col("level")))
        .withColumn("template", error_template(F.col("message")))
        .groupBy("tenant_id", "template")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
        .withColumn("template_id", template_key(F.col("template")))
    )


def _statistics(rows: DataFrame, edge: Column) -> DataFrame:
    """Window statistics from the earlier buckets, the one at the edge if ``edge`` holds, and the current one.

    Squares are taken of deviations from the common mean, so rates that
    differ by little keep their difference.
    """
    rate = F.col("run_errors") / F.col("run_total")
    n = F.col("prev_n") + F.when(edge, 1).otherwise(0)
    mean = (F.col("prev_rate") + F.when(edge, F.col("edge_rate")).otherwise(0.0) + rate) / (n + 1)
    rows = rows.withColumns(
        {
            "buckets": n + 1,
            "current_rate": rate,
            "mean_rate": mean,
            "window_errors": F.col("prev_errors") + F.when(edge, F.col("edge_errors")).otherwise(0),
            "window_n": n,
        }
    )

    def square(value: Column) -> Column:
        return (value - F.col("mean_rate")) * (value - F.col("mean_rate"))

    earlier = F.when(F.col("prev_n") > 0, F.col("prev_m2") + F.col("prev_n") * square(F.col("prev_rate") / F.col("prev_n")))
    total = F.coalesce(earlier, F.lit(0.0)) + F.when(edge, square(F.col("edge_rate"))).otherwise(0.0) + square(F.col("current_rate"))
    std = F.sqrt(total / F.col("buckets"))
    return rows.withColumn("std_rate", F.when(std < fixed.FLAT_STD, 0.0).otherwise(std)).withColumn(
        "z_score",
        F.when(F.col("std_rate") > 0, F.round((F.col("current_rate") - F.col("mean_rate")) / F.col("std_rate"), 9)),
    )


def bucket_errors_zscore(context: DataFrame) -> DataFrame:
    """Window statistics of rows that carry a piece context and running counts."""
    return _statistics(context, _at_edge())


def bucket_scores(buckets: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Window statistics of whole buckets, as they stand when a bucket has ended."""
    rows = bucket_history(buckets, p).withColumns({"run_total": F.col("total"), "run_errors": F.col("errors")})
    return _statistics(rows, F.lit(False)).select(
        *KEYS, "bucket", "total", "errors", "buckets", "current_rate", "mean_rate", "std_rate", "z_score"
    )


PIECE_KEYS = [*KEYS, "bucket", "pc_sec", "pc_block"]


def _with_piece(rows: DataFrame, p: Params) -> DataFrame:
    return rows.withColumns(
        {"bucket": bucket_start(p), "pc_sec": F.unix_seconds("ts"), "pc_block": F.shiftright("log_seq", PIECE_BITS)}
    )


def _at_edge() -> Column:
    return (F.unix_micros("ts") == F.col("bucket") * 1000000) & (F.col("edge_n") > 0)


def with_bucket_count(rows: DataFrame, context: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Add only the number of buckets a row's window holds; no row is ordered for it."""
    joined = _with_piece(rows, p).join(context.select(*PIECE_KEYS, "prev_n", "edge_n"), PIECE_KEYS)
    buckets = F.col("prev_n") + F.when(_at_edge(), 1).otherwise(0) + 1
    return joined.withColumn("buckets", buckets).drop("bucket", "pc_sec", "pc_block", "prev_n", "edge_n")


def with_window_statistics(
    rows: DataFrame, p: Params = DEFAULTS, history: DataFrame | None = None, context: DataFrame | None = None
) -> DataFrame:
    """Add to every row its window statistics; rows are shuffled once, by piece."""
    context = piece_context(rows, p, history) if context is None else context
    inner = W.partitionBy(*PIECE_KEYS).orderBy("ts", "log_seq").rowsBetween(W.unboundedPreceding, 0)
    joined = _with_piece(rows, p).join(context, PIECE_KEYS).withColumns(
        {
            "run_total": F.col("total_before") + F.count(F.lit(1)).over(inner),
            "run_errors": F.col("errors_before") + F.sum(is_error(F.col("level")).cast("int")).over(inner),
        }
    )
    return bucket_errors_zscore(joined).drop(
        "pc_sec", "pc_block", "total_before", "errors_before", "prev_n", "prev_rate", "prev_m2",
        "prev_errors", "edge_n", "edge_rate", "edge_errors",
    )
