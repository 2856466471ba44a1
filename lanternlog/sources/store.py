"""Daily tables that are changed in place: whole days are replaced, other days keep their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lanternlog.operators.lifecycle import batch_apply
from lanternlog.session import cut_lineage
from lanternlog.sources.writers import upsert_daily

TARGET_BYTES = 128 << 20


def replace_days(rows: DataFrame, path: str) -> None:
    """Replace the days (column ``dt``) that the rows lie in; the rows must not come from the table itself."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


def days_in(dt: Column, days: list) -> Column:
    return dt.isin(days) if days else F.lit(False)


def apply_batch(spark: SparkSession, incidents_path: str, audit_path: str, requests: DataFrame) -> DataFrame:
    """Apply batches of requests to the stored incidents; returns the result per request.

    Audit rows are written first, under ids made of batch, place and incident,
    then the days of the changed incidents are replaced.  A run that stopped
    in between, or that is repeated, leaves the same tables.
    """
    requests = cut_lineage(requests, "requests")
    stored = spark.read.parquet(incidents_path)
    if "applied" not in stored.columns:
        raise ValueError("stored incidents need the column applied, as build_incidents gives it")
    touched = stored.join(requests.select("id").distinct(), "id", "left_semi").select("dt").distinct()
    held = stored.where(days_in(F.col("dt"), [r["dt"] for r in touched.collect()]))
    results, after, audit = batch_apply(held, requests)
    results = cut_lineage(results, "results")
    after = cut_lineage(after, "after")
    audit = cut_lineage(audit.withColumns({"_key": F.col("audit_id"), "dt": F.to_date("at")}), "audit")
    upsert_daily(audit, audit_path)
    changed = [r["dt"] for r in after.where("changed").select("dt").distinct().collect()]
    if changed:
        replace_days(after.where(days_in(F.col("dt"), changed)).drop("changed"), incidents_path)
    return results


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(dt, file, bytes, rows) of a daily table; no column of the data is read."""
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")
    return spark.read.parquet(path).select("dt", *place).groupBy("dt", "file").agg(F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def scattered_days(files: DataFrame, target_bytes: int) -> DataFrame:
    """Days with more files than their bytes need, or with a file far above the target: (dt, pieces, rows)."""
    days = files.groupBy("dt").agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"), F.max("bytes").alias("largest")
    )
    pieces = F.greatest(F.ceil(F.col("bytes") / target_bytes), F.lit(1))
    return days.select("dt", pieces.alias("pieces"), "rows", "files", "largest").where(
        (F.col("files") > F.col("pieces")) | (F.col("largest") > 2 * target_bytes)
    )


def compact_days(spark: SparkSession, path: str, key: str, target_bytes: int = TARGET_BYTES) -> list:
    """Pack the files of scattered days to about ``target_bytes`` each, sorted by ``key``; returns the days.

    A day's rows are dealt by the key's hash to as many files as its bytes need.

    The packed rows are written to the shared work folder first, so the table
    is never read and replaced by one job, and a stop leaves a whole copy.
    """
    days = scattered_days(file_sizes(spark, path), target_bytes).collect()
    if not days:
        return []
    places, first = [], 0
    for day in days:
        places.append((day["dt"], first, day["pieces"]))
        first += day["pieces"]
    table = spark.createDataFrame(places, "dt date, first bigint, pieces bigint")
    rows = spark.read.parquet(path).where(days_in(F.col("dt"), [d["dt"] for d in days]))
    packed = cut_lineage(rows, "compact").join(F.broadcast(table), "dt")  # one row per day
    file = F.col("first") + F.pmod(F.xxhash64(key), F.col("pieces"))
    packed = packed.repartitionById(first, file.cast("int")).drop("first", "pieces").sortWithinPartitions("dt", key)
    replace_days(packed, path)
    return sorted(d["dt"] for d in days)
