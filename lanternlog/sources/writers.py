"""Sinks: topics, dated tables with idempotent upserts, archive, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lanternlog.functions.ids import store_key
from lanternlog.params import DEFAULTS, Params


def topic_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as topic messages: JSON value, optional key."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def write_topic(df: DataFrame, topic: str, servers: str, checkpoint: str, key: str | None = None):
    """Streaming write to a topic, acknowledged by all replicas, three retries."""
    return (
        topic_messages(df, key).writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers).option("topic", topic)
        .option("kafka.acks", "all").option("kafka.retries", "3")
        .option("checkpointLocation", checkpoint)
        .start()
    )


def with_log_key(logs: DataFrame) -> DataFrame:
    """Add the storage key and the day of log rows."""
    key = store_key(F.col("log_id"), F.col("trace_id"), F.col("span_id"), F.unix_micros("ts").cast("string"))
    return logs.withColumns({"_key": key, "dt": F.to_date("ts")})


def with_anomaly_key(events: DataFrame) -> DataFrame:
    key = store_key(F.col("event_id"), F.lit("anomaly"), F.col("service"), F.unix_micros("ts").cast("string"))
    return events.withColumns({"_key": key, "dt": F.to_date("ts")})


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written at the path."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(target)


def upsert_daily(keyed: DataFrame, path: str, max_records_per_file: int = 0) -> None:
    """Append the rows whose key the table does not hold yet.

    Only the days of the incoming rows are read from the table.  A repeated
    batch finds its keys and adds nothing.
    """
    spark = keyed.sparkSession
    rows = keyed.dropDuplicates(["dt", "_key"])
    if _exists(spark, path):
        days = [r["dt"] for r in keyed.select("dt").distinct().collect() if r["dt"] is not None]
        held = spark.read.parquet(path).where(F.col("dt").isin(days) if days else F.lit(False)).select("dt", "_key")
        rows = rows.join(held, ["dt", "_key"], "left_anti")
    writer = rows.write.mode("append").partitionBy("dt")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.parquet(path)


def archive_rows(messages: DataFrame, topic: str) -> DataFrame:
    """Topic messages with their archive partitions."""
    have = set(messages.columns)

    def column(name, type_):
        return (F.col(name) if name in have else F.lit(None)).cast(type_).alias(name)

    rows = messages.select(
        column("key", "string"), F.col("value").cast("string").alias("value"), column("offset", "bigint"),
        F.col("timestamp"), column("headers", "string"),
    )
    return rows.withColumns(
        {"topic": F.lit(topic), "dt": F.to_date("timestamp"), "hr": F.hour("timestamp")}
    )


def write_archive(rows: DataFrame, path: str, max_records_per_file: int = 10000) -> None:
    """Batch write of the archive: Parquet by topic, day and hour, snappy."""
    (
        rows.write.mode("append").option("compression", "snappy").option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("topic", "dt", "hr").parquet(path)
    )


def stream_archive(rows: DataFrame, path: str, checkpoint: str, interval: str = "1 hour"):
    """Streaming write of the archive, one roll per interval."""
    return (
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .option("compression", "snappy").partitionBy("topic", "dt", "hr").trigger(processingTime=interval).start()
    )


def expired_days(days: DataFrame, now: Column, keep_days: int) -> DataFrame:
    """Days (column ``dt``) beyond the retention time."""
    return days.where(F.col("dt") < F.date_sub(F.to_date(now), keep_days))


def drop_expired(spark: SparkSession, path: str, now: Column, keep_days: int) -> list[str]:
    """Delete the daily partitions beyond the retention time; returns their days.

    Partitions are found by listing folders, not by reading rows.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("dt=")]
    if not names:
        return []
    days = spark.createDataFrame([(n[3:],) for n in names], "day string").withColumn("dt", F.to_date("day"))
    gone = sorted(r["day"] for r in expired_days(days, now, keep_days).collect())
    for day in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"dt={day}"), True)
    return gone


def apply_log_retention(spark: SparkSession, path: str, now: Column, p: Params = DEFAULTS) -> list[str]:
    return drop_expired(spark, path, now, p.log_retention_days)


def apply_anomaly_retention(spark: SparkSession, path: str, now: Column, p: Params = DEFAULTS) -> list[str]:
    return drop_expired(spark, path, now, p.anomaly_retention_days)


SHORT_EXPORT = ["id", "title", "severity", "state", "service", "created_at", "updated_at"]
LONG_EXPORT = [
    ("ID", "id"), ("Title", "title"), ("Severity", "severity"), ("State", "state"), ("Service", "service"),
    ("Priority", "priority"), ("Created", "created_at"), ("Assigned To", "assigned_to"), ("MTTR (s)", "mttr_seconds"),
    ("Root Cause", "root_cause"),
]


def iso(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _text(df: DataFrame, name: str) -> Column:
    value = F.col(name)
    shown = iso(value) if df.schema[name].dataType.typeName() == "timestamp" else value.cast("string")
    return F.coalesce(shown, F.lit(""))


def csv_cell(text: Column) -> Column:
    """Cell text, quoted where it holds a comma, a quote or a line break."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)


def export_lines(incidents: DataFrame, columns=SHORT_EXPORT) -> DataFrame:
    """Incidents as CSV lines without the header."""
    names = [c if isinstance(c, str) else c[1] for c in columns]
    return incidents.select("id", F.concat_ws(",", *[csv_cell(_text(incidents, n)) for n in names]).alias("line"))


def export_markdown(incidents: DataFrame) -> DataFrame:
    """Incidents as Markdown table lines without the header."""
    names = ["id", "title", "severity", "state", "service", "created_at"]
    cells = F.concat_ws(" | ", *[_text(incidents, n) for n in names])
    return incidents.select("id", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def export_json(incidents: DataFrame) -> DataFrame:
    """Incidents as JSON lines."""
    return incidents.select("id", F.to_json(F.struct(*incidents.columns)).alias("line"))


def write_csv(incidents: DataFrame, path: str, columns=SHORT_EXPORT) -> None:
    """Incidents as CSV files with a header."""
    pairs = [(c, c) if isinstance(c, str) else c for c in columns]
    shown = incidents.select(*[_text(incidents, name).alias(title) for title, name in pairs])
    shown.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
