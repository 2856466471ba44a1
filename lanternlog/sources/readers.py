"""Sources: topics, log files of several formats, dated tables, dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lanternlog.params import DEFAULTS, Params

FILE_FORMATS = ("csv", "ndjson", "json", "text")


def kafka_options(
    topic: str, servers: str, starting: str = "latest", max_records: int | None = None, min_records: int | None = None,
    max_delay: str | None = None, **more,
) -> dict:
    """Options of a topic source: where to start and how much one batch takes.

    A batch waits for ``min_records``, but no longer than ``max_delay``.
    """
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, **more}
    if max_records is not None:
        options["maxOffsetsPerTrigger"] = str(max_records)
    if min_records is not None:
        options["minOffsetsPerTrigger"] = str(min_records)
    if max_delay is not None:
        options["maxTriggerDelay"] = max_delay
    return options


def read_topic(spark: SparkSession, topic: str, servers: str, starting: str = "latest", **options) -> DataFrame:
    """Stream of a topic's values as text.  Needs the Kafka connector on the class path."""
    source = spark.readStream.format("kafka").options(**kafka_options(topic, servers, starting, **options)).load()
    return source.select(F.col("value").cast("string").alias("value"), "partition", "offset", "timestamp")


def read_topic_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of text files, one message per line, in place of a topic."""
    reader = spark.readStream.format("text")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def read_table_stream(
    spark: SparkSession, path: str, schema, files_per_batch: int | None = None, bytes_per_batch: int | None = None
) -> DataFrame:
    """Stream of the Parquet files that are added to a table, a batch bounded by their number or by their bytes."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch is not None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path)


def raw_anomalies(spark: SparkSession, servers: str, p: Params = DEFAULTS) -> DataFrame:
    """Anomaly events from the earliest offset on, at most 100 records per batch."""
    return read_topic(spark, p.anomaly_topic, servers, starting="earliest", max_records=100)


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of JSON files that hold one object or an array: (file, element, text); ``element`` is its place.

    A file is read in ranges, as pieces that end with a closing brace, so one
    large array is not one row in one task.  Whether a piece begins inside a
    string is told by the number of quotes before it, and how deep it lies by
    the brackets before it; both are running sums over the ranges of a file
    and the pieces of a range.  The pieces of an element are then joined.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )
    plain = F.regexp_replace("value", r"\\[\s\S]", "")
    pieces = pieces.withColumns({"plain": plain, "quotes": F.char_length(plain) - F.char_length(F.replace(plain, F.lit('"'), F.lit("")))})
    pieces = _running_in_file(pieces, {"quotes": F.col("quotes")}).withColumn("inside", F.col("quotes_before") % 2 == 1)
    # outside of strings: what a string leaves at the beginning, whole strings, and a string that is still open at the end
    bare = F.regexp_replace("plain", r'"[^"]*"', "")
    left = F.when(F.col("inside"), F.regexp_replace(F.regexp_replace("plain", r'^[^"]*("|$)', ""), r'"[^"]*"', "")).otherwise(bare)
    left = F.regexp_replace(left, r'"[^"]*$', "")

    def count(mark: str) -> Column:
        return F.char_length(left) - F.char_length(F.replace(left, F.lit(mark), F.lit("")))

    closed = ~((F.col("quotes_before") + F.col("quotes")) % 2 == 1) & ~(F.col("open_end") & (F.struct("range", "row") == F.col("last")))
    pieces = pieces.join(_file_forms(pieces), "file").withColumn("closed", closed)
    depth = count("{") + count("[") - count("]") - F.col("closed").cast("int")
    pieces = _running_in_file(pieces, {"depth": depth})
    top = F.when(F.col("is_array"), 1).otherwise(0)
    ended = F.col("closed") & (F.col("depth_before") + F.col("depth") == top)
    pieces = _running_in_file(pieces, {"ended": ended.cast("int")})
    joined = pieces.groupBy("file", F.col("ended_before").alias("element"), "is_array").agg(
        F.array_sort(F.collect_list(F.struct("range", "row", "value"))).alias("parts"), F.max("ended").alias("whole")
    )
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "}")
    text = F.when(F.col("is_array"), F.regexp_replace(text, r"^\s*[\[,]?\s*", "")).otherwise(F.ltrim(text))
    # behind the last element there is only the end of the array
    rest = F.when(F.col("is_array"), F.regexp_replace(text, r"^\s*\]?\s*$", "")).otherwise(F.trim(text))
    rows = joined.select("file", "element", F.when(F.col("whole") == 1, F.concat(text, F.lit("}"))).otherwise(rest).alias("text"))
    return rows.where(F.col("text").rlike(r"\S"))


def _file_forms(pieces: DataFrame) -> DataFrame:
    """Per file: whether it holds an array, its last piece, and whether that one lacks its closing brace."""
    char = F.substring(F.regexp_replace("value", r"^\s+", ""), 1, 1)
    first = F.min(F.when(char != "", F.struct("range", "row", char.alias("c"))))
    size = F.sum(F.octet_length("value") + 1)
    return pieces.groupBy("file").agg(
        (F.coalesce(first["c"], F.lit("")) == "[").alias("is_array"),
        F.max(F.struct("range", "row")).alias("last"),
        (size > F.max("size")).alias("open_end"),
    )


def _running_in_file(pieces: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Add each measure and its sum over all earlier pieces of the file, by ranges and then by pieces of a range."""
    rows = pieces.withColumns(measures)
    inside = W.partitionBy("file", "range").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    over_ranges = W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = rows.groupBy("file", "range").agg(*[F.sum(n).alias(n) for n in measures])
    ranges = ranges.select("file", "range", *[F.coalesce(F.sum(n).over(over_ranges), F.lit(0)).alias(f"{n}_range") for n in measures])
    rows = rows.withColumns({f"{n}_in": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in measures}).join(ranges, ["file", "range"])
    rows = rows.withColumns({f"{n}_before": F.col(f"{n}_in") + F.col(f"{n}_range") for n in measures})
    return rows.drop(*[f"{n}_in" for n in measures], *[f"{n}_range" for n in measures])


def parsed_elements(elements: DataFrame) -> DataFrame:
    """Elements as field maps (``f``); one that is no object has a ``reason`` and keeps its text and place."""
    fields = F.from_json("text", "map<string,string>")
    reason = F.when(fields.isNull(), F.when(F.try_parse_json("text").isNull(), "parse_error").otherwise("unknown_format"))
    return elements.select("file", "element", fields.alias("f"), reason.alias("reason"), F.when(fields.isNull(), F.col("text")).alias("original"))


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON files that hold one object or an array of objects, as field maps; see ``json_rejects`` for the rest."""
    return parsed_elements(json_elements(spark, path)).where("reason is null").select("f")


def json_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Elements of JSON files that cannot be read, with file, place and reason."""
    return parsed_elements(json_elements(spark, path)).where("reason is not null").select("file", "element", "reason", "original")


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line, as field maps; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", "map<string,string>").alias("f"))


def read_csv_logs(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, as field maps; missing cells are empty, cells are trimmed."""
    rows = (
        spark.read.option("header", True).option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    )
    pairs = []
    for name in rows.columns:
        pairs += [F.lit(name.strip()), F.coalesce(F.col(f"`{name}`"), F.lit(""))]
    return rows.select(F.create_map(*pairs).alias("f"))


def read_text_logs(spark: SparkSession, path: str) -> DataFrame:
    """Plain text, one row per line that is not blank, at level INFO and the current time."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return lines.select(
        F.create_map(F.lit("message"), "value", F.lit("timestamp"), now, F.lit("level"), F.lit("INFO")).alias("f")
    )


def file_format(spark: SparkSession, path: str) -> str:
    """Format of a file: by its name, else by its first character that is not blank."""
    if path.endswith(".csv"):
        return "csv"
    if path.endswith((".ndjson", ".jsonl")):
        return "ndjson"
    first = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1)).head(1)
    return "json" if first and first[0][0] in ("[", "{") else "text"


def read_log_files(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Log files as field maps (column ``f``), ready for ``flat_rows``."""
    readers = {
        "csv": read_csv_logs, "ndjson": read_ndjson, "json": read_json_documents, "text": read_text_logs,
    }
    return readers[format or file_format(spark, path)](spark, path)


def read_dated(spark: SparkSession, path: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """A table with daily partitions ``dt``, reading only the days asked for."""
    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.where(F.col("dt") >= F.to_date(start))
    if end is not None:
        rows = rows.where(F.col("dt") <= F.to_date(end))
    return rows


def read_archive(spark: SparkSession, path: str, topic: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Archived messages of a topic, in the columns a topic source has."""
    rows = spark.read.parquet(path).where(F.col("topic") == topic)
    hour = F.make_timestamp(F.year("dt"), F.month("dt"), F.dayofmonth("dt"), F.col("hr"), F.lit(0), F.lit(0))
    if start is not None:
        rows = rows.where((F.col("dt") >= F.to_date(start)) & (hour >= F.date_trunc("hour", start)))
    if end is not None:
        rows = rows.where((F.col("dt") <= F.to_date(end)) & (hour <= end))
    return rows.select(F.col("value").cast("string").alias("value"), "key", "offset", "timestamp", "headers")


def read_dimension(spark: SparkSession, source: dict) -> DataFrame:
    """A small relational table: ``{"path": ...}`` for Parquet, else JDBC options."""
    if "path" in source:
        return spark.read.parquet(source["path"])
    return spark.read.format("jdbc").options(**source).load()
