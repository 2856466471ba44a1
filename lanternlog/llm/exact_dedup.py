"""Exact dedup as a stateful stream: a disk-backed keyed state that never expires.

The state is keyed by the SHA-256 of the text and retains the stable identifier (the largest id), the locator of the
content (the file it came from) and the number of rows. Rows are combined by key in the tasks that read them before they
are sent to the state, so copies that make up much of the input do not meet in one task. The state lives in RocksDB
instances below the shared folder; a later run over the same folder goes on where the last one ended, with new files.

A hit is not trusted on its digest: the full bytes of every row that shares a key are compared with those of the row
that the state retains. Rows that differ in spite of an equal digest are grouped by their text.

Defined results: a null text equals the empty text. A null id sorts before all others. Repeated rows are members of
their group each; all with the kept id are kept. An empty table gives an empty table. Columns other than ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import NO_ID, cut_lineage, work_path

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: A micro-batch reads about so much.
BATCH_BYTES = 256 << 30


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text.alias("text"), F.sha2(text, 256).alias("digest"))


def run_state(spark: SparkSession, path: str, folder: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Feed the files below ``path`` that the state in ``folder`` has not seen; return the state: digest, id, locator, n."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream takes a plain file only by a pattern
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(pattern)
    rows = stream.select("doc_id", "text", F.col("_metadata.file_path").alias("locator"))
    entry = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "locator")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    groups = rows.select(digest, entry.alias("entry")).groupBy("digest").agg(F.max("entry").alias("entry"), F.count(F.lit(1)).alias("n"))
    with settings(spark, SETTINGS):
        query = groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", folder).trigger(availableNow=True).start()
        query.awaitTermination()
        state = spark.read.format("statestore").load(folder)
        value = [F.col(f"value.`{f.name}`") for f in state.schema["value"].dataType.fields]
        rows = state.select(F.col("key.digest").alias("digest"), value[0].alias("entry"), value[1].alias("n"))
        return cut_lineage(rows.select("digest", "entry.id", "entry.locator", "n"), "exact-groups")


def exact_duplicates(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row below ``path``."""
    folder = folder or work_path(spark, "exact-state")
    groups = run_state(spark, path, folder).select("digest", F.col("id").alias("keep"), F.col("n").alias("size"))
    docs = keyed(spark.read.parquet(path))
    many = groups.filter("size > 1")
    first = docs.join(many.select(F.col("digest").alias("of"), "keep"), (F.col("digest") == F.col("of")) & (F.col("id") == F.col("keep")))
    first = first.groupBy("digest").agg(F.min("text").alias("first_text"))
    hits = docs.join(first, "digest").select("digest", "id", (F.col("text") == F.col("first_text")).alias("same"))
    wrong = cut_lineage(hits.filter("not same").select("digest").distinct(), "collisions")
    out = docs.select("doc_id", "id", "digest").join(groups, "digest")
    if not wrong.isEmpty():
        out = separated(docs, out, wrong)
    keep = F.nullif("keep", F.lit(NO_ID))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.col("size").alias("group_size"), (F.col("id") == F.col("keep")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def separated(docs: DataFrame, out: DataFrame, wrong: DataFrame) -> DataFrame:
    """Group the rows of the digests in ``wrong`` by their text."""
    rows = docs.join(wrong, "digest", "left_semi")
    groups = rows.groupBy("digest", "text").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("size"))
    apart = rows.join(groups, ["digest", "text"]).select("doc_id", "id", "digest", "keep", "size")
    return out.join(wrong, "digest", "left_anti").select("doc_id", "id", "digest", "keep", "size").unionByName(apart)
