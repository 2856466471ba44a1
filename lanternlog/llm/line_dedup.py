"""Line dedup with sharded cuckoo filters over exact reference counts; documents can be added and deleted.

The index is a folder of tables. Postings say which document holds which line key; reference counts hold, per key, the
number of its documents and the largest of them, exactly. Keys are dealt over shards by their digest, and each shard
has a cuckoo filter of its repeated keys. Inserting and deleting documents write signed postings, recount the keys
they touch, and add to or take from the filters the keys that became or ceased to be repeated, so any deletion
restores the state without the document.

Cleaning asks the filters which postings can matter (when all filters together are small enough to send to every
task; otherwise all postings go on), confirms these against the exact counts, and rewrites the documents.

Defined results: a null text is one empty line. A null id counts as the smallest id. Rows that repeat an id are one
document for counting, and each is cleaned. An empty table gives an empty table. Columns that are not named in
``carry`` are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import NO_ID, SEPARATORS, arrow_map, work_path
from .cuckoo import CuckooFilter

LEAST_LENGTH = 20
LEAST_DOCS = 3
SHARDS = 64
#: Filters are sent to all tasks up to this size.
MOST_FILTER_BYTES = 64 << 20

REFS = "key binary, refs bigint, last bigint"
FILTERS = "shard int, filter binary"


def line_key(line: str, least: int = LEAST_LENGTH) -> bytes | None:
    """Digest of the stripped line in lower case (A-Z only), or None if it is short."""
    line = line.strip(SEPARATORS)
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass").lower()) if len(line) >= least else None


def known_id():
    return F.coalesce(F.col("doc_id"), F.lit(NO_ID))


def postings(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(key, id) for each distinct key of each row."""

    def rows(batch: dict) -> dict:
        out = {"key": [], "id": []}
        for doc_id, text in zip(batch["id"], batch["text"]):
            keys = {k for k in (line_key(x, least) for x in (text or "").split("\n")) if k}
            out["key"] += keys
            out["id"] += [doc_id] * len(keys)
        return out

    return arrow_map(docs.select(known_id().alias("id"), "text"), rows, "key binary, id bigint")


def shard_of(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


class LineIndex:
    """The index of the lines of some documents; see the module."""

    def __init__(self, spark: SparkSession, least: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS, shards: int = SHARDS):
        self.spark, self.least, self.least_docs, self.shards = spark, least, least_docs, shards
        self.path, self.version = work_path(spark, "line-index"), 0
        self.postings = self.refs = self.filters = None

    def _store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{self.version}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._change(postings(docs, self.least).withColumn("sign", F.lit(1)))

    def delete(self, ids: DataFrame) -> LineIndex:
        """Forget the documents whose ``doc_id`` is in ``ids``."""
        gone = ids.select(known_id().alias("id")).distinct()
        held = self.postings.groupBy("key", "id").agg(F.sum("sign").alias("sign")).filter("sign > 0")
        return self._change(held.join(gone, "id", "left_semi").select("key", "id", (-F.col("sign")).alias("sign")))

    def _change(self, signed: DataFrame) -> LineIndex:
        self.version += 1
        signed = self._store(signed.withColumn("sign", F.col("sign").cast("bigint")), "postings")
        if self.refs is None:
            self.postings, before = signed, self.spark.createDataFrame([], REFS)
            touched = signed
        else:
            self.postings = self.postings.unionByName(signed)
            keys = signed.select("key").distinct()
            touched, before = self.postings.join(keys, "key", "left_semi"), self.refs.join(keys, "key", "left_semi")
        held = touched.groupBy("key", "id").agg(F.sum("sign").alias("n")).filter("n > 0")
        counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.max("id").alias("last"))
        counts = self._store(counts, "counts")
        repeated = F.col("refs") >= self.least_docs
        now, then = counts.filter(repeated).select("key"), before.filter(repeated).select("key")
        if self.refs is None:
            turned = now.withColumn("put", F.lit(True))
            self.refs = counts
        else:
            turned = now.join(then, "key", "left_anti").withColumn("put", F.lit(True)).unionByName(
                then.join(now, "key", "left_anti").withColumn("put", F.lit(False))
            )
            self.refs = self._store(self.refs.join(keys, "key", "left_anti").unionByName(counts), "refs")
        self._update_filters(turned.withColumn("shard", shard_of(self.shards)))
        return self

    def _update_filters(self, turned: DataFrame) -> None:
        old = self.filters if self.filters is not None else self.spark.createDataFrame([], FILTERS)
        kept = self.refs.filter(F.col("refs") >= self.least_docs).select("key").withColumn("shard", shard_of(self.shards))

        def change(key, filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            if len(filters):
                made = CuckooFilter.load(filters["filter"].iloc[0])
                made.remove(list(keys["key"][~keys["put"]]))
                if not made.add(list(keys["key"][keys["put"]])):
                    return pd.DataFrame({"shard": [key[0]], "filter": [None]})
            else:
                made = CuckooFilter.of(list(keys["key"][keys["put"]]))
            return pd.DataFrame({"shard": [key[0]], "filter": [made.dump()]})

        made = old.groupBy("shard").cogroup(turned.groupBy("shard")).applyInPandas(change, FILTERS)
        made = self._store(made, "filters")
        if not made.filter("filter is null").isEmpty():  # outgrown: the shard's filter is made anew from the exact keys
            full = made.filter("filter is null").select("shard")

            def anew(key, keys: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame({"shard": [key[0]], "filter": [CuckooFilter.of(list(keys["key"])).dump()]})

            larger = kept.join(full, "shard", "left_semi").groupBy("shard").applyInPandas(anew, FILTERS)
            made = self._store(made.filter("filter is not null").unionByName(larger), "filters-anew")
        self.filters = made

    def likely_repeated(self) -> DataFrame:
        """The held postings whose key passes its shard's filter."""
        rows = self.postings.withColumn("shard", shard_of(self.shards))
        size = self.filters.agg(F.sum(F.length("filter")).alias("b")).first()["b"] or 0
        if size > MOST_FILTER_BYTES:
            return rows.drop("shard")
        filters = self.spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in self.filters.collect()})

        def probe(batch: dict) -> dict:
            by_shard: dict[int, list[int]] = {}
            for i, shard in enumerate(batch["shard"]):
                by_shard.setdefault(shard, []).append(i)
            hits = []
            for shard, places in by_shard.items():
                if shard in filters.value:
                    found = CuckooFilter.load(filters.value[shard]).contains([batch["key"][i] for i in places])
                    hits += [i for i, hit in zip(places, found) if hit]
            return {c: [batch[c][i] for i in hits] for c in ("key", "id", "sign")}

        return arrow_map(rows, probe, "key binary, id bigint, sign bigint")

    def clean(self, docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        """doc_id, the carried columns, n_lines, n_dropped and the text of the lines that stay."""
        repeated = self.refs.filter(F.col("refs") >= self.least_docs).select("key", "last")
        drops = self.likely_repeated().join(repeated, "key").filter("id != last")
        drops = drops.groupBy("id", "key").agg(F.sum("sign").alias("n")).filter("n > 0")
        drops = drops.groupBy("id").agg(F.collect_list("key").alias("keys")).withColumnRenamed("id", "_id")
        rest = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(True)
        rows = docs.select("doc_id", "text", rest.alias("rest"), known_id().alias("_id")).join(drops, "_id", "left")
        least = self.least

        def rewrite(batch: dict) -> dict:
            out = {"doc_id": batch["doc_id"], "rest": batch["rest"], "n_lines": [], "n_dropped": [], "text": []}
            for text, keys in zip(batch["text"], batch["keys"]):
                lines = (text or "").split("\n")
                gone = set(keys or ())
                kept = [x for x in lines if line_key(x, least) not in gone] if gone else lines
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(len(lines) - len(kept))
                out["text"].append("\n".join(kept))
            return out

        schema = f"doc_id bigint, rest {rows.schema['rest'].dataType.simpleString()}, n_lines bigint, n_dropped bigint, text string"
        made = arrow_map(rows.select("doc_id", "text", "rest", "keys"), rewrite, schema)
        return made.select("doc_id", *[f"rest.{c}" for c in carry], "n_lines", "n_dropped", "text")


def dedup_lines(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Index the documents and clean them."""
    return LineIndex(docs.sparkSession).insert(docs).clean(docs, carry)
