"""Jump consistent hashing against a plain loop."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lanternlog.llm import sharding


def jump(key, shards):
    seed = int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16], 16)
    last, place = -1, 0
    while place < shards:
        last = place
        seed = (seed * 2862933555777941757 + 1) % 2**64
        place = int((last + 1) * (2.0**31 / ((seed >> 33) + 1)))
    return last


@pytest.mark.parametrize("shards", [1, 2, 8, 100])
def test_jumps(spark, shards):
    keys = spark.range(-300, 300).select(F.when(F.col("id") != 5, F.col("id")).alias("key"))
    for row in keys.select("key", sharding.jumps(F.col("key"), shards).alias("to")).collect():
        assert (row.to.shard, row.to.grown) == (jump(row.key, shards), jump(row.key, shards + 1))
        assert row.to.grown in (row.to.shard, shards)


def test_no_shards(spark):
    with pytest.raises(ValueError):
        sharding.jumps(F.col("key"), 0)


@pytest.mark.parametrize("block_rows", [2, 1 << 16])
def test_manifest(docs, rows, block_rows):
    got = sharding.manifest(docs, 8, block_rows=block_rows).collect()
    want = collections.Counter()
    for r in rows:
        body = (r["text"] or "").encode()
        want[r["doc_id"], len(body) + 1, zlib.crc32(body), "key", jump(r["doc_id"], 8), jump(r["doc_id"], 9)] += 1
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.manifest(docs.repartition(2), 8, block_rows=block_rows).collect()
    assert collections.Counter(got) == collections.Counter(again)


def test_many_equal_rows(spark):
    """More equal rows than fit a chunk, beside others of the shard."""
    docs = spark.range(10_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    slots = collections.defaultdict(list)
    for r in sharding.manifest(docs, 3).collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 10_000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_table(nothing):
    assert sharding.manifest(nothing).count() == 0


def test_written_shards(docs, spark, tmp_path):
    sharding.write_shards(docs, f"{tmp_path}/shards", 4, name="to_shard")
    read = spark.read.parquet(f"{tmp_path}/shards")
    assert read.count() == docs.count()
    assert all(r.to_shard == jump(r.doc_id, 4) for r in read.select("doc_id", "to_shard").collect())
