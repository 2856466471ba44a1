"""Sharding by jump consistent hashing, in DataFrame functions only.

A row's shard depends on its key and the number of shards alone: the MD5 of the key as text seeds a 64-bit linear
congruential generator, whose numbers say at which shard counts the key jumps to the newest shard. The last jump below
the number of shards is the shard. There is no ring table, and one more shard takes rows only into itself.

The generator's products modulo 2**64 are built from 16-bit halves, as Spark's own bigint product would overflow. A jump
goes ahead by one shard at least, so ``shards`` steps always suffice; they are taken in blocks, which are skipped once
a key has jumped beyond the last shard.

Slots number the rows of a shard without a task that holds a shard: equal rows are counted where they are read, the
counts are cut into blocks by key and content, the blocks' totals give their first slots, and a window inside a block
gives the rest. Groups of equal rows are spread again before they are written out row by row.

Defined results: a null text counts as no bytes (size 1, CRC of nothing, which is 0). A null key is a key of its own, so
all its rows share one shard. Rows with equal key and text get different slots; rows are ordered inside a shard by
block, key (null first), size and CRC, so reruns agree. An empty table gives an empty table. Other columns of
any name are not read by ``manifest`` and pass through ``with_shard`` and ``write_shards``; only one that has the name asked
for the shard is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut_lineage

#: Multiplier of the generator and the range of its upper bits.
MULTIPLIER, RANGE = 2862933555777941757, float(2**31)
LOW = 2**32 - 1
STEPS = 16
BLOCK_ROWS = 1 << 16
CHUNK_ROWS = 1 << 12


def key_halves(key: Column) -> tuple[Column, Column]:
    """Upper and lower 32 bits of the 64-bit seed of a key; null seeds like the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return tuple(F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint") for start in (1, 9))


def low_product(number: Column, factor: int) -> Column:
    """``number`` times ``factor`` (both below 2**32), right modulo 2**32 and below 2**49."""
    upper = (F.shiftright(number, 16) * F.lit(factor)).bitwiseAND(F.lit(0xFFFF))
    return number.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor) + F.shiftleft(upper, 16)


def step(state: Column) -> Column:
    """The generator's next number, as halves."""
    m_high, m_low = MULTIPLIER >> 32, MULTIPLIER & LOW
    high, low = state["high"], state["low"]
    first = low_product(low, m_low) + F.lit(1)
    carry = F.shiftright(first, 32) + F.shiftright(F.shiftright(low, 16) * F.lit(m_low), 16)
    upper = carry + low_product(high, m_low) + low_product(low, m_high)
    return F.struct(upper.bitwiseAND(F.lit(LOW)).alias("high"), first.bitwiseAND(F.lit(LOW)).alias("low"))


def jumps(key: Column, shards: int) -> Column:
    """A struct of ``shard`` and ``grown``: the shard among ``shards`` and among one more."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def jump(state: Column) -> Column:
        def landed(number: Column) -> Column:
            target = F.floor((state["at"] + 1) * (F.lit(RANGE) / (F.shiftright(number["high"], 1) + 1)))
            return F.struct(
                number["high"].alias("high"),
                number["low"].alias("low"),
                target.alias("at"),
                F.when(target < shards, target).otherwise(state["shard"]).alias("shard"),
                F.when(target < shards + 1, target).otherwise(state["grown"]).alias("grown"),
            )

        return F.transform(F.array(step(state)), landed)[0]

    def unless_done(state: Column, then) -> Column:
        return F.when(state["at"] > shards, state).otherwise(then(state))

    def block(state: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), state, lambda s, _: unless_done(s, jump))

    high, low = key_halves(key)
    zero = F.lit(0).cast("bigint")
    start = F.struct(high.alias("high"), low.alias("low"), zero.alias("at"), zero.alias("shard"), zero.alias("grown"))
    blocks = F.sequence(F.lit(1), F.lit(-(-(shards + 1) // STEPS)))
    end = F.aggregate(blocks, start, lambda s, _: unless_done(s, block))
    return F.transform(F.array(end), lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))[0]


def with_shard(docs: DataFrame, shards: int, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """The rows with their shard in column ``name``; nothing is shuffled."""
    return docs.withColumn(name, jumps(F.col(key), shards)["shard"])


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id", name: str = "shard", records: int = 1_000_000) -> None:
    """One Parquet folder per shard below ``path``, written where the rows are read; no file has over ``records`` rows."""
    with_shard(docs, shards, key, name).write.option("maxRecordsPerFile", records).partitionBy(name).parquet(path)


def manifest(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Key, size, CRC, shard, slot and the shard under one more shard, for every row."""
    blocks = 1 + docs.count() // block_rows
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    counted = rows.groupBy("key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    counted = cut_lineage(counted, "shard-counts")
    counted = counted.withColumn("to", jumps(F.col("key"), shards)).select("*", "to.*").drop("to")
    counted = counted.withColumn("block", (key_halves(F.col("key"))[1] + F.col("text_crc32")) % blocks)
    inside = Window.partitionBy("shard", "block").orderBy(F.col("key").asc_nulls_first(), "size", "text_crc32")
    before = Window.partitionBy("shard").orderBy("block")
    placed = counted.withColumn("low", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    totals = counted.groupBy("shard", "block").agg(F.sum("n").alias("total"))
    totals = totals.select("shard", "block", (F.sum("total").over(before) - F.col("total")).alias("base"))
    placed = placed.join(totals, ["shard", "block"]).withColumn("low", F.col("base") + F.col("low"))
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(CHUNK_ROWS).cast("bigint")))
    spread = placed.withColumn("first", chunk).repartition("shard", "low", "first")
    last = F.least(F.col("first") + CHUNK_ROWS, F.col("n")) - 1
    out = spread.withColumn("slot", F.explode(F.sequence(F.col("low") + F.col("first"), F.col("low") + last)))
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", F.col("grown").alias("grown_shard"))
