"""As-of join: each row with the newest row of another table at or before its time.

Time is cut into blocks. Within a block, rows of both tables are put in order once; what holds when a block begins is carried
to it over the blocks between, which need no rows of their own. The carry is found in two steps, over the blocks of a
day and over the days of a key, from one row per key and block that either table has. So no task sees all rows of a key,
and the left rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

DAY = 86400


def asof(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], name: str,
    block_seconds: int = 10,
) -> DataFrame:
    """The left rows with a struct ``name`` of ``values``, null where nothing held yet.

    A right row holds from its own time on, up to the next one of its key; of
    right rows of one time the greatest counts.  A null key is a key of its
    own.  Rows without a time hold for nothing and get nothing.
    """

    def block(time: str) -> Column:
        return F.floor(F.unix_seconds(time) / block_seconds)

    day = F.floor(F.col("_block") * block_seconds / DAY)
    value = F.struct(*[F.col(v) for v in values])
    held = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("_ts"), value.alias("_value"), block(right_time).alias("_block"))
    asked = left.where(F.col(left_time).isNotNull()).select(*keys, block(left_time).alias("_block")).distinct()
    newest = F.max(F.when(F.col("_ts").isNotNull(), F.struct("_ts", "_value")))["_value"]
    marks = (
        held.unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
        .groupBy(*keys, "_block")
        .agg(newest.alias("_last"), F.max("_asked").alias("_asked"))
        .withColumn("_day", day)
    )
    until = W.unboundedPreceding, -1
    in_day = W.partitionBy(*keys, "_day").orderBy("_block").rowsBetween(*until)
    over_days = W.partitionBy(*keys).orderBy("_day").rowsBetween(*until)
    days = marks.groupBy(*keys, "_day").agg(F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_block"))).alias("_last"))
    days = days.select(*keys, "_day", F.last("_last", True).over(over_days).alias("_earlier"))
    same_day = [F.col(f"m.{k}").eqNullSafe(F.col(f"d.{k}")) for k in (*keys, "_day")]
    carried = marks.withColumn("_in_day", F.last("_last", True).over(in_day)).alias("m").join(days.alias("d"), same_day)
    carried = carried.where("m._asked").select(
        *[f"m.{k}" for k in keys], "m._block", F.coalesce("m._in_day", "d._earlier").alias("_value"), F.lit(0).alias("_kind")
    )
    rows = left.select(*keys, F.col(left_time).alias("_ts"), block(left_time).alias("_block"), F.struct(*left.columns).alias("_row"), F.lit(2).alias("_kind"))
    both = rows.unionByName(held.withColumn("_kind", F.lit(1)), allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    order = W.partitionBy(*keys, "_block").orderBy(F.col("_ts").asc_nulls_first(), "_kind", "_value")
    found = both.withColumn(name, F.last("_value", True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    found = found.where("_kind = 2").withColumn(name, F.when(F.col("_ts").isNotNull(), F.col(name)))
    return found.select("_row.*", name)
