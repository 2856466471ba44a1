"""Running counts and greedy time windows that stay whole under skew.

A window function over a hot key sends all of its rows to one task.  The two
operators here work on pre-aggregated pieces of a key instead, and both are
exact: results do not depend on how a key is cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

# A piece holds at most 2**PIECE_BITS rows, because log_seq is unique.
PIECE_BITS = 16
DAY = 86400


def piece_columns() -> dict[str, Column]:
    """Order-preserving cut of a key: day, second, then arrival-number block."""
    second = F.unix_seconds("ts")
    return {
        "pc_day": F.floor(second / DAY),
        "pc_sec": second,
        "pc_block": F.shiftright("log_seq", PIECE_BITS),
    }


PIECE = ["pc_day", "pc_sec", "pc_block"]


def piece_counts(rows: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Sums of the measures per piece of a key (combined before the shuffle)."""
    return (
        rows.withColumns(piece_columns())
        .groupBy(*keys, *PIECE)
        .agg(*[F.sum(expr.cast("long")).alias(name) for name, expr in measures.items()])
    )


def piece_offsets(pieces: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Sum of each measure over all earlier pieces of the key, as ``<name>_before``.

    Two levels: over the days of a key, and over the pieces of one day.
    """
    by_key = W.partitionBy(*keys).orderBy("pc_day").rowsBetween(W.unboundedPreceding, -1)
    by_day = W.partitionBy(*keys, "pc_day").orderBy("pc_sec", "pc_block").rowsBetween(W.unboundedPreceding, -1)
    days = pieces.groupBy(*keys, "pc_day").agg(*[F.sum(n).alias(n) for n in names])
    days = days.select(
        *keys, "pc_day", *[F.coalesce(F.sum(n).over(by_key), F.lit(0)).alias(f"{n}_day") for n in names]
    )
    inside = pieces.select(
        *keys, *PIECE, *[F.coalesce(F.sum(n).over(by_day), F.lit(0)).alias(f"{n}_in") for n in names]
    )
    return inside.join(days, [*keys, "pc_day"]).select(
        *keys, *PIECE, *[(F.col(f"{n}_in") + F.col(f"{n}_day")).alias(f"{n}_before") for n in names]
    )


def running_counts(rows: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Add to every row the measures' running sums within its key.

    Rows are ordered by (ts, log_seq).  The rows are shuffled once, by piece.
    """
    names = list(measures)
    offsets = piece_offsets(piece_counts(rows, keys, measures), keys, names)
    cut = rows.withColumns(piece_columns())
    inner = W.partitionBy(*keys, *PIECE).orderBy("ts", "log_seq").rowsBetween(W.unboundedPreceding, 0)
    joined = cut.join(offsets, [*keys, *PIECE])
    return joined.withColumns(
        {n: F.col(f"{n}_before") + F.sum(expr.cast("long")).over(inner) for n, expr in measures.items()}
    ).drop(*PIECE, *[f"{n}_before" for n in names])


def greedy_windows(seconds: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Windows that open at a key's first event and then at each first event
    ``length`` seconds or more after the last opening.

    Input: rows with the keys and ``sec``.  Output: one row per distinct
    (keys, sec) with ``open_sec``, the opening its window started at.

    A key's seconds are gathered by day, so a group never exceeds the seconds
    of a day.  One day bears on the next only through where the next window
    may open (``carry``: 0 to ``length`` seconds into the day), and only when
    events lie near midnight on both sides.  Such days are tabulated for
    every carry in parallel, chained, and then all days are resolved in
    parallel.
    """
    if length > DAY:
        raise ValueError("window length is at most one day")
    days = (
        seconds.select(*keys, "sec", F.floor(F.col("sec") / DAY).alias("day"))
        .groupBy(*keys, "day")
        .agg(F.array_sort(F.collect_set("sec")).alias("secs"))
    )
    begin = F.col("day") * DAY
    resolved = days.join(_carries(days, keys, length), [*keys, "day"], "left").withColumn(
        "carry", F.coalesce("carry", F.lit(0))
    )
    start = F.struct(
        (begin + F.col("carry")).alias("reach"),
        F.when(F.col("carry") > 0, F.array(begin + F.col("carry") - length))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("opens"),
    )

    def step(acc, sec):
        opened = F.struct((sec + length).alias("reach"), F.array_append(acc["opens"], sec).alias("opens"))
        return F.when(sec >= acc["reach"], opened).otherwise(acc)

    # openings are at least ``length`` apart, so a slot of that length holds at most one
    by_slot = F.map_from_entries(
        F.transform("opens", lambda o: F.struct(F.floor(o / length).alias("slot"), o.alias("open")))
    )
    slot = F.floor(F.col("sec") / length)
    own = F.try_element_at("slots", slot)
    return (
        resolved.withColumn("opens", F.aggregate("secs", start, step)["opens"])
        .select(*keys, by_slot.alias("slots"), F.explode("secs").alias("sec"))
        .select(*keys, "sec", F.when(own <= F.col("sec"), own).otherwise(F.try_element_at("slots", slot - 1)).alias("open_sec"))
    )


def _carries(days: DataFrame, keys: list[str], length: int) -> DataFrame:
    """(keys, day, carry) of the days a window of the day before can reach into."""
    in_order = W.partitionBy(*keys).orderBy("day")
    ends = days.select(*keys, "day", F.element_at("secs", 1).alias("first"), F.element_at("secs", -1).alias("last"))
    begin = F.col("day") * DAY
    reached = (
        (F.lag("day").over(in_order) == F.col("day") - 1)
        & (F.lag("last").over(in_order) + length > begin)
        & (F.col("first") < begin + length)
    )
    ends = ends.withColumn("reached", F.coalesce(reached, F.lit(False)))
    ends = ends.withColumn("reaches", F.coalesce(F.lead("reached").over(in_order), F.lit(False)))
    chained = ends.where("reached or reaches").select(*keys, "day", "reached").join(days, [*keys, "day"])

    @F.pandas_udf("array<int>")
    def table(day: pd.Series, secs: pd.Series) -> pd.Series:
        out = []
        for d, s in zip(day, secs):
            s, start = np.asarray(s), int(d) * DAY
            reach = start + np.arange(length + 1)
            while True:
                pos = np.searchsorted(s, reach)
                live = pos < len(s)
                if not live.any():
                    break
                reach = np.where(live, s[np.minimum(pos, len(s) - 1)] + length, reach)
            out.append(np.maximum(reach - start - DAY, 0).astype("int32"))
        return pd.Series(out)

    def step(acc, cur):
        carry = F.when(cur["reached"], acc["carry"]).otherwise(F.lit(0))
        return F.struct(
            F.element_at(cur["exits"], carry + 1).alias("carry"),
            F.array_append(acc["out"], F.struct(cur["day"].alias("day"), carry.alias("carry"))).alias("out"),
        )

    start = F.struct(F.lit(0).alias("carry"), F.array().cast("array<struct<day:bigint,carry:int>>").alias("out"))
    return (
        chained.select(*keys, "day", "reached", table("day", "secs").alias("exits"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("day", "reached", "exits"))).alias("chain"))
        .select(*keys, F.inline(F.aggregate("chain", start, step)["out"]))
        .where(F.col("carry") > 0)
    )


def running_number(rows: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Number all rows 1, 2, ... in one global order, after ``start``.

    ``order`` begins with a timestamp and ends with a text id that spreads
    evenly (a hash).  Rows are counted per hour and per (second, first
    characters of the id), so that no task sees more than one such piece.
    """
    ts, id_ = order[0], order[-1]
    cut = rows.withColumns(
        {
            "nm_hour": F.floor(F.unix_seconds(ts) / 3600),
            "nm_sec": F.unix_seconds(ts),
            "nm_id": F.substring(F.col(id_), 1, 2) if len(order) == 2 else F.lit(""),
        }
    )
    pieces = cut.groupBy("nm_hour", "nm_sec", "nm_id").agg(F.count(F.lit(1)).alias("n"))
    hours = pieces.groupBy("nm_hour").agg(F.sum("n").alias("n"))
    hours = hours.select(
        "nm_hour",
        F.coalesce(F.sum("n").over(W.orderBy("nm_hour").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("h0"),
    )
    in_hour = W.partitionBy("nm_hour").orderBy("nm_sec", "nm_id").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select("nm_hour", "nm_sec", "nm_id", F.coalesce(F.sum("n").over(in_hour), F.lit(0)).alias("p0"))
    rank = F.row_number().over(W.partitionBy("nm_hour", "nm_sec", "nm_id").orderBy(*order))
    return (
        cut.join(pieces, ["nm_hour", "nm_sec", "nm_id"])
        .join(hours, "nm_hour")
        .withColumn(name, F.lit(start) + F.col("h0") + F.col("p0") + rank)
        .drop("nm_hour", "nm_sec", "nm_id", "h0", "p0")
    )


def exact_ranks(values: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Exact order statistics of a bigint column per key.

    ``ranks`` maps an output name to a 1-based rank given the group size
    ``n``.  Values are counted in blocks of 2**20; only the blocks a rank
    falls into are then counted value by value.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    counted = counted.withColumn("blk", F.shiftright(value, 20))
    blocks = counted.groupBy(*keys, "blk").agg(F.sum("c").alias("bc"))
    over_key = W.partitionBy(*keys)
    upto = over_key.orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        *keys, "blk", "bc",
        F.sum("bc").over(over_key).alias("n"),
        F.coalesce(F.sum("bc").over(upto), F.lit(0)).alias("b0"),
    )
    wanted = blocks.select(
        *keys, "blk", "b0", "n", "bc",
        F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("r")) for k, r in ranks.items()])).alias("w"),
    ).where((F.col("w.r") > F.col("b0")) & (F.col("w.r") <= F.col("b0") + F.col("bc")))
    cum = F.sum("c").over(W.partitionBy(*keys, "blk").orderBy(value))
    fine = (
        counted.join(wanted.select(*keys, "blk").distinct(), [*keys, "blk"], "left_semi")
        .withColumn("hi", cum)
        .withColumn("lo", F.col("hi") - F.col("c"))
    )
    picked = fine.join(wanted, [*keys, "blk"]).where(
        (F.col("w.r") - F.col("b0") > F.col("lo")) & (F.col("w.r") - F.col("b0") <= F.col("hi"))
    )
    return picked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("w.name") == k, F.col(value))).alias(k) for k in ranks],
    )
