"""Mixing sources to target weights by Sainte-Laguë apportionment of token blocks.

A source's target is its weighted share of the mix, capped by what its documents may be repeated; what a cap cuts off
is shared again by weight. The mix is a number of equal blocks of words. The blocks go to the sources, and each
source's blocks to its shards, by highest quotients ``votes / (2 * seats + 1)``. A shard lays its documents end to end
in a seeded order, closes them to a ring, and takes its blocks from a seeded place on.

Everything is DataFrame work. Only ids, sources and word counts are shuffled; the text is read once.

Defined results: a null text has no words and takes none. A null source is a source of its own, last in the order. A
null id is ordered as an empty string. Repeated rows are documents of their own. An empty table gives an empty table.
Columns other than ``doc_id``, ``text`` and ``source`` are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .common import cut_lineage, md5_number, word_count

#: Shards hold about this many words until a source has the most shards it may have; then they grow.
SHARD_WORDS = 1 << 17
MOST_SHARDS = 1 << 16
BLOCK_WORDS = 8
#: A word with the white space before it.
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def source_targets(per_source: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """Add ``target`` to (source, source_size).

    Sources sorted by the level at which their cap binds form two runs: the capped ones, then those that get
    ``weight * level``. The level is what the caps leave over, divided by the weights of the rest.
    """
    everything = Window.partitionBy()
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * most
    rows = per_source.withColumn("weight", weight)
    by_level = everything.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(cap).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * share - before) / rest)
    rows = rows.withColumn("capped", F.col("weight") * F.col("level") >= cap)
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("weight") * level)
    return rows.withColumn("target", target).select("source", "source_size", "target")


def apportion(parties: DataFrame, group: list[str], party: list[str]) -> DataFrame:
    """Sainte-Laguë: give ``seats`` of a group to its parties by highest quotients.

    ``parties`` has ``votes``, ``most`` (seats a party can hold) and ``seats`` (of the whole group). Seats that every
    divisor near the right one gives are counted in closed form, so that only a few quotients of each party are
    ranked. Ties go to the party that sorts first. Seats that a full party cannot take pass to the others; seats that
    these cannot take either are not given.
    """
    whole = Window.partitionBy(*group)
    k, votes = F.count(F.lit(1)).over(whole), F.sum("votes").over(whole)

    def at(twice):
        return F.when((twice > 0) & (votes > 0), F.floor((F.col("votes") * twice / votes + 1) / 2)).otherwise(0)

    rows = parties.withColumn("sure", F.least("most", at(2 * F.col("seats") - k)))
    rows = rows.withColumn("over", F.coalesce(F.col("votes") * F.col("seats") / F.nullif(votes, F.lit(0.0)), F.lit(0.0)) - F.col("most"))
    lost, free = F.sum(F.greatest(F.lit(0.0), "over")).over(whole), F.sum(F.when(F.col("over") <= 0, F.col("votes"))).over(whole)
    more = F.ceil(F.coalesce(4 * lost * votes / F.nullif(free, F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("top", F.greatest("sure", F.least(F.col("most"), at(2 * F.col("seats") + 5 * k + more) + 1)))
    rows = rows.withColumn("open", F.col("seats") - F.sum("sure").over(whole))
    seat = F.explode_outer(F.when(F.col("top") > F.col("sure"), F.sequence(F.col("sure"), F.col("top") - 1)))
    ranked = rows.withColumn("seat", seat).withColumn("quotient", F.col("votes") / (2 * F.col("seat") + 1))
    order = whole.orderBy(F.col("quotient").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in party], "seat")
    ranked = ranked.withColumn("won", (F.row_number().over(order) <= F.col("open")) & F.col("seat").isNotNull())
    return ranked.groupBy(*group, *party).agg((F.first("sure") + F.count_if("won")).alias("quota"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: str = "mix",
    block: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    row: str | None = None,
) -> DataFrame:
    """What the mix takes of each document, one row per row of ``docs``.

    ``row`` names a column of numbers that are unique to the rows; it is returned, too, and deals out null ids.

    Returns doc_id, size, source, source_size, target, taken, and what ``taken`` consists of: ``copies`` whole copies,
    the words from ``from`` up to ``to``, and the first ``head`` words.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col(row)) if row else F.lit(""))))
    carried = [row] if row else []
    sized = docs.select(*carried, "doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"))
    sized = cut_lineage(sized, "mix-sizes")
    per_source = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    per_source = per_source.withColumn(
        "shards", F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("source_size") / shard_words)))
    )
    per_source = cut_lineage(per_source, "mix-sources")
    shard = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("shards")
    p = per_source.withColumnRenamed("source", "of")
    dealt = sized.join(p, F.col("source").eqNullSafe(F.col("of"))).withColumn("shard", shard).drop("of", "shards")

    sums = dealt.groupBy("source", "shard").agg(
        F.sum("size").alias("length"), F.first("target").alias("target"), F.first("source_size").alias("source_size")
    )
    sums = cut_lineage(sums.withColumn("most", F.floor(F.col("length") * most / block)), "mix-shards")
    of_source = sums.groupBy("source").agg(F.first("target").alias("votes"), F.sum("most").alias("most"))
    of_source = of_source.withColumn("seats", F.round(F.sum("votes").over(Window.partitionBy()) / block).cast("long"))
    source_quota = apportion(of_source, [], ["source"]).select(F.col("source").alias("of"), F.col("quota").alias("seats"))
    parties = sums.join(source_quota, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    parties = parties.withColumn("votes", F.col("length").cast("double"))
    quota = apportion(parties, ["source"], ["shard"])
    quota = quota.select(F.col("source").alias("of"), F.col("shard").alias("part"), "quota")

    in_shard = Window.partitionBy("source", "shard")
    order = in_shard.orderBy("key", "doc_id", "size", *carried).rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.withColumns({"end": F.sum("size").over(order), "length": F.sum("size").over(in_shard)})
    laid = laid.withColumn("start", F.col("end") - F.col("size"))
    laid = laid.join(quota, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("part")), "left")
    words = F.coalesce(F.col("quota"), F.lit(0)) * block
    place = md5_number(F.concat_ws(":", F.lit(seed), name, F.col("shard").cast("string")))
    length = F.greatest(F.col("length"), F.lit(1))
    laid = laid.withColumns(
        {
            "copies": F.floor(words / length),
            "ring_from": place % F.ceil(length / block) * block,
            "rest": words % length,
        }
    )
    ring_to = F.col("ring_from") + F.col("rest")
    low = F.greatest(F.col("start"), F.col("ring_from"))
    high = F.greatest(low, F.least(F.col("end"), ring_to))
    head = F.greatest(F.lit(0), F.least(F.col("end"), ring_to - F.col("length")) - F.col("start"))
    laid = laid.withColumns({"from": low - F.col("start"), "to": high - F.col("start"), "head": head})
    laid = laid.withColumn("taken", F.col("copies") * F.col("size") + F.col("to") - F.col("from") + F.col("head"))
    return laid.select(*carried, "doc_id", "size", "source", "source_size", "target", "taken", "copies", "from", "to", "head")


def taken_texts(docs: DataFrame, plan: DataFrame, row: str) -> DataFrame:
    """The rows of ``docs`` as often as ``plan`` (of ``mix``, with ``row``) takes them, each with the text it takes.

    A part of a text keeps the white space between its words; what lies before its first word goes, unless the part
    begins with the text.
    """
    chosen = plan.filter("taken > 0").select(row, "size", "copies", "from", "to", "head")
    rows = docs.join(chosen.withColumnsRenamed({c: f"_{c}" for c in ("size", "copies", "from", "to", "head")}), row)
    whole = F.struct(F.lit(0).cast("bigint").alias("low"), F.col("_size").alias("high"))
    part = F.struct(F.col("_from").alias("low"), F.col("_to").alias("high"))
    head = F.struct(F.lit(0).cast("bigint").alias("low"), F.col("_head").alias("high"))
    takes = F.concat(F.array_repeat(whole, F.col("_copies").cast("int")), F.array(part, head))
    rows = rows.withColumn("_take", F.explode(F.filter(takes, lambda x: x["high"] > x["low"])))
    low, high = F.col("_take.low"), F.col("_take.high")
    words = F.slice(F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0)), (low + 1).cast("int"), (high - low).cast("int"))
    cut = F.array_join(words, "")
    cut = F.when(low > 0, F.regexp_replace(cut, r"^[\x20\x09-\x0D]+", "")).otherwise(cut)
    text = F.when((low == 0) & (high == F.col("_size")), F.col("text")).otherwise(cut)
    return rows.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])
