"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set is its hashed word shingles; its sketch the ``k`` smallest hashes. Equal sets form a class, and only
classes are compared. Inverted lists of the ``index`` smallest values give candidates. The bottom-k sketch of a pair's
union estimates the similarity and filters far below the threshold; exact Jaccard on the full sets decides.

A class also has a parity sketch: one bit for each of ``BITS`` cells, set if an odd number of its values fall there.
Two classes differ in at least as many values as their parities in bits, so a pair with too many such bits is below the
threshold for certain, whatever its size; most pairs of a group whose copies have several edits each end here. Of the
lists that two classes share, only the one of the smallest value compares them.

Lists are worked off in rounds instead of pair by pair: a few leaders of each list are compared with the list's other
classes, links are joined to components, and the next leaders come from outside the list's largest component. A round
reads only the lists that have leaders: once all classes outside the largest component have led, all pairs are compared. Classes
that a component already joins are not compared again, so a group of thousands of copies costs one pass over its
lists, while two classes in different components are always compared. A class of a long list that holds many values of
its own reaches only smaller sets, by the threshold; pairs out of reach, and classes that reach nothing, are left out.
The first leader of a list is the class with the fewest values of its own, the likely source of the copies. Values that very many classes retain (shared
passages) are looked at only for classes that consist mostly of them: by the threshold, any other class shares a rarer
value of its sketch with each of its partners, and is found there.

A pair is looked at if it shares three of the ``index`` values (fewer in small sets). At the threshold, it fails that
with probability below 2e-8, and the estimate's bound with probability below 1e-8; all else is exact.

Defined results: a null or wordless text has an empty set and links with nothing. A null id sorts before all others.
Rows that repeat an id are texts of their own. An empty table gives an empty table. Columns other than ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import NO_ID, arrow_map, cut_lineage, discard, release
from .components import components
from .shingles import shingle_set

WORDS = 5
PERCENT = 80
SKETCH = 64
INDEX = 16
#: Lists of at most this many classes are compared whole in the second round.
SHORT = 32
#: Share of a union sketch that must be common before sets are compared; 6 standard deviations below 0.8.
ESTIMATE = 0.5
#: Cells of the parity sketch.
BITS = 512


def sketches(docs: DataFrame, words: int, k: int) -> DataFrame:
    """One row per row of ``docs``: id, row, mark, n, node (digest of the set), sketch and parity."""

    def rows(batch: dict) -> dict:
        out = {"doc_id": batch["doc_id"], "row": batch["row"], "mark": batch["mark"], "n": [], "node": [], "sketch": [], "parity": []}
        for text in batch["text"]:
            found = shingle_set(text, words)
            out["n"].append(len(found))
            out["node"].append(digest(found) if len(found) else None)
            out["sketch"].append(found[:k].view(np.int64))
            out["parity"].append(parity(found))
        return out

    schema = "doc_id bigint, row bigint, mark binary, n bigint, node binary, sketch array<bigint>, parity array<bigint>"
    return arrow_map(docs.select("doc_id", "row", "mark", "text"), rows, schema)


def parity(found: np.ndarray) -> np.ndarray:
    cells = np.bincount((found % np.uint64(BITS)).astype(np.int64), minlength=BITS)
    return np.packbits(cells % 2 == 1).view(np.int64)


def unshared(s: Column, k: int, percent: int) -> Column:
    """So many values of a sketch of ``s`` values are never all missing from a partner's sketch."""
    exact = F.floor(s * (100 - percent) / 100) + 1
    return F.when(s * 100 <= k * percent, exact).otherwise(F.lit(36 * k // 64))


def reach(n: Column, own: Column | int, percent: int) -> Column:
    """The largest set that one of ``n`` values, ``own`` of which no other has, can be similar enough to."""
    return F.floor((n - own) * (100 + percent) / percent - n)


def shared(rows: DataFrame) -> DataFrame:
    """The rows whose value two classes hold, with the number of its classes."""
    return rows.join(rows.groupBy("value").count().filter("count > 1"), "value")


def inverted_lists(classes: DataFrame, plain: DataFrame, texts: DataFrame, words: int, k: int, percent: int) -> DataFrame:
    """Lists (value, node, n, reach) of at least two classes, from those of the index (``plain``)."""
    short, long = plain.filter(F.col("count") <= SHORT), plain.filter(F.col("count") > SHORT)
    if long.isEmpty():
        return short.select("value", "node", "n", reach(F.col("n"), 0, percent).alias("reach"))
    wide = classes.join(long.select("node").distinct(), "node", "left_semi")
    wide = wide.select("node", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    wide = cut_lineage(shared(wide), "wide-lists")
    common = wide.filter(F.col("count") > SHORT).groupBy("node").agg(F.count(F.lit(1)).alias("common"), F.first("s").alias("s"), F.first("n").alias("n"))
    mostly = common.filter(F.col("s") - F.col("common") < unshared(F.col("s"), k, percent)).select("node", "n")
    mostly = cut_lineage(mostly, "mostly-common")
    own = set_values(texts.join(mostly.select("node"), "node"), words).groupBy("value")
    own = own.agg(F.count(F.lit(1)).alias("count"), F.min("node").alias("node"))
    own = own.filter("count = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    far = reach(F.col("n"), F.coalesce("own", F.lit(0)), percent)
    viable = mostly.join(own, "node", "left").select("node", far.alias("reach"), (F.col("n") * percent).alias("least"))
    viable = viable.filter(F.col("reach") * 100 >= F.col("least")).drop("least")
    rest = long.select("value", "node", "n").join(viable, "node").select("value", "node", "n", "reach")
    rare = wide.filter(F.col("count") <= SHORT).select("value", "node", "n")
    rare = short.select("value", "node", "n").unionByName(rare).distinct()
    lists = cut_lineage(rare.withColumn("reach", reach(F.col("n"), 0, percent)).unionByName(rest), "work-lists")
    discard(wide, mostly)
    return lists


def set_values(texts: DataFrame, words: int) -> DataFrame:
    """(value, node) of the full sets of some ``texts``."""

    def values(batch: dict) -> dict:
        sets = [shingle_set(unpacked(text), words) for text in batch["text"]]
        return {
            "value": np.concatenate([x.view(np.int64) for x in sets]) if sets else [],
            "node": [node for node, x in zip(batch["node"], sets) for _ in range(len(x))],
        }

    return arrow_map(texts.select("node", "text"), values, "value bigint, node binary")


def digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) that the sketch of their union lets pass and whose full sets are similar enough."""
    for side in "ab":
        pairs = pairs.join(texts.withColumnsRenamed({"node": side, "text": f"text_{side}"}), side)

    def rows(batch: dict) -> dict:
        out = {"a": [], "b": []}
        sets = {side: (None, None) for side in "ab"}
        for row in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"]):
            for side, node, text in zip("ab", row, row[2:]):
                if sets[side][0] != node:
                    sets[side] = node, shingle_set(unpacked(text), words)
            left, right = sets["a"][1], sets["b"][1]
            if likely(left[:k], right[:k], k):
                common = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * common >= percent * (len(left) + len(right) - common):
                    out["a"].append(row[0])
                    out["b"].append(row[1])
        return out

    return arrow_map(pairs.select("a", "b", "text_a", "text_b"), rows, "a binary, b binary")


def likely(left: np.ndarray, right: np.ndarray, k: int) -> bool:
    """Whether enough of the bottom-k sketch of the union of two sketches is in both."""
    union = np.union1d(left, right)[:k]
    both = np.intersect1d(np.intersect1d(left, right, assume_unique=True), union, assume_unique=True)
    return len(both) >= ESTIMATE * len(union)


def link_classes(
    classes: DataFrame, plain: DataFrame, texts: DataFrame, lists: DataFrame, words: int, percent: int, k: int, index: int
) -> DataFrame:
    """(node, root) of the classes that have links; ``plain`` are all lists of the index, ``lists`` those to work off."""
    head = F.transform(F.slice("sketch", 1, index), lambda x: F.pmod(x, F.lit(2**31 - 1)).cast("int"))
    mine = lists.groupBy("node").agg(F.collect_list("value").alias("mine"))
    marks = cut_lineage(mine.join(classes.select("node", "parity", head.alias("head")), "node"), "marks")
    release(lists.sparkSession)
    near = (F.col("n") <= F.col("leader_reach")) & (F.col("m") <= F.col("reach"))
    differ = sum((F.bit_count(F.get("parity", F.lit(i)).bitwiseXOR(F.get("leader_parity", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    near = near & (differ * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent))
    few = F.greatest(F.lit(1), F.floor(F.least("n", "m", F.lit(index)) / 5))
    near = near & (F.size(F.array_intersect("head", "leader_head")) >= few)
    near = near & (F.array_min(F.array_intersect("mine", "leader_mine")) == F.col("value"))
    central = F.struct((F.col("n") - F.col("reach")).alias("gap"), "node")
    leaders = lists.groupBy("value").agg(F.min_by(F.struct("node", "n", "reach"), central).alias("l"))
    leaders = leaders.select("value", F.col("l.node").alias("leader"), F.col("l.n").alias("m"), F.col("l.reach").alias("leader_reach"))
    leaders = cut_lineage(leaders.withColumn("leader_root", F.col("leader")), "leaders")
    rows = lists.withColumn("root", F.col("node"))
    done, roots, opened, many = leaders, None, [], SHORT
    while True:
        asked = leaders.withColumnRenamed("leader", "node").join(marks, "node")
        asked = asked.withColumnsRenamed({"value": "led", "node": "leader"} | {c: f"leader_{c}" for c in ("head", "mine", "parity")})
        apart = (F.col("value") == F.col("led")) & (F.col("root") != F.col("leader_root"))
        pairs = rows.join(marks, "node").join(asked, apart & near)
        pairs = cut_lineage(pairs.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct(), "pairs")
        release(lists.sparkSession)
        found = cut_lineage(confirmed(pairs, texts, words, percent, k), "links")
        discard(pairs)
        release(lists.sparkSession)
        if not found.isEmpty():
            known = [] if roots is None else [roots.select(F.col("node").alias("a"), F.col("root").alias("b"))]
            roots = components(reduce(DataFrame.unionByName, known, found))
            rows = cut_lineage(with_roots(rows.drop("root"), roots), "open-lists")
            opened.append(rows)
        leaders = cut_lineage(next_leaders(rows, done, many), "leaders")
        if leaders.isEmpty():
            discard(plain, lists, marks, *opened)
            return classes.limit(0).select("node", F.col("node").alias("root")) if roots is None else roots
        rows = rows.join(leaders, "value", "left_semi")
        done = done.unionByName(leaders)
        many *= 16


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def next_leaders(rows: DataFrame, done: DataFrame, many: int) -> DataFrame:
    """Up to ``many`` classes of each list, from outside its largest component, that have not led it yet."""
    parts = rows.groupBy("value", "root").agg(F.count(F.lit(1)).alias("part"))
    largest = parts.groupBy("value").agg(F.max(F.struct("part", "root")).alias("top"), F.count(F.lit(1)).alias("parts"))
    open_ = rows.join(largest.filter("parts > 1").select("value", F.col("top.root").alias("top")), "value").filter("root != top")
    open_ = open_.join(done.select("value", F.col("leader").alias("node")), ["value", "node"], "left_anti")
    order = Window.partitionBy("value").orderBy(F.col("n") - F.col("reach"), "node")
    open_ = open_.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= many)
    leader = F.col("node").alias("leader"), F.col("n").alias("m"), F.col("reach").alias("leader_reach"), F.col("root").alias("leader_root")
    return open_.select("value", *leader)


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, k: int = SKETCH, index: int = INDEX, key: str | None = None
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of ``docs``.

    ``key`` names a column of numbers that are unique to the rows. It is returned, too, and of each component exactly
    the row with the smallest id, and of these that with the smallest key, is kept; a row that links with nothing is.
    """
    known = F.coalesce("doc_id", F.lit(NO_ID))
    row, mark = F.col(key) if key else F.lit(None), F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    docs = docs.select("doc_id", row.cast("bigint").alias("row"), mark.alias("mark"), "text")
    full = cut_lineage(sketches(docs, words, k), "sketches")
    rows = cut_lineage(full.select("doc_id", "row", "n", "node"), "sets")
    first = [F.first(c).alias(c) for c in ("n", "sketch", "parity")]
    classes = full.filter("node is not null").groupBy("node").agg(F.min(F.struct(known.alias("rep"), "row", "mark")).alias("least"), *first)
    classes = cut_lineage(classes.select("node", "least.rep", "least.row", "least.mark", "n", "sketch", "parity"), "classes")
    discard(full)
    plain = classes.select("node", "n", F.explode(F.slice("sketch", 1, index)).alias("value"))
    plain = cut_lineage(shared(plain), "lists")
    asked = classes.join(plain.select("node").distinct(), "node", "left_semi").select("node", "rep", "mark")
    texts = cut_lineage(texts_of(docs.select(known.alias("rep"), "mark", "text"), asked), "texts")
    release(docs.sparkSession)
    lists = inverted_lists(classes, plain, texts, words, k, percent)
    roots = link_classes(classes, plain, texts, lists, words, percent, k, index)
    discard(texts)

    placed = with_roots(classes.select("node", "rep", "row"), roots)
    least = placed.groupBy("root").agg(F.min(F.struct("rep", "row")).alias("least"))
    of_class = placed.join(least, "root").select("node", F.col("least.rep").alias("component"), F.col("least.row").alias("first"))
    out = rows.join(of_class, "node", "left")
    component = F.nullif(F.coalesce("component", known), F.lit(NO_ID))
    kept = F.coalesce("first", "row") == F.col("row") if key else component.eqNullSafe(F.col("doc_id"))
    named = [F.col("row").alias(key)] if key else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), *named)


def texts_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, compressed text), one row per node of ``asked`` (node, rep, mark): the text of that id and digest."""

    def packed(batch: dict) -> dict:
        pack = zstandard.ZstdCompressor(level=3)
        return {"node": batch["node"], "text": [pack.compress(x.encode("utf-8", "surrogatepass")) for x in batch["text"]]}

    rows = docs.groupBy("rep", "mark").agg(F.first("text").alias("text")).join(asked, ["rep", "mark"])
    return arrow_map(rows.select("node", "text"), packed, "node binary, text binary")


def unpacked(text: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(text).decode("utf-8", "surrogatepass")
