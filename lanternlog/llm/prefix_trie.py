"""A trie of the prefixes that rebuilt conversations share, by composable fingerprints.

Conversation c is rebuilt from a head of h turns of its base c - c % 5 and its own turns after its first h. No rebuilt text is
made. A sequence of turns has a fingerprint in a monoid: its length and, modulo four primes, the sum of its turns' symbols
times powers of a base. Joining two sequences adds the second sum times the base to the first one's length; the prefix sums of
the original turns are computed once, and a rebuilt prefix is the base's head sum combined with the difference of two
sums of c's own turns. The same law puts together the pieces into which a long conversation is cut: conversations
are dealt by ranges of (conversation, turn, digest), summed piece by piece, and carried over a small table of pieces.

Nodes are groups of equal (depth, fingerprint). They are verified through references: all members of a node must agree in
the parent's fingerprint and in the symbol of their last turn, and each symbol that occurs repeatedly must stand for one role and
text among the stored turns. By induction, equal fingerprints are equal sequences then. If a group fails, all is done
again with another seed, so a chance collision costs time and never a wrong node.

Sums over subtrees need no pairs of nodes. A node is owned by its smallest member. A node u below v is met on the path of
its owner, which is a member of v; so v's sum over its subtree is the sum, over v's members, of what their own
paths hold from v's depth on. Those are running sums along a conversation, in blocks of 4,096 depths, followed by one aggregation.
The members that end in a node are written as text in blocks of 65,536 ids; the SHA-256, which is
sequential by nature, streams over the blocks.

Defined results: turns are ordered by turn (null first), then by digest; a null role or text is empty. Rows with a null
conversation are one conversation without a base (h = 0) whose decimal is empty; it sorts before all others (the smallest
bigint is taken as null) and shows as null. Repeated rows are turns of their own; equal rows of one conversation and turn
stay in one piece. Very long texts are hashed where they are read; only repeated ones are moved for verification. An
empty table has no members and gives no nodes. Columns other than ``conv_id``, ``turn``, ``role`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window, functions as F

from .chat import by_batches, rows_of
from .common import NO_ID, arrow_schema, cut_lineage

#: Primes below 2**31 and the bases of the sums.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1597334677, 1812433253, 1566083941)
LANES = range(4)
HEAD, FAMILY = 8, 5
DEPTH_BITS, ID_BITS = 12, 16
ENDS = "d bigint, fa bigint, fb bigint, ends_sha256 string"
NODE = ["d", "fa", "fb"]


def long_array(values: list[int]) -> str:
    return "array(" + ",".join(f"{v}L" for v in values) + ")"


def power(lane: int, exponent: str) -> Column:
    """The lane's base to a power below 2**32, from tables of its powers by byte of the exponent."""
    prime, out = PRIMES[lane], None
    for byte in range(4):
        values = [pow(BASES[lane], digit << (8 * byte), prime) for digit in range(256)]
        factor = F.expr(f"get({long_array(values)}, cast(shiftright({exponent}, {8 * byte}) & 255 as int))")
        out = factor if out is None else out * factor % PRIMES[lane]
    return out


def downward(lane: int, steps: str) -> Column:
    """The lane's base to the power of minus ``steps``, which is at most the head's length."""
    return F.expr(f"get({long_array([pow(BASES[lane], -n, PRIMES[lane]) for n in range(HEAD + 1)])}, {steps})")


def lanes(name: str) -> list[str]:
    return [f"{name}{lane}" for lane in LANES]


def packed(name: str) -> list[Column]:
    return [F.shiftleft(F.col(f"{name}{i}"), 31).bitwiseOR(F.col(f"{name}{i + 1}")) for i in (0, 2)]


def symbols(conversations: DataFrame, seed: int) -> DataFrame:
    """The turns with four numbers each that stand for role and text; ``id`` is never null."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.char_length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NO_ID)).alias("id"), "turn", role.alias("role"), text.alias("text"), digest.alias("digest")
    )
    number = [F.conv(F.substring("digest", 8 * lane + 1, 8), 16, 10).cast("bigint") % (PRIMES[lane] - 1) + 1 for lane in LANES]
    return turns.withColumns(dict(zip(lanes("s"), number)))


def own_prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every original turn with its place ``m`` and its prefix's sums, and the pieces with their conversation's length."""
    narrow = turns.select("id", "turn", "digest", F.octet_length("text").cast("bigint").alias("bytes"), *lanes("s"))
    dealt = cut_lineage(narrow.repartitionByRange("id", "turn", "digest").withColumn("part", F.spark_partition_id()), "dealt-turns")
    inside = Window.partitionBy("id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumn("k", F.row_number().over(inside).cast("bigint"))
    rows = rows.withColumns({f"term{i}": F.col(f"s{i}") * power(i, "k") % PRIMES[i] for i in LANES})
    rows = rows.withColumns({f"local{i}": F.sum(f"term{i}").over(inside) % PRIMES[i] for i in LANES})
    rows = cut_lineage(rows, "local-prefixes")

    before = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("id")
    nothing = F.lit(0).cast("bigint")
    pieces = rows.groupBy("id", "part").agg(F.count(F.lit(1)).alias("n"), *[(F.sum(f"term{i}") % PRIMES[i]).alias(f"h{i}") for i in LANES])
    pieces = pieces.select("*", F.coalesce(F.sum("n").over(before), nothing).alias("base"), F.sum("n").over(whole).alias("length"))
    pieces = pieces.withColumns({f"up{i}": power(i, "base") for i in LANES})
    pieces = pieces.withColumns({f"carry{i}": F.coalesce(F.sum(F.col(f"h{i}") * F.col(f"up{i}") % PRIMES[i]).over(before), nothing) % PRIMES[i] for i in LANES})
    pieces = cut_lineage(pieces.select("id", "part", "base", "length", *lanes("up"), *lanes("carry")), "pieces")

    own = rows.join(pieces, ["id", "part"]).withColumn("m", F.col("base") + F.col("k"))
    own = own.select(
        "id", "part", "m", "bytes", *lanes("s"),
        *[((F.col(f"carry{i}") + F.col(f"up{i}") * F.col(f"local{i}")) % PRIMES[i]).alias(f"p{i}") for i in LANES],
        *[(F.col(f"up{i}") * F.col(f"term{i}") % PRIMES[i]).alias(f"q{i}") for i in LANES],
    )
    return cut_lineage(own, "own-prefixes"), pieces


def rebuilt(own: DataFrame, pieces: DataFrame) -> DataFrame:
    """A row per conversation and depth of its rebuilt form, root included: fingerprint, parent's fingerprint, last turn."""
    turn = F.struct("m", "bytes", *lanes("s"), *lanes("p"), *lanes("q"))
    firsts = own.filter(F.col("m") <= HEAD).groupBy("id").agg(F.sort_array(F.collect_list(turn)).alias("firsts"))
    firsts = cut_lineage(firsts, "first-turns")
    decimal = F.when(F.col("id") != NO_ID, F.col("id").cast("string")).otherwise("")
    convs = firsts.join(pieces.groupBy("id").agg(F.max("length").alias("n")), "id").select(
        "*",
        (F.crc32(decimal.cast("binary")) % (HEAD + 1)).cast("int").alias("h"),
        F.when(F.col("id") != NO_ID, F.col("id") - F.col("id") % FAMILY).alias("base_id"),
    )
    bases = firsts.select(F.col("id").alias("base_id"), F.col("firsts").alias("head"))
    convs = convs.join(bases, "base_id", "left").withColumn("head", F.expr("slice(coalesce(head, array()), 1, h)"))
    convs = convs.withColumn("l", F.size("head")).withColumn("len", F.col("l") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    at = {f"head{i}": F.expr(f"coalesce(get(head, l - 1).p{i}, 0)") for i in LANES}
    at |= {f"skip{i}": F.expr(f"coalesce(get(firsts, h - 1).p{i}, 0)") for i in LANES}
    convs = cut_lineage(convs.withColumns(at).drop("firsts"), "rebuilt-heads")

    def rows(df: DataFrame, depth: Column) -> DataFrame:
        parent = {f"o{i}": (F.col(f"f{i}") - F.col(f"q{i}") + PRIMES[i]) % PRIMES[i] for i in LANES}
        (fa, fb), (pa, pb), (sa, sb) = packed("f"), packed("o"), packed("s")
        return df.withColumns(parent).select(
            "id", depth.cast("bigint").alias("d"), "len", "bytes",
            fa.alias("fa"), fb.alias("fb"), pa.alias("pa"), pb.alias("pb"), sa.alias("sa"), sb.alias("sb"),
        )

    zero = F.lit(0).cast("bigint")
    root = convs.select("id", zero.alias("d"), "len", *[zero.alias(c) for c in ("bytes", "fa", "fb", "pa", "pb", "sa", "sb")])
    heads = convs.select("id", "len", F.explode("head").alias("t")).select("id", "len", "t.*")
    heads = rows(heads.withColumns({f"f{i}": F.col(f"p{i}") for i in LANES}), F.col("m"))
    tails = own.join(pieces.select("id", "part").join(convs.select("id", "h", "l", "len", *at), "id"), ["id", "part"]).filter("m > h")
    tails = tails.withColumns({f"scale{i}": downward(i, "h - l") for i in LANES})
    tails = tails.withColumns(
        {f"f{i}": (F.col(f"head{i}") + (F.col(f"p{i}") - F.col(f"skip{i}") + PRIMES[i]) % PRIMES[i] * F.col(f"scale{i}")) % PRIMES[i] for i in LANES}
        | {f"q{i}": F.col(f"q{i}") * F.col(f"scale{i}") % PRIMES[i] for i in LANES}
    )
    tails = rows(tails, F.col("l") + F.col("m") - F.col("h"))
    return cut_lineage(root.unionByName(heads).unionByName(tails), "rebuilt")


def grouped(members: DataFrame) -> DataFrame:
    """The nodes: smallest member, number of members, longest member, and whether all agree in parent and last turn."""
    same = [F.min(c) == F.max(c) for c in ("pa", "pb", "sa", "sb")]
    nodes = members.groupBy(*NODE).agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.max("len").alias("deepest"),
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), (same[0] & same[1] & same[2] & same[3]).alias("agrees"),
    )
    return cut_lineage(nodes, "nodes")


def one_text_each(turns: DataFrame, own: DataFrame) -> bool:
    """Whether each repeated symbol stands for one role and text among the stored turns."""
    repeated = own.groupBy(*lanes("s")).count().filter("count > 1").drop("count")
    texts = turns.join(repeated, lanes("s"), "left_semi").groupBy(*lanes("s"), "role", "text").count()
    return texts.groupBy(*lanes("s")).count().filter("count > 1").isEmpty()


def subtree_sums(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Leaves and saved bytes of every node's subtree."""
    owners = nodes.select("id", "d", (F.col("deepest") == F.col("d")).alias("leaf"))
    rows = members.join(owners, ["id", "d"], "left").select(
        "id", *NODE,
        F.shiftright("d", DEPTH_BITS).alias("block"),
        F.when(F.col("leaf").isNull(), F.col("bytes")).otherwise(0).alias("shared"),
        F.coalesce(F.col("leaf").cast("bigint"), F.lit(0)).alias("leaf"),
    )
    inside = Window.partitionBy("id", "block").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("id", *NODE, "block", *[F.sum(c).over(inside).alias(c) for c in ("shared", "leaf")])
    deeper = Window.partitionBy("id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("id", "block").agg(F.max("shared").alias("shared"), F.max("leaf").alias("leaf"))
    blocks = blocks.select("id", "block", *[F.coalesce(F.sum(c).over(deeper), F.lit(0)).alias(f"later_{c}") for c in ("shared", "leaf")])
    rows = rows.join(blocks, ["id", "block"])
    return rows.groupBy(*NODE).agg(
        F.sum(F.col("leaf") + F.col("later_leaf")).alias("n_leaves"), F.sum(F.col("shared") + F.col("later_shared")).alias("saved_tokens")
    )


def digested(pieces: Iterator[dict]) -> Iterator[dict]:
    for node, own in groupby(pieces, key=lambda row: (row["d"], row["fa"], row["fb"])):
        sha, between = hashlib.sha256(), b""
        for row in own:
            sha.update(between + row["text"].encode())
            between = b","
        yield dict(zip(NODE, node)) | {"ends_sha256": sha.hexdigest()}


def ends(members: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end in a node."""
    decimal = F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda c: F.when(c != NO_ID, c.cast("string")).otherwise("")), ",")
    last = members.filter("d = len").groupBy(*NODE, F.shiftright("id", ID_BITS).alias("block")).agg(decimal.alias("text"))
    fields = arrow_schema(ENDS)
    dealt = last.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "text")
    return dealt.mapInArrow(lambda b: by_batches(digested(rows_of(b)), fields), ENDS)


def verified(conversations: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Members and nodes whose equality is proved."""
    while True:
        turns = symbols(conversations, seed)
        own, pieces = own_prefixes(turns)
        members = rebuilt(own, pieces)
        nodes = grouped(members)
        if nodes.filter("not agrees").isEmpty() and one_text_each(turns, own):
            return members, nodes
        seed += 1


def trie(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """One row per node."""
    members, nodes = verified(conversations, seed)
    children = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("pa").alias("fa"), F.col("pb").alias("fb")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("fa").alias("pa"), F.col("fb").alias("pb"), F.col("id").alias("parent"))
    rows = nodes.join(subtree_sums(members, nodes), NODE).join(children, NODE, "left").join(ends(members), NODE, "left")
    rows = rows.join(parents, ["d", "pa", "pb"], "left")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.select(
        known("id").alias("conv_id"),
        F.col("d").alias("depth"),
        known("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        F.col("n_leaves").cast("bigint").alias("n_leaves"),
        F.col("saved_tokens").cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
