"""The trie against one that is built from the rebuilt texts."""

import collections
import hashlib
import random
import zlib

import pytest

from lanternlog.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, id string, depth int, d string, part string"


def digest(role, text, seed=0):
    return hashlib.md5(f"{seed}:{len(role)}:{role}{text}".encode()).hexdigest()


def plain_trie(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}
    members, whole = collections.defaultdict(list), {}
    for c in own:
        h = zlib.crc32(("" if c is None else str(c)).encode()) % 9
        base = None if c is None else c - (abs(c) % 5) * (1 if c >= 0 else -1)
        head = own.get(base, [])[:h] if c is not None else []
        whole[c] = tuple(head + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    order = lambda c: (c is not None, c or 0)
    children = collections.defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out, sums = [], {}
    for path in sorted(members, key=len, reverse=True):
        saved = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        leaves = 0 if children[path] else 1
        for child in children[path]:
            leaves, saved = leaves + sums[child][0], saved + sums[child][1]
        sums[path] = leaves, saved
        parent = min(members[path[:-1]], key=order) if path else None
        ended = ",".join("" if c is None else str(c) for c in sorted((c for c in members[path] if whole[c] == path), key=order))
        out.append((min(members[path], key=order), len(path), parent, len(members[path]), len(children[path]), leaves, saved, hashlib.sha256(ended.encode()).hexdigest()))
    return out


def bag(rows):
    return collections.Counter(map(tuple, rows))


def odd_rows(seed=1):
    rng = random.Random(seed)
    texts = ["same", "", None, "é日本", "other", "x" * 5000]
    rows = []
    for conv in [None, -11, -10, -7, -3, *range(120), 2**62, 2**62 + 1]:
        for turn in range(rng.randrange(1, 14)):
            place = rng.choice((None, turn, turn, turn, turn))
            rows.append((conv, place, rng.choice(("user", "assistant", None)), texts[0] if turn < 3 else rng.choice(texts)))
    for conv in range(500, 560):
        rows += [(conv, t, "user", f"copy {t}") for t in range(12)]
    rows += [(700, t, "user", f"long {t % 7}") for t in range(300)] + [(705, t, "user", f"long {t % 7}") for t in range(290)]
    return rows + rows[:10]


def made(spark, rows):
    return spark.createDataFrame([(*r, "a", 5, "b", "c") for r in rows], SCHEMA).repartition(3)


def test_trie(spark):
    rows = odd_rows()
    assert bag(prefix_trie.trie(made(spark, rows)).collect()) == bag(plain_trie(rows))


def test_small_blocks(spark, monkeypatch):
    """Long conversations over several blocks of depths, and members over several blocks of ids."""
    monkeypatch.setattr(prefix_trie, "DEPTH_BITS", 3)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 2)
    rows = odd_rows(2)
    assert bag(prefix_trie.trie(made(spark, rows)).collect()) == bag(plain_trie(rows))


def test_one_conversation(spark):
    """A conversation over all range partitions."""
    rows = [(5, t, "user", f"turn {t % 11}") for t in range(900)] + [(6, 1, "user", "turn 1")]
    assert bag(prefix_trie.trie(made(spark, rows)).collect()) == bag(plain_trie(rows))


def test_collisions_are_found(spark, monkeypatch):
    """With tiny primes, different prefixes meet in a node or texts share a symbol; both are noticed."""
    rows = [(c * 5, t, "user", f"{c} {t}") for c in range(40) for t in range(3)]
    table = made(spark, rows)
    monkeypatch.setattr(prefix_trie, "PRIMES", (5, 5, 5, 5))
    monkeypatch.setattr(prefix_trie, "BASES", (2, 2, 2, 2))
    turns = prefix_trie.symbols(table, 0)
    own, pieces = prefix_trie.own_prefixes(turns)
    nodes = prefix_trie.grouped(prefix_trie.rebuilt(own, pieces))
    assert not nodes.filter("not agrees").isEmpty()
    turns = turns.withColumns({s: prefix_trie.F.lit(1) for s in prefix_trie.lanes("s")})
    assert not prefix_trie.one_text_each(turns, prefix_trie.own_prefixes(turns)[0])


def test_next_seed(spark, monkeypatch):
    """A failed verification leads to another seed, with the same result."""
    honest, asked = prefix_trie.one_text_each, []
    monkeypatch.setattr(prefix_trie, "one_text_each", lambda *a: asked.append(honest(*a)) or len(asked) > 1)
    rows = [(1, 0, "user", "a"), (5, 0, "user", "b"), (6, 0, "user", "c"), (6, 1, "user", "a")]
    assert bag(prefix_trie.trie(made(spark, rows)).collect()) == bag(plain_trie(rows))
    assert asked == [True, True]


def test_empty_table(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_tables(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert bag(prefix_trie.trie(table).collect()) == bag(plain_trie(rows))
