"""The operators on documents against brute force, on rows with every odd case."""

import collections
import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternlog.llm import classifier, exact_dedup, line_dedup, mixing, near_dedup, packing, quality_rules, suffix_dedup
from lanternlog.llm.common import NO_ID
from lanternlog.llm.cuckoo import CuckooFilter
from lanternlog.llm.queries import VOCABULARY

BLANK = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def known(doc_id):
    return NO_ID if doc_id is None else doc_id


def bag(rows):
    return collections.Counter(map(tuple, rows))


def test_empty_tables(spark, nothing, tmp_path):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert mixing.mix(nothing).count() == 0
    assert packing.placed_pieces(nothing, VOCABULARY).count() == 0
    assert quality_rules.clean(nothing).count() == 0
    assert near_dedup.near_duplicates(nothing).count() == 0
    assert line_dedup.dedup_lines(nothing).count() == 0
    assert suffix_dedup.remove_repeated(nothing).count() == 0
    assert classifier.classify(nothing, labels).count() == 0
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    assert exact_dedup.exact_duplicates(spark, f"{tmp_path}/documents.parquet").count() == 0


def test_mix(docs, rows):
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    rest, target = Fraction(3 * sum(sizes.values()), 2), {}
    while len(target) < len(order):
        level = rest / sum(weight[s] for s in order if s not in target)
        full = [s for s in order if s not in target and weight[s] * level >= 2 * sizes[s]]
        if not full:
            target |= {s: weight[s] * level for s in order if s not in target}
        for s in full:
            target[s] = 2 * sizes[s]
            rest -= target[s]
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(float(target[r["source"]]))
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS * len(order) for s in order)
    assert bag([r.values() for r in got]) == bag([r.asDict().values() for r in mixing.mix(docs).collect()])


def test_apportion_is_sainte_lague(spark):
    votes = {"a": 53_000.0, "b": 24_000.0, "c": 23_000.0, "d": 600.0, "e": 600.0}
    rows = spark.createDataFrame([(p, v, 40, 101) for p, v in votes.items()], "p string, votes double, most bigint, seats bigint")
    got = {r["p"]: r["quota"] for r in mixing.apportion(rows, [], ["p"]).collect()}
    seats = sorted(((-v / (2 * s + 1), p, s) for p, v in votes.items() for s in range(40)))[:101]
    assert got == {p: sum(x[1] == p for x in seats) for p in votes}


def test_pack(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = [r.asDict() for r in packing.placed_pieces(docs, VOCABULARY).collect()]
    want, total = [], 0
    for r in rows:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((r["doc_id"], piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert bag((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == bag(want)
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    assert len(places) <= -(-total // 1024) + 1


def test_pack_over_a_million_blanks(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    texts = [" " * 1_200_000, "a\n" * 3 + "\n" * 1_200_000 + "b", "between"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(1)
    got = {r["doc_id"]: r["n"] for r in packing.placed_pieces(docs, VOCABULARY).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    reader = packing.Reader(VOCABULARY)
    for t in texts:
        assert reader.encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_pack_in_rounds(spark):
    sizes = [(i, 0, 0, int(x), 0) for i, x in enumerate(np.random.default_rng(1).integers(1, 1025, 4000))]
    pieces = spark.createDataFrame(sizes, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    got = packing.pack(pieces, task_items=500)
    sums = [r["n"] for r in got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert got.count() == 4000 and max(sums) <= 1024 and len(sums) <= 1.02 * sum(sums) / 1024 + 8


def test_pack_sequences(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d " * 2000)], "doc_id bigint, text string")
    pieces = packing.token_pieces(docs, VOCABULARY)
    placed = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    lengths = [len(r["ids"]) // 4 for r in packing.sequences(pieces, placed).collect()]
    assert sum(lengths) == sum(r["length"] for r in pieces.collect()) and max(lengths) <= 1024


def test_rules(docs, rows):
    def base(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        hit = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed

    got = quality_rules.verdicts(docs).collect()
    assert bag(r[:-1] for r in got) == bag((r["doc_id"], *base(r["text"] or "")) for r in rows)
    assert {r["doc_id"]: r["kept"] for r in got}[14] and not any(r["kept"] for r in got if r["base_failed"])


def test_line_rules():
    good = "The house stood on a hill, and its windows looked over the sea. " * 4
    assert quality_rules.judge(good + "\n" + "x y z. " * 2 + " ".join(f"w{i}" for i in range(60)) + ".")[6]
    assert not quality_rules.judge("\n".join(f"home{i} | about{i} | help{i} | login{i}" for i in range(20)))[6]
    assert not quality_rules.judge(" ".join(f"WORD{i}!!" for i in range(80)))[6]


def test_shouting_is_judged_over_the_whole_line():
    shout = "Notice: " + " ".join(f"BUY CHEAP WATCHES NOW AT STAND {'ABCDEFGHIJ'[i % 10] * (i + 1)}" for i in range(20)) + "."
    assert quality_rules.punctuation_fails(shout, len(shout.split()))
    assert quality_rules.punctuation_fails("Это: " + "КУПИТЕ ЧАСЫ СЕЙЧАС " * 10, 31)
    assert not quality_rules.punctuation_fails("NOTICE TO ALL READERS OF THIS WHOLE PAGE: " + "the house stood on a hill by the sea, " * 4, 44)
    assert not quality_rules.judge("\n".join(shout.replace("STAND", f"STAND{i}") for i in range(5)))[6]


def brute_near(rows, size, percent):
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(known(r["doc_id"]))
    return [(r["doc_id"], len(sets[i]), min(least[find(i)])) for i, r in enumerate(rows)]


def test_near_duplicates(docs, rows):
    got = near_dedup.near_duplicates(docs, words=4).collect()
    assert bag((r["doc_id"], r["n_shingles"], known(r["component_id"])) for r in got) == bag(brute_near(rows, 4, 80))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_long_lists(spark):
    """A group of edited copies larger than a short list, next to texts that share a passage."""
    r = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    rows = [{"doc_id": 0, "text": " ".join(base)}]
    for i in range(1, 90):
        words = list(base)
        for place in r.choice(120, int(r.integers(1, 8)), replace=False):
            words[place] = f"e{i}-{place}"
        rows.append({"doc_id": i, "text": " ".join(words)})
    for i in range(90, 180):
        rows.append({"doc_id": i, "text": " ".join([f"p{k}" for k in range(70)] + [f"o{i}-{k}" for k in range(int(r.integers(5, 60)))])})
    docs = spark.createDataFrame([(x["doc_id"], x["text"]) for x in rows], "doc_id bigint, text string")
    got = near_dedup.near_duplicates(docs, words=4).collect()
    assert bag((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == bag(brute_near(rows, 4, 80))


def test_texts_are_fetched_once_for_equal_ids(spark):
    """Null and repeated ids do not multiply the rows whose text is fetched; each class gets one text."""
    rows = [(NO_ID, f"text {i}".encode(), f"text {i}") for i in range(40)] * 3 + [(7, b"a", "a"), (7, b"b", "b")]
    docs = spark.createDataFrame(rows, "rep bigint, mark binary, text string").repartition(4)
    asked = docs.select(F.col("mark").alias("node"), "rep", "mark").distinct()
    got = near_dedup.texts_of(docs, asked).collect()
    assert sorted((bytes(r["node"]).decode(), near_dedup.unpacked(r["text"])) for r in got) == sorted({(x[2], x[2]) for x in rows})


def test_near_duplicates_with_null_ids(spark):
    texts = [" ".join(f"g{i // 3}w{k}" for k in range(40)) + f" end{i % 3}" for i in range(60)]
    rows = [{"doc_id": None if i % 3 else i, "text": t} for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id bigint, text string").repartition(3)
    got = near_dedup.near_duplicates(docs, words=4).collect()
    assert bag((r["doc_id"], r["n_shingles"], known(r["component_id"])) for r in got) == bag(brute_near(rows, 4, 80))


def brute_lines(rows, extra=()):
    def key(line):
        line = line.strip(BLANK)
        return line.encode().lower() if len(line) >= 20 else None

    where = collections.defaultdict(set)
    for r in [*rows, *extra]:
        for line in (r["text"] or "").split("\n"):
            where[key(line)].add(known(r["doc_id"]))
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(where[key(x)]) >= 3 and max(where[key(x)]) != known(r["doc_id"]))]
        out.append((r["doc_id"], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines(docs, rows):
    got = line_dedup.dedup_lines(docs, ("kept", "key", "value")).collect()
    assert bag((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == bag(brute_lines(rows))
    assert {(r["kept"], r["key"], r["value"]) for r in got} == {(None, "y", "z")}


def test_lines_are_reversible(spark, docs, rows):
    more = [{"doc_id": 100 + i, "text": rows[0]["text"] + f"\nline number {i % 3} of the later documents"} for i in range(6)]
    later = spark.createDataFrame([(r["doc_id"], r["text"]) for r in more], "doc_id bigint, text string")
    index = line_dedup.LineIndex(spark, shards=4).insert(docs)
    before = {tuple(r) for r in index.refs.collect()}
    index.insert(later)
    assert bag(index.clean(docs).collect()) == bag(brute_lines(rows, more))
    index.delete(later.select("doc_id"))
    assert {tuple(r) for r in index.refs.collect()} == before
    assert bag(index.clean(docs).collect()) == bag(brute_lines(rows))


def test_cuckoo_filter():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(20_000)]
    made = CuckooFilter.load(CuckooFilter.of(keys[:10_000]).dump())
    assert made.contains(keys[:10_000]).all() and made.contains(keys[10_000:]).mean() < 0.01
    made.remove(keys[:5000])
    assert made.contains(keys[5000:10_000]).all() and made.contains(keys[:5000]).mean() < 0.01


def test_exact(spark, docs, rows, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    docs.write.parquet(path)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(known(r["doc_id"]))
    want = bag((r["doc_id"], max(groups[r["text"] or ""]), len(groups[r["text"] or ""]), known(r["doc_id"]) == max(groups[r["text"] or ""]), sha(r["text"] or "")) for r in rows)
    got = exact_dedup.exact_duplicates(spark, path, f"{tmp_path}/state").collect()
    assert bag((r[0], known(r[1]), *r[2:]) for r in got) == want
    docs.filter("doc_id = 9").write.mode("append").parquet(path)
    again = exact_dedup.exact_duplicates(spark, path, f"{tmp_path}/state").collect()
    assert {r["group_size"] for r in again if r["doc_id"] == 9} == {3}


def test_exact_with_colliding_digests(spark, docs, monkeypatch):
    keyed = exact_dedup.keyed(docs.filter("doc_id in (1, 2, 9, 11)"))
    out = keyed.select("doc_id", "id", F.lit("d").alias("digest"), F.lit(11).alias("keep"), F.lit(4).alias("size"))
    rows = keyed.withColumn("digest", F.lit("d"))
    got = exact_dedup.separated(rows, out, spark.createDataFrame([("d",)], "digest string")).collect()
    assert {(r["doc_id"], r["keep"], r["size"]) for r in got} == {(1, 2, 2), (2, 2, 2), (9, 11, 2), (11, 11, 2)}


def brute_bytes(rows, length=50):
    first = {}
    for r in rows:
        b = (r["text"] or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, known(r["doc_id"])), known(r["doc_id"]))
    for r in rows:
        b = (r["text"] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < known(r["doc_id"]):
                gone[i : i + length] = b"\1" * length
        yield r["doc_id"], len(b), sum(gone), len(re.findall(b"\1+", gone)), bytes(x for x, c in zip(b, gone) if not c)


def test_repeated_bytes(docs, rows):
    got = suffix_dedup.remove_repeated(docs).collect()
    assert bag((*r[:-1], bytes(r[-1])) for r in got) == bag(brute_bytes(rows))


def test_classifier(spark, sf, docs):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = classifier.classify(table, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9
    odd = classifier.classify(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    none = classifier.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_attention_gradients():
    r = np.random.default_rng(0)
    bags = [r.normal(size=(n, classifier.FEATURES)) for n in (1, 3, 5)]
    model = classifier.GatedAttention(np.zeros(classifier.FEATURES), np.ones(classifier.FEATURES))
    x, starts, y = np.concatenate(bags), np.array([0, 1, 4]), np.array([0.0, 1.0, 1.0])

    def loss():
        s = model.forward(x, starts)[-1]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, grad in model.gradients(x, starts, y).items():
        place = (0,) * grad.ndim
        kept = model.p[name][place]
        model.p[name][place] = kept + 1e-5
        high = loss()
        model.p[name][place] = kept - 1e-5
        assert (high - loss()) / 2e-5 == pytest.approx(grad[place], abs=1e-6)
        model.p[name][place] = kept
