"""Best-fit packing of documents into token sequences, by hierarchical residual packing.

Documents become pieces of at most ``capacity`` tokens. The pieces are dealt over partitions by a hash; each partition
packs its own best-fit, longest first, and emits its nearly full bins. The underfull bins go on as items: they are
dealt over fewer partitions, packed best-fit again, and so on up the tree until one partition is left or a round
merges too few bins to pay. The number of partitions follows the number of items, so no task holds more than about
``task_items`` of them.

Defined results: a null text is an empty text, which is one piece of the end token. A null id is kept. Repeated rows are
packed each. An empty table gives an empty table. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, arrow_schema, cut_lineage

CAPACITY = 1024
END_TOKEN = 2
#: Bins with at most this many free places are final.
SLACK = 8
TASK_ITEMS = 1 << 17
#: A round that leaves more than this share of its items ends the merging.
LEAST_GAIN = 0.98

MEMBER = "struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint, offset: bigint>"
BINS = f"final boolean, sequence_id bigint, size bigint, members array<{MEMBER}>"

#: Fixed value: how the vocabulary's pre-tokenizer cuts a text.
PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Reader:
    """Ids of texts by a byte-level BPE file, as little-endian 32-bit numbers.

    Token ids are in the order of the merges, so the file's vocabulary serves as ranks for the faster library. Texts
    with a string of a special token, and those that the faster library refuses (its pattern fails on some million
    blanks in a row), are left to the library that the file is made for.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        byte = byte_characters()
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if not self.special.search(text):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).tobytes()
            except ValueError:
                pass
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


_readers: dict[str, Reader] = {}


def reader(path: str) -> Reader:
    """The worker's own reader of a vocabulary, kept between tasks."""
    if path not in _readers:
        _readers[path] = Reader(path)
    return _readers[path]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END_TOKEN) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids): ids as little-endian 32-bit numbers, the first piece the short one."""

    def rows(batch: dict) -> dict:
        ids, out = reader(vocabulary), {k: [] for k in ("doc_id", "piece", "start", "length", "ids")}
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            data = ids.encode(text or "") + end.to_bytes(4, "little")
            n = len(data) // 4
            cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                for name, value in zip(out, (doc_id, piece, a, b - a, data[4 * a : 4 * b])):
                    out[name].append(value)
        return out

    return arrow_map(docs.select("doc_id", "text"), rows, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions: each item, in the given order, goes to the fullest bin that still holds it."""
    bins, free, levels = [], [[] for _ in range(capacity + 1)], 0
    for i, size in enumerate(sizes):
        fitting = levels >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            to = free[room].pop()
            if not free[room]:
                levels ^= 1 << room
            bins[to].append(i)
        else:
            room, to = capacity, len(bins)
            bins.append([i])
        if room > size:
            levels |= 1 << room - size
            free[room - size].append(to)
    return bins


def pack_round(items: DataFrame, number: int, partitions: int, capacity: int, slack: int) -> DataFrame:
    """Deal the items over partitions and pack each of these best-fit; ``final`` marks the nearly full bins."""
    first = F.element_at("members", 1)
    dealt = items.select("size", "members").repartition(partitions, F.xxhash64(first["doc_id"], first["piece"], F.lit(number)))
    fields = arrow_schema(BINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (-r["size"], *((m := r["members"][0])["doc_id"] is not None, m["doc_id"] or 0, m["start"])))
        part = number << 56 | TaskContext.get().partitionId() << 28
        bins = best_fit([r["size"] for r in rows], capacity)
        for low in range(0, len(bins), 4096):
            out = []
            for index, places in enumerate(bins[low : low + 4096], low):
                size, members = 0, []
                for row in map(rows.__getitem__, places):
                    members += [m | {"offset": m["offset"] + size} for m in row["members"]]
                    size += row["size"]
                out.append({"final": size >= capacity - slack, "sequence_id": part | index, "size": size, "members": members})
            yield pa.RecordBatch.from_pylist(out, fields)

    return dealt.mapInArrow(run, BINS)


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, task_items: int = TASK_ITEMS) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32): adds sequence_id and the offset in the sequence."""
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("bigint").alias("offset"))
    items = pieces.select(F.col("length").alias("size"), F.array(member).alias("members"))
    left, number, done = items.count(), 0, []
    while True:
        partitions = max(1, -(-left // task_items))
        bins = cut_lineage(pack_round(items, number, partitions, capacity, slack), f"pack-{number}")
        items, before = bins.filter("not final"), left
        left = items.count()
        if partitions == 1 or left > LEAST_GAIN * before or not left:
            done.append(bins)
            break
        done.append(bins.filter("final"))
        number += 1
    placed = reduce(DataFrame.unionByName, done)
    return placed.select("sequence_id", F.explode("members").alias("m")).select("m.*", "sequence_id")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id and the ids of its pieces in the order of their offsets."""
    keys = ["doc_id", "piece"]
    both = pieces.select(*keys, "ids").join(placed.select(*keys, "sequence_id", "offset"), keys)
    parts = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda all_, part: F.concat(all_, part["ids"]))
    return parts.select("sequence_id", ids.alias("ids"))


def placed_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, vocabulary, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(cut_lineage(pieces, "pieces"), capacity)
