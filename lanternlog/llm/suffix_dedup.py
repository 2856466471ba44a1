"""Removal of byte strings that an earlier document holds, by hash grouping of sampled windows, block by block.

Only the first ``length`` bytes of a suffix count, so suffixes are grouped to that depth. A cover sample picks, in every
string of ``length`` bytes, one of its 16-byte grams by content (the one with the smallest hash), so equal strings have
the same cover gram at the same place. Runs of neighbouring suffixes with one cover gram form a record, and the hash
of the cover gram deals the records to blocks and, in a block, to buckets. One block of buckets is shuffled and solved
at a time, so the space is that of a block. In a bucket, records whose cover gram occurs in one document only are done;
the suffixes of the others are ordered by a hash of their bytes, and equal neighbours are compared byte by byte.

The driver's position is a loop over a fixed number of blocks. Exact copies are set apart first: each of them but the
smallest id is covered whole. Results are spans (document, start, end), so the texts themselves never meet.

Defined results: a null text is empty. A null id sorts before all others. Rows that repeat an id do not count as
earlier than each other. An empty table gives an empty table. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import NO_ID, arrow_schema, cut_lineage, release
from .shingles import mixed

LENGTH = 50
GRAM = 16
BLOCKS = 6
#: Bytes of records a bucket holds on average, and of text a part holds when spans are applied.
BUCKET_BYTES = 6 << 20
PART_BYTES = 6 << 20
#: Suffixes of a record.
MOST_RUN = 64
#: Records of a text whose cover grams are sought at a time.
CHUNK = 1 << 16
RECORDS = "bucket int, cover binary, id binary, no binary, place binary, n binary, data binary"
SPANS = "part int, id binary, no binary, low binary, high binary"


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; a view."""
    return np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    eight = words_at(data)
    return mixed(mixed(eight[: len(eight) - 8]) + eight[8:])


def hashes_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    eight = words_at(data)
    return mixed(mixed(eight[places]) + eight[places + 8])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def runs(data: np.ndarray, length: int) -> bytes:
    """Records of one text, two small numbers each: the number of suffixes, and how far behind the first one the cover gram lies."""
    grams = gram_hashes(data)
    cover = sliding_least(grams, length - GRAM + 1)
    new = np.flatnonzero(np.concatenate([[True], cover[1:] != cover[:-1]]))
    n = np.diff(np.append(new, len(cover)))
    if n.max(initial=0) > MOST_RUN:
        pieces = -(-n // MOST_RUN)
        index = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        new, n = np.repeat(new, pieces) + index * MOST_RUN, np.minimum(np.repeat(n, pieces) - index * MOST_RUN, MOST_RUN)
    windows = np.lib.stride_tricks.sliding_window_view(grams, length - GRAM + 1)
    behind = np.concatenate([windows[new[low : low + CHUNK]].argmin(axis=1) for low in range(0, len(new), CHUNK)])
    return np.stack([n, behind], axis=1).astype(place_type(length)).tobytes()


def place_type(length: int) -> type:
    return np.uint8 if length <= 256 else np.uint32


def read_runs(data: np.ndarray, stored: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records of one text: the cover gram's hash, the first suffix and the number of suffixes."""
    n, behind = np.frombuffer(stored, place_type(length)).reshape(-1, 2).T.astype(np.int64)
    first = np.cumsum(n) - n
    return hashes_at(data, first + behind), first, n


def with_runs(texts: DataFrame, length: int) -> DataFrame:
    """The texts (id, no, text) with their records' places, so that no block has to look for them again."""
    schema = "id bigint, no bigint, text binary, runs binary"
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs(np.frombuffer(t.as_buffer(), np.uint8), length) if len(t.as_buffer()) >= length else b"" for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["no"], batch["text"], pa.array(found, pa.binary())], schema=fields)

    return texts.mapInArrow(run, schema)


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of several stretches, one after another."""
    ends = np.cumsum(sizes)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def records(texts: DataFrame, length: int, block: int, blocks: int, buckets: int) -> DataFrame:
    """Records of one block, packed by bucket."""
    fields = arrow_schema(RECORDS)

    def pack(held: list[tuple]) -> pa.RecordBatch:
        bucket, cover, ids, nos, place, n = (np.concatenate([h[i] for h in held]) for i in range(6))
        data = np.concatenate([h[6] for h in held])
        sizes = n + length - 1
        offset = np.cumsum(sizes) - sizes
        order = np.argsort(bucket, kind="stable")
        out = []
        for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
            out.append(
                {
                    "bucket": int(bucket[own[0]]), "cover": cover[own].tobytes(), "id": ids[own].tobytes(), "no": nos[own].tobytes(),
                    "place": place[own].tobytes(), "n": n[own].astype(np.uint8).tobytes(), "data": gathered(data, offset[own], sizes[own]).tobytes(),
                }
            )
        return pa.RecordBatch.from_pylist(out, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc_id, no, text, stored in zip(*(batch[c] for c in ("id", "no", "text", "runs"))):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                if len(raw) < length:
                    continue
                cover, first, n = read_runs(raw, stored.as_py(), length)
                own = cover % np.uint64(blocks) == block
                cover, first, n = cover[own], first[own], n[own]
                bucket = ((cover >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)
                data = gathered(raw, first, n + length - 1)
                held.append((bucket, cover, np.full(len(n), doc_id.as_py()), np.full(len(n), no.as_py()), first.astype(np.int64), n, data))
                size += len(data)
                if size > 32 << 20:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return texts.select("id", "no", "text", "runs").mapInArrow(run, RECORDS)


def covered(rows: list[dict], length: int) -> tuple[np.ndarray, ...]:
    """Spans (id, no, low, high) of the suffixes in one bucket that start in a document with a smaller id, too."""

    def column(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(r[name] for r in rows), kind)

    cover, ids, nos, place = column("cover", np.uint64), column("id", np.int64), column("no", np.int64), column("place", np.int64)
    n, data = column("n", np.uint8).astype(np.int64), column("data", np.uint8)
    sizes = n + length - 1
    offset = np.cumsum(sizes) - sizes
    order = np.argsort(cover, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], cover[order][1:] != cover[order][:-1]]))
    several = np.minimum.reduceat(ids[order], first) != np.maximum.reduceat(ids[order], first)
    kept = order[np.repeat(several, np.diff(np.append(first, len(order))))]
    if not len(kept):
        return (np.zeros(0, np.int64),) * 4
    ids, nos, place, n, offset = ids[kept], nos[kept], place[kept], n[kept], offset[kept]
    record = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n)
    at = offset[record] + inner
    eight = words_at(data)
    depths = [*range(0, length - 8, 8), length - 8]
    key = np.zeros(len(at), np.uint64)
    for d in depths:
        key = mixed(key + eight[at + d])
    order = np.argsort(key, kind="stable")
    own = at[order]
    equal = key[order][1:] == key[order][:-1]
    for d in depths:
        word = eight[own + d]
        if not (word[1:] == word[:-1])[equal].all():  # two strings of one hash: sort by the bytes themselves
            order = np.lexsort([eight[at + d] for d in depths])
            own = at[order]
            equal = np.logical_and.reduce([eight[own + d][1:] == eight[own + d][:-1] for d in depths])
            break
    first = np.flatnonzero(np.concatenate([[True], ~equal]))
    least = np.repeat(np.minimum.reduceat(ids[record[order]], first), np.diff(np.append(first, len(order))))
    hit = np.zeros(len(at), bool)
    hit[order] = ids[record[order]] > least
    begin = hit & ~(np.concatenate([[False], hit[:-1]]) & (inner > 0))
    end = hit & ~(np.concatenate([hit[1:], [False]]) & (inner < n[record] - 1))
    of = record[begin]
    return ids[of], nos[of], place[of] + inner[begin], place[of] + inner[end] + length


def spans_of(packed: DataFrame, length: int, buckets: int, parts: int) -> DataFrame:
    """Sort one bucket after the other and pack its spans by the part of their document."""
    fields = arrow_schema(SPANS)

    def solve(rows: list[dict]) -> pa.RecordBatch:
        found = covered(rows, length)
        part = np.mod(found[1], parts)
        order = np.argsort(part, kind="stable")
        out = [
            {"part": int(part[own[0]])} | {c: found[i][own].tobytes() for i, c in enumerate(("id", "no", "low", "high"))}
            for own in (np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ())
        ]
        return pa.RecordBatch.from_pylist(out, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["bucket"] != row["bucket"]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, SPANS)


RESULT = "id bigint, no bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def applied(texts: DataFrame, spans: DataFrame, parts: int) -> DataFrame:
    """The documents without the bytes in their spans; one group is one part of the documents."""

    def cut(key, docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        columns = [np.concatenate([np.frombuffer(x, np.int64) for x in found[c]]) if len(found) else np.zeros(0, np.int64) for c in ("id", "no", "low", "high")]
        order = np.lexsort((columns[2], columns[1], columns[0]))
        ids, nos, low, high = (c[order] for c in columns)
        edges = np.flatnonzero((ids[1:] != ids[:-1]) | (nos[1:] != nos[:-1])) + 1 if len(ids) else []
        own = {(ids[x[0]], nos[x[0]]): x for x in np.split(np.arange(len(ids)), edges) if len(x)}
        out = []
        for doc_id, no, text in zip(docs["id"], docs["no"], docs["text"]):
            raw = np.frombuffer(text, np.uint8)
            change = np.zeros(len(raw) + 1, np.int64)
            if (doc_id, no) in own:
                np.add.at(change, low[own[doc_id, no]], 1)
                np.add.at(change, high[own[doc_id, no]], -1)
            gone = np.cumsum(change)[:-1] > 0
            edge = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((doc_id, no, len(raw), int(gone.sum()), edge, raw[~gone].tobytes()))
        return pd.DataFrame(out, columns=[f.split()[0] for f in RESULT.split(", ")])

    part = F.pmod("no", F.lit(parts)).cast("int").alias("part")
    docs = texts.select(part, "id", "no", "text")
    return docs.groupBy("part").cogroup(spans.groupBy("part")).applyInPandas(cut, RESULT)


def remove_repeated(docs: DataFrame, length: int = LENGTH, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of each row."""
    spark = docs.sparkSession
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    size = F.length("text")
    short = F.when(size < length, F.col("text")).otherwise(F.lit(b"")).alias("short")
    least = rows.groupBy("digest").agg(F.min("id").alias("least"))
    known = cut_lineage(rows.select("id", "digest", size.cast("bigint").alias("n_bytes"), short).join(least, "digest"), "suffix-ids")
    firsts = known.filter("id = least").select("id", "digest")
    texts = rows.join(firsts, ["id", "digest"], "left_semi").select("id", F.xxhash64("digest").alias("no"), "text")
    texts = cut_lineage(with_runs(texts, length), "suffix-texts")
    release(spark)
    total = texts.agg(F.sum(F.length("text")).alias("b")).first()["b"] or 0
    buckets, parts = int(max(8, 5 * total // (blocks * BUCKET_BYTES))), int(max(8, total // PART_BYTES)) | 1
    found = []
    for block in range(blocks):
        found.append(cut_lineage(spans_of(records(texts, length, block, blocks, buckets), length, buckets, parts), "spans"))
        release(spark)
    made = applied(texts, reduce(DataFrame.unionByName, found), parts).drop("no")
    long = F.col("n_bytes") >= length
    gone = F.when(long, F.col("n_bytes")).otherwise(0).alias("n_removed")
    copies = known.filter("id > least").select("id", "n_bytes", gone, long.cast("bigint").alias("n_spans"), F.col("short").alias("kept"))
    out = made.unionByName(copies)
    return out.withColumn("doc_id", F.nullif("id", F.lit(NO_ID))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
