"""The texts of a mix: whole copies, and parts that keep what lies between their words."""

import collections
import re

from pyspark.sql import functions as F

from lanternlog.llm import mixing

TEXTS = ["  one two\n\nthree\tfour  five\n", "a", "", None, "x  y\r\nz " * 40, "é\x0b日本 😀\n\n ü"]


def parts(text, takes):
    words = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    for low, high in takes:
        begin = 0 if low == 0 else words[low].start()
        yield text if low == 0 and high == len(words) else text[begin : words[high - 1].end()]


def test_parts_keep_separators(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "no bigint, text string, size string")
    sizes = [len((t or "").encode().split()) for t in TEXTS]
    rows, want = [], collections.Counter()
    for i, (t, n) in enumerate(zip(TEXTS, sizes)):
        copies, low, high, head = i % 2, n // 3, n - n // 4, n // 2
        takes = [(0, n)] * copies + [(low, high), (0, head)]
        rows.append((i, n, copies, low, high, head, copies * n + high - low + head))
        want.update((i, p) for p in parts(t or "", [x for x in takes if x[1] > x[0]]))
    plan = spark.createDataFrame(rows, "no bigint, size bigint, copies bigint, `from` bigint, `to` bigint, head bigint, taken bigint")
    got = mixing.taken_texts(docs, plan, "no")
    assert got.columns == docs.columns
    assert collections.Counter((r.no, r.text) for r in got.collect()) == want


def test_words_of_the_mix(spark, sf):
    """The texts of a whole mix hold the words that it takes of each document, in the document's own spelling."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("no", F.col("doc_id"))
    plan = mixing.mix(docs, row="no")
    taken = {r.no: r.taken for r in plan.collect() if r.taken}
    given = {r.no: r.text for r in docs.collect()}
    count = collections.Counter()
    for r in mixing.taken_texts(docs, plan, "no").collect():
        assert r.text in given[r.no]
        count[r.no] += len(r.text.encode().split())
    assert count == taken
