"""The pipeline's stages, each against brute force on what its predecessor kept."""

import collections

import corpus_pipeline as pipeline
from lanternlog.llm import classifier
from lanternlog.llm.common import cut_lineage

from test_documents import brute_lines, brute_near


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = [docs.collect()]
    for name, stage in pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf), "stage")
        held.append(docs.collect())
        assert name == pipeline.STAGES[-1][0] or docs.columns == pipeline.COLUMNS
    given, good, clean, apart, mixed, packed = held

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = classifier.train(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    scores = model.scores([classifier.encode(r["text"]) for r in given])
    assert sorted(r["doc_id"] for r in good) == sorted(r["doc_id"] for r, s in zip(given, scores) if s >= 0.5)

    want = {d: text for d, _, _, text in brute_lines([r.asDict() for r in good])}
    assert {r["doc_id"]: r["text"] for r in clean} == want and all(r["n_chars"] == len(r["text"]) for r in clean)

    roots = brute_near([r.asDict() for r in clean], 5, 80)
    assert {r["doc_id"] for r in apart} == {d for d, _, least in roots if d == least}

    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in apart}
    taken = collections.Counter()
    for r in mixed:
        taken[r["doc_id"]] += len(r["text"].encode().split())
    assert all(n <= 2 * size[d] for d, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 200

    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == collections.Counter(r["doc_id"] for r in mixed)
    room = collections.Counter()
    for r in packed:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 1024 and len(room) <= -(-sum(room.values()) // 1024) + 3


def test_rows_with_null_and_repeated_ids(spark):
    """Of each group of near copies one row goes on, and every row without near copies, whatever their ids are."""
    texts = [" ".join(f"t{i}w{k}" for k in range(60)) for i in range(5)]
    rows = [(3, texts[0]), (5, texts[0] + " end"), (5, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[2] + " end"), (7, texts[4]), (7, texts[4]), (8, ""), (8, "")]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = pipeline.near_duplicates(spark, docs, "").collect()
    assert collections.Counter((r["doc_id"], r["text"].removesuffix(" end")) for r in got) == collections.Counter(
        [(3, texts[0]), (5, texts[1]), (None, texts[2]), (None, texts[3]), (7, texts[4]), (8, ""), (8, "")]
    )
    twice = docs.filter("n_chars > 0")
    taken = collections.Counter(w for r in pipeline.mix(spark, twice, "").collect() for w in r["text"].split())
    assert max(taken[w] for w in texts[1].split()) <= 2 and max(taken[w] for w in texts[4].split()) <= 4
    assert abs(sum(taken.values()) - 1.5 * sum(len(r["text"].split()) for r in twice.collect())) < 20
