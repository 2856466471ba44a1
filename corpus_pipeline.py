"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet, and returns the columns of ``documents``; the last
returns the pieces and their places. Low-quality documents go, repeated lines go, one document of each group of near
copies stays, the sources are mixed to their weights, and the mix is packed.

Defined results: see the operators. Rows are told apart by a number of their own, not by their id: of each group of near
copies one row stays, whatever ids are null or repeated, and rows without near copies all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanternlog.llm import classifier, line_dedup, mixing, near_dedup, packing
from lanternlog.llm.common import cut_lineage
from lanternlog.llm.queries import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, written so that every later step reads the same numbers."""
    return cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least one half."""
    model = classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.score(docs, model).filter("score >= 0.5").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that later documents hold, too."""
    out = line_dedup.dedup_lines(docs, ("lang", "source"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    docs = numbered(docs)
    kept = near_dedup.near_duplicates(docs, key="_row").filter("kept").select("_row")
    return docs.join(kept, "_row", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole copies, and the part of the words where a run ends in one."""
    docs = numbered(docs)
    rows = mixing.taken_texts(docs, mixing.mix(docs, row="_row"), "_row")
    return rows.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.placed_pieces(docs, VOCABULARY)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-duplicate removal", near_duplicates),
    ("source mix", mix),
    ("best-fit packing", pack),
]

#: A trained model and hashed samples are not SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
