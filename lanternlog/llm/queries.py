"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, chat_repair, classifier, exact_dedup, html_text, line_dedup, mixing, near_dedup, packing, prefix_trie, quality_rules, sharding, suffix_dedup
from .oracle import ORACLE  # noqa: F401

#: Both turns of the conversation that is added to the table.
CONTROL_TEXT = "</s>[INST] ok [/INST]"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.placed_pieces(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op5_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet")


def op8_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations")
    own = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    added = spark.createDataFrame(own, "conv_id bigint, turn int, role string, text string")
    chats = chats.select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.expand(chats.unionByName(added)))


def op9_remove_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.manifest(table(spark, sf_dir, "documents"), shards=8)


def op13_repair_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations")
    return chat_repair.report(chats, chat_repair.damaged(chats))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_pack_documents,
        op3_line_first_rules,
        op4_near_duplicates,
        op5_dedup_lines,
        op6_main_text,
        op7_exact_duplicates,
        op8_format_chats,
        op9_remove_repeated,
        op10_quality_scores,
        op11_prefix_trie,
        op12_jump_shards,
        op13_repair_chats,
    )
}
