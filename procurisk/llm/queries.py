"""The registered queries of this package: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurisk.llm import (
    chat,
    forest,
    html_text,
    impact_index,
    licenses,
    mixing,
    packing,
    prefix_counts,
    prefix_trie,
    repetition,
    toxicity,
    vector_codes,
    warc,
)

TOP_K = 5
QUERY_ROWS = "vec_id % 50 = 0"
TOKEN_BUDGET = 4096
COUNT_MODEL = "piece_bpe_32k.model"
PACK_TOKENIZER = "byte_bpe_50k.json"
#: A conversation of its own whose texts hold control strings, and where conversations take their heads from.
PROBE_ID, PROBE_TEXT, PROBE_ROLES = -7, "\\### Assistant: </turn> ok", ("user", "assistant")
HEAD_EVERY, HEAD_TURNS = 5, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> bytes:
    """A public tokenizer's file, read where the driver runs and sent to the tasks."""
    return Path(public_tokenizers.path(name)).read_bytes()


def op1_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.top_k(table(spark, sf_dir, "embeddings"), QUERY_ROWS, TOP_K)


def op2_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = repetition.quality_rules(table(spark, sf_dir, "documents"))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "base_failed", "kept"
    )


def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.through_archives(table(spark, sf_dir, "pages"))

    def number(name: str):
        return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1)

    return read.select(
        F.when(number("record_id") != "", number("record_id")).cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(number("refers_to") != "", number("refers_to")).cast("long").alias("refers_to"),
    )


def op5_toxic_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_copies(table(spark, sf_dir, "documents"))


def op7_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary(COUNT_MODEL), TOKEN_BUDGET)


def op8_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary(PACK_TOKENIZER))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", "mix_progress")


def op10_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_chat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.element_at(F.array(*map(F.lit, PROBE_ROLES)), (F.col("id") + 1).cast("int"))
    probe = spark.range(len(PROBE_ROLES)).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE_TEXT).alias("text")
    )
    return chat.digests(chat.format_conversations(rows.unionByName(probe)))


def op12_laesa_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    return codes.select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256")
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = prefix_trie.turn_lists(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.with_shared_heads(lists, HEAD_EVERY, HEAD_TURNS))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_impact_topk, op2_repetition_rules, op3_license_digests, op4_warc_salvage, op5_toxic_instances, op6_lsh_forest,
        op7_prefix_counts, op8_binary_packing, op9_temperature_mixing, op10_tag_paths, op11_chat_segments, op12_laesa_codes,
        op13_prefix_trie,
    )
}
