"""A training-data pipeline over documents: quality rules, toxicity, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from procurisk.llm import forest, mixing, packing, repetition, shared, toxicity
from procurisk.llm.queries import PACK_TOKENIZER, table, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return repetition.passing(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model trained on the labelled ones among them does not find toxic."""
    return toxicity.below(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return forest.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of small sources repeated by the target weights, in the order of the block permutations."""
    mixed = mixing.mix(docs).orderBy("mix_progress", "mix_epoch", "mix_block", "source")
    return mixed.select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, one per sequence, with their token ids."""
    return packing.pack(docs, vocabulary(PACK_TOKENIZER))


STAGES = [
    ("quality rules", quality),
    ("toxicity", clean),
    ("near copies", distinct),
    ("mixture", mixture),
    ("packing", sequences),
]

#: A trained model and a tokenizer are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result stored in the shared folder before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
