"""Sinks: feature table, chunk table with its metadata, reports, review rows, models."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurisk.operators.forest import ForestModel
from procurisk.operators.training import Model
from procurisk.sources.readers import path_exists


def write_features(features: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = features.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_chunks(chunks: DataFrame, path: str, vector_column: str | None = "vector") -> None:
    """The chunk table, with vectors where there are any."""
    chunks.write.mode("overwrite").parquet(path)
    spark = chunks.sparkSession
    chunk_metadata(spark.read.parquet(path), vector_column).write.mode("overwrite").json(
        path.rstrip("/") + "_metadata"
    )


def chunk_metadata(chunks: DataFrame, vector_column: str | None = "vector") -> DataFrame:
    """One row: number of chunks, number of contracts, width of the vectors."""
    width = (
        F.coalesce(F.max(F.size(vector_column)), F.lit(0))
        if vector_column and vector_column in chunks.columns
        else F.lit(0)
    )
    return (
        chunks.groupBy("contract_file")
        .agg(F.count("*").alias("n"), width.alias("width"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"),
            F.count("*").alias("contract_count"),
            F.coalesce(F.max("width"), F.lit(0)).alias("embedding_dimension"),
        )
    )


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def append_reviews(reviews: DataFrame, path: str, run_id: str | None = None) -> None:
    """Add the review rows of a run, with the time of writing, to the table.

    A run that is repeated under its ``run_id`` replaces its own rows and leaves those of other runs; without one it is a run of its own.
    """
    # the run's own folder is the partition: a repeated run without rows empties it, which a dynamic overwrite would not
    folder = f"{path.rstrip('/')}/run_id={quote(run_id or uuid.uuid4().hex, safe='')}"
    reviews.withColumn("updated_at", F.current_timestamp()).write.mode("overwrite").parquet(folder)


def save_model(model: Model, path: str) -> None:
    if isinstance(model, ForestModel):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> Model:
    return ForestModel.load(spark, path) if path_exists(spark, f"{path}/nodes") else PipelineModel.load(path)
