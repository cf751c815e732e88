"""Sources: raw CSV tables, contract folders, stored Parquet tables."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurisk.sources.schemas import INVOICES, MISSING_TEXTS, TICKETS, VENDORS


# a quote inside a quoted cell is doubled
_CSV = {"header": True, "escape": '"'}


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """One raw table, every column as string, missing-value texts as null."""
    try:
        header = spark.read.options(**_CSV).csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"Missing required raw dataset: {path}") from error
        raise
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header.columns])
    table = spark.read.schema(schema).options(**_CSV).csv(path)
    return table.select(
        *[F.when(~F.col(c).isin(*MISSING_TEXTS), F.col(c)).alias(c) for c in table.columns]
    )


def read_raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_raw_csv(spark, os.path.join(folder, name)) for name in (VENDORS, INVOICES, TICKETS)}


def read_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*.txt`` of a folder, one row per file with its whole text."""
    return (
        spark.read.option("pathGlobFilter", "*.txt")
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_name").alias("contract_file"), F.col("value").alias("text"))
    )


def read_contract_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every ``*.txt`` of a folder with its place: files of any size, cut into splits.

    ``split_start`` and ``at`` order the lines of a file; only plain line ends cut, as in the row form.
    """
    lines = spark.read.option("pathGlobFilter", "*.txt").option("lineSep", "\n").text(folder)
    return lines.select(
        F.col("_metadata.file_name").alias("contract_file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(file_system.exists(hadoop_path))


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The stored table; when there is none yet, build it, store it, and read it back."""
    if not path_exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
