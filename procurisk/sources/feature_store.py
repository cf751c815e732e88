"""The feature store: vendors, their invoice and ticket measures and the features, bucketed and sorted by vendor id.

Jobs that read the store join and group by vendor without a shuffle. The ids carry Parquet statistics and Bloom filters, so that a look-up
of a few ids opens few row groups of few buckets.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurisk.config import DEFAULT, RiskConfig
from procurisk.operators import features
from procurisk.session import open_bucketed, write_bucketed

KEY = "vendor_id"
TABLES = ("vendors", "invoice_measures", "ticket_measures", "features")
_FILTERS = {f"parquet.bloom.filter.enabled#{KEY}": "true"}


@dataclass
class FeatureStore:
    vendors: DataFrame
    invoice_measures: DataFrame
    ticket_measures: DataFrame
    features: DataFrame

    def look_up(self, ids: Sequence[str]) -> DataFrame:
        """A row for each of a few ids, with ``exists`` and the features (null for an id that nobody knows).

        The ids are part of the filter, so buckets and row groups without them are not read. Of a repeated id the smallest row counts.
        """
        wanted = sorted({str(i) for i in ids if i is not None})
        spark = self.features.sparkSession
        asked = spark.createDataFrame([(i,) for i in wanted], T.StructType([T.StructField(KEY, T.StringType())]))
        rest = [c for c in self.features.columns if c != KEY]
        known = self.features.where(F.col(KEY).isin(wanted)).groupBy(KEY).agg(F.min(F.struct(*rest)).alias("row"))
        found = asked.join(known, KEY, "left")
        return found.select(KEY, F.col("row").isNotNull().alias("exists"), "row.*")


def write_store(
    vendors: DataFrame,
    invoices: DataFrame,
    tickets: DataFrame,
    reference_date: datetime.date,
    folder: str,
    buckets: int | None = None,
    config: RiskConfig = DEFAULT,
) -> FeatureStore:
    """Build and store all four tables. The features come from the three stored ones, and are written where they lie."""
    spark = vendors.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    measures = {
        "vendors": vendors,
        "invoice_measures": features.invoice_features(invoices),
        "ticket_measures": features.ticket_features(tickets),
    }
    stored = {name: write_bucketed(df, f"{folder}/{name}", KEY, count, **_FILTERS) for name, df in measures.items()}
    built = features.features_of_measures(*stored.values(), reference_date, config)
    stored["features"] = write_bucketed(built, f"{folder}/features", KEY, count, **_FILTERS)
    spark.range(1).select(F.lit(count).alias("buckets")).write.mode("overwrite").parquet(f"{folder}/layout")
    return FeatureStore(**stored)


def open_store(spark: SparkSession, folder: str) -> FeatureStore:
    """A store that was written before, also by another session."""
    buckets = spark.read.parquet(f"{folder}/layout").first()["buckets"]
    return FeatureStore(**{name: open_bucketed(spark, f"{folder}/{name}", KEY, buckets) for name in TABLES})
