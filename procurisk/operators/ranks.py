"""Positions and running totals over a whole table, without bringing it into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from procurisk.session import cut_lineage


def running_totals(df: DataFrame, order: Sequence[Column | str], totals: Mapping[str, Column], ranges: int | None = None) -> DataFrame:
    """Add, for each name, the sum of its column over all rows before this one in the order.

    Rows are dealt into ranges of the order and stored; each range is added up, and only the totals of the ranges (one row each) pass
    through one task. Within a range a window does the rest. The order should leave no ties: tied rows are in some order.
    """
    count = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(*[F.sum(column).alias(f"_sum_{name}") for name, column in totals.items()])
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("_range", *[F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_start_{name}") for name in totals])
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    here = {name: F.col(f"_start_{name}") + F.coalesce(F.sum(column).over(inside), F.lit(0)) for name, column in totals.items()}
    return ranged.join(F.broadcast(starts), "_range").withColumns(here).drop("_range", *[f"_start_{name}" for name in totals])


def with_positions(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Add the place of every row in the order, from 1."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}).withColumn(name, F.col(name) + 1)


def area_under_roc(histogram: DataFrame, score: str = "score") -> DataFrame:
    """One row with ``area``, from distinct scores with their ``positives`` and ``negatives``; ties count half, null for a single class."""
    beaten = running_totals(histogram, [score], {"lower_negatives": F.col("negatives")})
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("positives", "negatives", "lower_negatives")}
    totals = beaten.agg(
        F.sum(wide["positives"] * (wide["lower_negatives"] * 2 + wide["negatives"])).alias("twice"),
        F.sum("positives").cast("double").alias("p"),
        F.sum("negatives").cast("double").alias("q"),
    )
    return totals.select(F.try_divide(F.col("twice").cast("double") / 2.0, F.col("p") * F.col("q")).alias("area"))
