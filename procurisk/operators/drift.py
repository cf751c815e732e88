"""Drift of monitored feature means against a stored baseline."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurisk.config import DRIFT_THRESHOLDS
from procurisk.functions.risk import percent_change
from procurisk.functions.text import round_half_even
from procurisk.operators.training import mean


def metric_means(features: DataFrame, metrics: Mapping[str, float] = DRIFT_THRESHOLDS) -> DataFrame:
    """(metric, value): one row per monitored mean."""
    missing = [m for m in metrics if m not in features.columns]
    if missing:
        raise ValueError(f"vendor features lack monitored columns: {missing}")
    return features.agg(*[mean(m).alias(m) for m in metrics]).unpivot(
        [], [F.col(m) for m in metrics], "metric", "value"
    )


def drift_report(
    features: DataFrame, baseline: DataFrame, thresholds: Mapping[str, float] = DRIFT_THRESHOLDS
) -> DataFrame:
    """One row per metric: baseline and current mean, change in percent, and whether it drifted.

    ``baseline`` has (metric, value); a metric it lacks counts as 0, of a repeated one the least value counts.
    """
    current = metric_means(features, thresholds).select("metric", F.col("value").alias("current_value"))
    monitored = baseline.where(F.col("metric").isin(*thresholds)).groupBy("metric").agg(F.min("value").alias("value"))
    before = monitored.select("metric", round_half_even(F.col("value"), 6).alias("_baseline"))
    limit = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])[F.col("metric")]
    # one row per monitored metric on either side
    joined = current.join(F.broadcast(before), "metric", "left").select(
        "metric",
        F.coalesce(F.col("_baseline"), F.lit(0.0)).alias("baseline_value"),
        "current_value",
        limit.alias("threshold_percent"),
    )
    change = percent_change(F.col("current_value"), F.col("baseline_value"))
    return joined.withColumn("percent_change", change).select(
        "metric",
        "baseline_value",
        "current_value",
        "percent_change",
        "threshold_percent",
        (F.abs("percent_change") > F.col("threshold_percent")).alias("drift_detected"),
    )


def overall_drift(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("drift_detected"))
