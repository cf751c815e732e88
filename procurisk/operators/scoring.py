"""Portfolio scoring: every vendor in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurisk.config import DEFAULT, RiskConfig
from procurisk.functions import risk
from procurisk.functions.text import round_half_even


def score_by_rules(features: DataFrame, config: RiskConfig = DEFAULT) -> DataFrame:
    """The additive score with its level, factors, action and exposure."""
    level = F.col("risk_level")
    return (
        features.withColumn("risk_score", risk.additive_score(config))
        .withColumn("risk_level", risk.level(F.col("risk_score"), config.additive_bands))
        .withColumns(
            {
                "model_name": F.lit("additive_rules"),
                "top_risk_factors": risk.rule_factors(config),
                "recommended_action": risk.workflow_action(level),
                "estimated_financial_exposure": risk.exposure(level, config),
                "human_review_required": risk.review_required(level),
            }
        )
    )


def _with_scorer_columns(scored: DataFrame, config: RiskConfig) -> DataFrame:
    level, factors = F.col("risk_level"), F.col("top_risk_factors")
    return (
        scored.withColumns(
            {
                "risk_level": risk.level(F.col("risk_score"), config.probability_bands),
                "top_risk_factors": risk.model_factors(config),
            }
        )
        .withColumns(
            {
                "recommended_action": risk.scorer_action(level, factors),
                "estimated_financial_exposure": risk.exposure(level, config),
                "human_review_required": risk.review_required(level),
            }
        )
    )


def rule_probability() -> Column:
    """The rule score brought to 0-1."""
    return round_half_even(F.col("risk_score_rule") / 100.0, 4)


def score_by_rule_points(features: DataFrame, config: RiskConfig = DEFAULT) -> DataFrame:
    """The fallback of the model path: rule score / 100 in the probability bands."""
    scored = features.withColumns({"risk_score": rule_probability(), "model_name": F.lit("rule_based")})
    return _with_scorer_columns(scored, config)


def score_by_probability(
    predictions: DataFrame, model_name: str, probability: str = "probability_1", config: RiskConfig = DEFAULT
) -> DataFrame:
    """Score rows that carry the probability of the high-risk class."""
    scored = predictions.withColumns(
        {"risk_score": round_half_even(F.col(probability), 4), "model_name": F.lit(model_name)}
    )
    return _with_scorer_columns(scored, config)


def logistic(decision: Column) -> Column:
    """Decision value -> 0-1, for models without probabilities."""
    return 1.0 / (1.0 + F.exp(-decision))


def min_max(df: DataFrame, column: str, output: str) -> DataFrame:
    """Scale a column to 0-1 over the whole table; 0.5 everywhere when it is constant."""
    bounds = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    low, high = bounds["low"], bounds["high"]
    scaled = F.try_divide(F.col(column) - low, high - low)
    return df.withColumn(output, F.when(high == low, F.lit(0.5)).otherwise(scaled))


def first_row_per_vendor(features: DataFrame) -> DataFrame:
    """One row per vendor id when the master repeats ids: the smallest row, found by aggregation."""
    rest = [c for c in features.columns if c != "vendor_id"]
    return (
        features.groupBy("vendor_id").agg(F.min(F.struct(*rest)).alias("row")).select("vendor_id", "row.*")
    )


def look_up_vendors(features: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested ids with their feature row; ``exists`` is false for unknown ids."""
    ids = requested.select("vendor_id").distinct()
    known = first_row_per_vendor(features).withColumn("_known", F.lit(True))
    return (
        ids.join(known, "vendor_id", "left")
        .withColumn("exists", F.coalesce(F.col("_known"), F.lit(False)))
        .drop("_known")
    )
