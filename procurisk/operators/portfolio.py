"""Portfolio KPIs, distributions, rankings, the review queue and ROI scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurisk.config import DEFAULT, WORKFLOW_ACTIONS, RiskConfig
from procurisk.functions import risk
from procurisk.functions.text import round_half_even

CENTS = "decimal(38,2)"
FINE = "decimal(38,10)"


def with_portfolio_level(features: DataFrame, config: RiskConfig = DEFAULT) -> DataFrame:
    """Level of the rule score / 100 in the probability bands."""
    return features.withColumn(
        "portfolio_risk_level", risk.level(F.col("risk_score_rule") / 100.0, config.probability_bands)
    )


def _sum(c: Column, decimal_type: str) -> Column:
    # decimals: the sum does not hinge on the order of the rows
    return F.coalesce(F.sum(c.cast(decimal_type)), F.lit(0)).cast("double")


def _count_level(level: Column, name: str) -> Column:
    return F.count_if(level == name)


def portfolio_summary(
    features: DataFrame, scoring: str = "points", config: RiskConfig = DEFAULT
) -> DataFrame:
    """Counts by level, spend, exposure, duplicates, breaches and renewals in one row.

    ``points`` uses the rule score / 100 in the probability bands, ``additive`` the additive score.
    """
    if scoring == "additive":
        # the summary bands the score as added up, before rounding
        level = risk.level(risk.additive_score_raw(config), config.additive_bands)
    else:
        level = risk.level(F.col("risk_score_rule") / 100.0, config.probability_bands)
    rows = features.withColumn("_level", level).withColumns(
        {"_exposure": risk.exposure(F.col("_level"), config), "_duplicate": risk.duplicate_exposure()}
    )
    totals = rows.agg(
        F.count("*").alias("total_vendors"),
        _count_level(F.col("_level"), "High").alias("high_risk_vendors"),
        _count_level(F.col("_level"), "Medium").alias("medium_risk_vendors"),
        _count_level(F.col("_level"), "Low").alias("low_risk_vendors"),
        _sum(F.col("total_spend"), CENTS).alias("total_spend"),
        _sum(F.col("pending_invoice_amount"), CENTS).alias("pending_invoice_exposure"),
        _sum(F.col("_exposure"), CENTS).alias("total_estimated_exposure"),
        round_half_even(_sum(F.col("_duplicate"), FINE), 2).alias("duplicate_invoice_exposure"),
        F.coalesce(F.sum("sla_breach_count"), F.lit(0)).alias("sla_breach_count"),
        F.coalesce(F.sum("renewal_within_90_days"), F.lit(0)).alias("contracts_expiring_90_days"),
    )
    return totals


def preventable_exposure(features: DataFrame) -> DataFrame:
    """Duplicate, pending and overdue, SLA and renewal exposure, and their total. No floor per breach."""
    value = F.col("annual_contract_value")

    def weighted(counter: str, rate: float) -> Column:
        # exact total first, the rate once
        return _sum(F.col(counter).cast("decimal(15,0)") * value, CENTS) * rate

    parts = features.agg(
        round_half_even(_sum(risk.duplicate_exposure(), FINE), 2).alias("duplicate_invoice_exposure"),
        _sum(F.col("pending_invoice_amount") + F.col("overdue_invoice_amount"), CENTS).alias(
            "pending_overdue_exposure"
        ),
        weighted("sla_breach_count", 0.01).alias("sla_penalty_estimate"),
        weighted("renewal_within_90_days", 0.04).alias("renewal_risk_exposure"),
    )
    total = (
        F.col("duplicate_invoice_exposure")
        + F.col("pending_overdue_exposure")
        + F.col("sla_penalty_estimate")
        + F.col("renewal_risk_exposure")
    )
    return parts.withColumn("preventable_exposure", total)


def spend_by_category(features: DataFrame) -> DataFrame:
    return (
        features.where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(_sum(F.col("total_spend"), CENTS).alias("total_spend"))
    )


def risk_distribution(features: DataFrame, config: RiskConfig = DEFAULT) -> DataFrame:
    return (
        with_portfolio_level(features, config)
        .groupBy(F.col("portfolio_risk_level").alias("risk_level"))
        .agg(F.count("*").alias("vendor_count"))
    )


def compliance_distribution(features: DataFrame) -> DataFrame:
    return (
        features.where(F.col("compliance_status").isNotNull())
        .groupBy("compliance_status")
        .agg(F.count("*").alias("vendor_count"))
    )


def top_vendors(features: DataFrame, measure: str, n: int | None = None) -> DataFrame:
    """The vendors with the largest measure; the vendor id breaks ties."""
    return (
        features.select("vendor_id", "vendor_name", measure)
        .orderBy(F.col(measure).desc(), "vendor_id")
        .limit(n or DEFAULT.top_chart_rows)
    )


RENEWAL_ORDER = ("days_until_contract_end", "vendor_id")


def review_order() -> list[Column]:
    return [F.col("risk_score_rule").desc(), F.col("pending_invoice_amount").desc(), F.col("vendor_id")]


def renewal_timeline(features: DataFrame, config: RiskConfig = DEFAULT) -> DataFrame:
    return (
        with_portfolio_level(features, config)
        .select(
            "vendor_id",
            "vendor_name",
            "contract_end",
            "days_until_contract_end",
            "portfolio_risk_level",
            "annual_contract_value",
        )
        .orderBy(*RENEWAL_ORDER)
    )


def review_queue(features: DataFrame, config: RiskConfig = DEFAULT) -> DataFrame:
    """Vendors labelled high risk or at level High, worst first."""
    chosen = with_portfolio_level(features, config).where(
        (F.col("high_risk_vendor") == 1) | (F.col("portfolio_risk_level") == "High")
    )
    return chosen.select(
        "vendor_id",
        "vendor_name",
        "risk_score_rule",
        "high_risk_vendor",
        "pending_invoice_amount",
        "sla_breach_count",
        "duplicate_invoice_count",
        "days_until_contract_end",
        F.lit(WORKFLOW_ACTIONS["High"]).alias("recommended_action"),
    ).orderBy(*review_order())


def vendor_list(features: DataFrame) -> DataFrame:
    return features.select(
        "vendor_id",
        "vendor_name",
        "category",
        "criticality",
        F.concat_ws(" — ", "vendor_id", "vendor_name").alias("label"),
    )


# name, analyst hours saved per month, hourly rate, automation cost per year
DEFAULT_SCENARIOS = (
    ("low", 20.0, 45.0, 30000.0),
    ("base", 60.0, 55.0, 60000.0),
    ("free", 10.0, 40.0, 0.0),
)


def roi_grid(
    features: DataFrame,
    scenarios: Sequence[tuple[str, float, float, float]] = DEFAULT_SCENARIOS,
    config: RiskConfig = DEFAULT,
) -> DataFrame:
    """ROI of every scenario for every category, from spend and exposure per category."""
    exposures = with_portfolio_level(features, config).withColumn(
        "_exposure", risk.exposure(F.col("portfolio_risk_level"), config)
    )
    totals = exposures.groupBy("category").agg(
        _sum(F.col("annual_spend"), CENTS).alias("annual_spend"),
        _sum(F.col("_exposure"), CENTS).alias("avoided"),
    )
    grid = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                F.lit(float(hours)).alias("hours"),
                F.lit(float(rate)).alias("rate"),
                F.lit(float(cost)).alias("cost"),
            )
            for name, hours, rate, cost in scenarios
        ]
    )
    rows = totals.withColumn("s", F.explode(grid)).select("category", "annual_spend", "avoided", "s.*")
    labor = F.col("hours") * F.col("rate") * 12.0
    leakage = F.col("annual_spend") * 0.005
    gross = labor + F.col("avoided") + leakage
    net = gross - F.col("cost")
    percent = F.when(F.col("cost") == 0, F.lit(0.0)).otherwise(F.try_divide(net, F.col("cost")) * 100.0)
    return rows.select(
        "category",
        "scenario",
        round_half_even(labor, 2).alias("labor_savings"),
        round_half_even(leakage, 2).alias("spend_leakage_reduction"),
        round_half_even(F.col("avoided"), 2).alias("avoided_exposure"),
        round_half_even(gross, 2).alias("gross_benefit"),
        round_half_even(net, 2).alias("net_benefit"),
        round_half_even(percent, 1).alias("roi_percent"),
    )
