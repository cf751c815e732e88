"""Explanations, payloads, alerts and routing on vendor rows that carry an evidence list.

Evidence lists hold at most k entries, so everything here is row-wise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurisk.config import DEFAULT, EVENT_APPROVED, EVENT_REVIEW, RiskConfig
from procurisk.functions.text import plain_number, preview

# --- fixed values: columns of the review table -------------------------------------------------
REVIEW_COLUMNS = (
    "vendor_id",
    "vendor_name",
    "risk_score",
    "risk_level",
    "recommended_action",
    "estimated_exposure",
)


def evidence_sources(evidence: Column) -> Column:
    """Distinct sources, sorted."""
    return F.array_sort(F.array_distinct(F.transform(evidence, lambda e: e["source"])))


def evidence_groups(evidence: Column) -> Column:
    """Evidence by clause type in order of first appearance: type, first text, distinct sorted sources."""
    types = F.array_distinct(F.transform(evidence, lambda e: e["clause_type"]))

    def group(clause_type: Column) -> Column:
        members = F.filter(evidence, lambda e: e["clause_type"] == clause_type)
        return F.struct(
            clause_type.alias("clause_type"),
            members[0]["text"].alias("text"),
            evidence_sources(members).alias("sources"),
        )

    return F.transform(types, group)


def explanation(vendor_name: Column, factors: Column, evidence: Column, config: RiskConfig = DEFAULT) -> Column:
    joined = F.array_join(factors, "; ")
    has_factors = F.size(factors) > 0

    def part(group: Column) -> Column:
        return F.concat(
            group["clause_type"],
            F.lit(": "),
            preview(group["text"], config.preview_chars),
            F.lit(" Source: "),
            F.array_join(group["sources"], ", "),
            F.lit("."),
        )

    parts = F.array_join(F.transform(evidence_groups(evidence), part), " ")
    with_evidence = F.concat(
        F.lit("For "),
        vendor_name,
        F.lit(", retrieved contract evidence was compared against: "),
        F.when(has_factors, joined).otherwise("the vendor risk factors"),
        F.lit(". "),
        parts,
    )
    without = F.concat(
        F.lit("No contract clauses were retrieved for "),
        vendor_name,
        F.lit(". Review "),
        F.when(has_factors, joined).otherwise("the supplied risk factors"),
        F.lit(" manually."),
    )
    return F.when(F.size(evidence) > 0, with_evidence).otherwise(without)


def _first_text(*names: str) -> Column:
    """The first of the columns that is neither null nor empty; null when none is."""
    return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names])


def wide_payload() -> Column:
    """The payload for an orchestrator, 12 entries."""
    return F.struct(
        F.when(F.col("human_review_required"), EVENT_REVIEW).otherwise(EVENT_APPROVED).alias("event_type"),
        "vendor_id",
        "vendor_name",
        "risk_score",
        "risk_level",
        "recommended_action",
        "human_review_required",
        _first_text("business_owner", "owner").alias("business_owner"),
        F.col("account_manager"),
        "estimated_financial_exposure",
        "top_risk_factors",
        evidence_sources(F.col("evidence")).alias("evidence_sources"),
    )


def narrow_payload() -> Column:
    """The payload of the response, 8 entries."""
    return F.struct(
        F.when(F.col("human_review_required"), EVENT_REVIEW).otherwise(EVENT_APPROVED).alias("event_type"),
        "vendor_id",
        "vendor_name",
        "risk_level",
        "recommended_action",
        F.coalesce(_first_text("business_owner", "owner"), F.lit("")).alias("owner"),
        "estimated_financial_exposure",
        "top_risk_factors",
    )


def alert_text() -> Column:
    """The message for a High vendor."""
    return F.concat(
        F.lit("🚨 High-Risk Vendor Alert\n\nVendor: "),
        F.col("vendor_name"),
        F.lit("\nRisk Level: "),
        F.col("risk_level"),
        F.lit("\nRisk Score: "),
        plain_number(F.col("risk_score"), 4),
        F.lit("\nEstimated Exposure: $"),
        plain_number(F.col("estimated_financial_exposure"), 2),
        F.lit("\n\nRecommended Action:\n"),
        F.col("recommended_action"),
    )


def route_reviews(analysis: DataFrame) -> DataFrame:
    """High vendors with their review columns and alert text."""
    high = analysis.where(F.col("risk_level") == "High").withColumn(
        "estimated_exposure", F.col("estimated_financial_exposure")
    )
    return high.select(*REVIEW_COLUMNS, alert_text().alias("alert_text"))
