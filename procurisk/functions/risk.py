"""Risk flags, scores, levels, factors, exposure and actions as column expressions.

All of them are evaluated on vendor rows, after aggregation. Scores use doubles in a fixed order of
addition, so they carry the same bits wherever they are computed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from procurisk.config import (
    COMPLIANCE_FACTOR_TEXT,
    CRITICALITY_SCORE,
    DEFAULT,
    DEFAULT_SECURITY_RATING,
    NO_FACTOR_TEXT,
    SCORER_ACTIONS,
    SECURITY_RATING,
    WORKFLOW_ACTIONS,
    Bands,
    RiskConfig,
)
from procurisk.functions.text import money, round_half_even


def _dbl(name: str) -> Column:
    return F.col(name).cast("double")


def _int(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def _min(c: Column, bound: float) -> Column:
    # least() skips nulls; a null input has to stay null
    return F.when(c.isNotNull(), F.least(c, F.lit(bound)))


def _max(c: Column, bound: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(bound)))


def _lookup(c: Column, table: dict, default) -> Column:
    result = None
    for key, value in table.items():
        result = F.when(c == key, value) if result is None else result.when(c == key, value)
    return result.otherwise(default)


def criticality_score() -> Column:
    return _lookup(F.col("criticality"), CRITICALITY_SCORE, 1)


def security_rating() -> Column:
    return _lookup(F.col("compliance_status"), SECURITY_RATING, DEFAULT_SECURITY_RATING)


def compliance_missing_flag() -> Column:
    return (~F.col("compliance_status").eqNullSafe("Complete")).cast("int")


def renewal_flag(config: RiskConfig = DEFAULT) -> Column:
    return _int(F.col("days_until_contract_end").between(0, config.renewal_window_days))


def sla_breach_rate() -> Column:
    breaches, tickets = _dbl("sla_breach_count"), _dbl("ticket_count")
    return F.coalesce(F.try_divide(breaches, tickets), F.lit(0.0))


def high_risk_label(config: RiskConfig = DEFAULT) -> Column:
    """1 when at least two of six criteria hold."""
    criteria = (
        F.col("compliance_missing_flag") == 1,
        F.col("duplicate_invoice_count") > 0,
        F.col("sla_breach_count") >= 2,
        F.col("renewal_within_90_days") == 1,
        _dbl("pending_invoice_amount") > config.pending_limit,
        F.col("po_mismatch_count") >= 2,
    )
    total = F.lit(0)
    for criterion in criteria:
        total = total + _int(criterion)
    return (total >= 2).cast("int")


def rule_score() -> Column:
    """Rule score, 0 to 100 with two decimals."""
    points = (
        F.col("compliance_missing_flag") * 20
        + F.least(F.col("duplicate_invoice_count"), F.lit(3)) * 10
        + F.least(F.col("sla_breach_count"), F.lit(4)) * 8
        + F.col("renewal_within_90_days") * 12
    ).cast("double")
    score = (
        points
        + _min(_dbl("pending_invoice_amount") / 100000.0, 2.0) * 10.0
        + (F.least(F.col("po_mismatch_count"), F.lit(3)) * 8).cast("double")
        + (F.greatest(F.lit(0), F.col("criticality_score") - 1) * 4).cast("double")
        + _min(_dbl("annual_contract_value") / 1000000.0, 1.5) * 12.0
    )
    return round_half_even(_min(score, 100.0), 2)


def additive_score_raw(config: RiskConfig = DEFAULT) -> Column:
    """Additive score, 0 to 1, not rounded."""
    status = F.lower(F.coalesce(F.col("compliance_status"), F.lit("")))
    gap = (F.col("compliance_missing_flag") == 1) | status.contains("missing") | status.contains("expired")
    breaches = F.col("sla_breach_count")

    def add(condition: Column, weight: float) -> Column:
        return F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))

    score = (
        add(gap, 0.25)
        + add(F.col("duplicate_invoice_count") > 0, 0.20)
        + F.when(breaches >= 2, F.lit(0.25)).when(breaches >= 1, F.lit(0.15)).otherwise(F.lit(0.0))
        + add(_dbl("pending_invoice_amount") > config.pending_limit, 0.20)
        + add(F.col("po_mismatch_count") >= 2, 0.15)
        + add(F.col("renewal_within_90_days") == 1, 0.15)
        + add(_dbl("overdue_invoice_amount") > config.overdue_limit, 0.15)
    )
    return F.least(score, F.lit(1.0))


def additive_score(config: RiskConfig = DEFAULT) -> Column:
    return round_half_even(additive_score_raw(config), 4)


def level(score: Column, bands: Bands) -> Column:
    """High / Medium / Low; a null score is Low."""
    return F.when(score >= bands.high, "High").when(score >= bands.medium, "Medium").otherwise("Low")


def _factor_candidates(po_minimum: int, config: RiskConfig) -> list[Column]:
    duplicates, breaches, mismatches = (
        F.col(c) for c in ("duplicate_invoice_count", "sla_breach_count", "po_mismatch_count")
    )
    pending = _dbl("pending_invoice_amount")

    def text(*parts) -> Column:
        return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    return [
        F.when(duplicates > 0, text(duplicates, " duplicate invoice candidates detected")),
        F.when(breaches > 0, text(breaches, " SLA breach events identified")),
        F.when(F.col("compliance_missing_flag") == 1, F.lit(COMPLIANCE_FACTOR_TEXT)),
        F.when(
            F.col("renewal_within_90_days") == 1,
            text("Contract renewal is within ", F.col("days_until_contract_end"), " days"),
        ),
        F.when(pending > config.pending_limit, text("High pending invoice exposure: ", money(pending))),
        F.when(mismatches >= po_minimum, text(mismatches, " invoices have PO mismatches")),
    ]


def _factor_list(candidates: list[Column], config: RiskConfig) -> Column:
    found = F.slice(F.array_compact(F.array(*candidates)), 1, config.max_factors)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_FACTOR_TEXT)))


def model_factors(config: RiskConfig = DEFAULT) -> Column:
    """Factor list of the model path: any PO mismatch counts, overdue amounts do not."""
    return _factor_list(_factor_candidates(1, config), config)


def rule_factors(config: RiskConfig = DEFAULT) -> Column:
    """Factor list of the rule path: two PO mismatches needed, overdue amounts count."""
    overdue = _dbl("overdue_invoice_amount")
    extra = F.when(
        overdue > config.overdue_limit, F.concat(F.lit("Overdue invoice exposure: "), money(overdue))
    )
    return _factor_list([*_factor_candidates(2, config), extra], config)


def exposure(risk_level: Column, config: RiskConfig = DEFAULT) -> Column:
    """Financial exposure of a vendor at the given level."""
    pending = _dbl("pending_invoice_amount")
    duplicates = F.col("duplicate_invoice_count")
    duplicate_part = F.when(
        duplicates > 0,
        pending * F.least(duplicates, F.lit(3)).cast("double")
        / F.greatest(_dbl("invoice_count"), F.lit(1.0)),
    ).otherwise(F.lit(0.0))
    pending_part = F.when(risk_level.isin("High", "Medium"), pending).otherwise(F.lit(0.0))
    penalty = _dbl("sla_breach_count") * _max(_dbl("annual_contract_value") * 0.01, config.sla_floor)
    return round_half_even(duplicate_part + _dbl("overdue_invoice_amount") + pending_part + penalty, 2)


def exposure_capped() -> Column:
    """The alternative exposure formula with caps per breach and per duplicate."""
    spend = _dbl("annual_spend")
    days = F.col("days_to_renewal")
    renewal = F.when(days.between(0, 90), spend * 0.04).otherwise(F.lit(0.0))
    return round_half_even(
        _dbl("pending_invoice_exposure") * 0.35
        + _dbl("sla_breach_count") * _min(spend * 0.01, 25000.0)
        + _dbl("duplicate_invoice_count") * _min(spend * 0.015, 20000.0)
        + renewal,
        2,
    )


def duplicate_exposure() -> Column:
    """Share of the pending amount that sits in duplicates; the divisor is 1 without invoices."""
    divisor = F.when(F.col("invoice_count") == 0, F.lit(1.0)).otherwise(_dbl("invoice_count"))
    capped = F.least(F.col("duplicate_invoice_count"), F.lit(3)).cast("double")
    return _dbl("pending_invoice_amount") * capped / divisor


def scorer_action(risk_level: Column, factors: Column) -> Column:
    """Action text of the model path; High splits on compliance among the factors."""
    compliance = F.lower(F.array_join(factors, " ")).contains("compliance")
    return (
        F.when((risk_level == "High") & compliance, SCORER_ACTIONS["High compliance"])
        .when(risk_level == "High", SCORER_ACTIONS["High"])
        .when(risk_level == "Medium", SCORER_ACTIONS["Medium"])
        .otherwise(SCORER_ACTIONS["Low"])
    )


def workflow_action(risk_level: Column) -> Column:
    return (
        F.when(risk_level == "High", WORKFLOW_ACTIONS["High"])
        .when(risk_level == "Medium", WORKFLOW_ACTIONS["Medium"])
        .otherwise(WORKFLOW_ACTIONS["Low"])
    )


def review_required(risk_level: Column) -> Column:
    return risk_level.isin("High", "Medium")


def percent_change(current: Column, baseline: Column) -> Column:
    size = F.abs(baseline)
    divisor = F.when(size > 1e-9, size).otherwise(F.lit(1.0))
    return round_half_even((current - baseline) / divisor * 100.0, 2)
