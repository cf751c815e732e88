"""Thresholds and fixed values of the risk model.

The values below are fixed: results depend on them, so they are stated once, as plain data.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: allowed enumerations -------------------------------------------------------
CRITICALITY = ("Low", "Medium", "High")
COMPLIANCE_STATUS = ("Complete", "Missing SOC2", "Expired Insurance", "Missing DPA", "Incomplete")
INVOICE_STATUS = ("Paid", "Pending", "Overdue")
PO_MATCH = ("Yes", "No")
SEVERITY = ("Low", "Medium", "High", "Critical")
TICKET_STATUS = ("Resolved", "Open", "Escalated")
OPEN_TICKET_STATUS = ("Open", "Escalated")

# --- fixed values: score tables ---------------------------------------------------------------
CRITICALITY_SCORE = {"Low": 1, "Medium": 2, "High": 3}
SECURITY_RATING = {
    "Complete": 88,
    "Incomplete": 72,
    "Missing SOC2": 64,
    "Expired Insurance": 67,
    "Missing DPA": 66,
}
DEFAULT_SECURITY_RATING = 70

# --- fixed values: contract vocabulary --------------------------------------------------------
SECTION_HEADINGS = (
    "Payment Terms",
    "SLA Obligations",
    "Compliance Requirements",
    "Renewal Terms",
    "Termination Rights",
    "Data Security",
    "Escalation Procedure",
)
SECTION_CLAUSE_TYPE = {
    "payment terms": "payment",
    "sla obligations": "sla",
    "compliance requirements": "compliance",
    "renewal terms": "renewal",
    "termination rights": "termination",
    "data security": "general",
    "escalation procedure": "general",
}
CLAUSE_KEYWORDS = {
    "payment": ("payment", "invoice", "billing", "fees"),
    "sla": ("sla", "service level", "availability", "service availability"),
    "compliance": ("compliance", "soc2", "soc 2", "insurance", "privacy", "dpa", "audit"),
    "renewal": ("renewal", "renew", "expiration", "contract end", "non-renewal"),
    "termination": ("termination", "terminate", "breach", "cure period"),
}
EXTRA_QUERY_TERMS = (
    "compliance",
    "sla",
    "invoice",
    "renewal",
    "termination",
    "payment",
    "duplicate",
    "breach",
    "overdue",
    "pending",
)

# --- fixed values: model inputs ---------------------------------------------------------------
MODEL_FEATURES = (
    "total_spend",
    "pending_invoice_amount",
    "overdue_invoice_amount",
    "invoice_count",
    "duplicate_invoice_count",
    "po_mismatch_count",
    "average_resolution_hours",
    "max_resolution_hours",
    "ticket_count",
    "critical_ticket_count",
    "sla_breach_count",
    "sla_breach_rate",
    "days_until_contract_end",
    "renewal_within_90_days",
    "compliance_missing_flag",
    "criticality_score",
)
MODEL_TARGET = "high_risk_vendor"

# metric -> allowed change in percent
DRIFT_THRESHOLDS = {
    "pending_invoice_amount": 30.0,
    "sla_breach_rate": 20.0,
    "compliance_missing_flag": 20.0,
    "duplicate_invoice_count": 30.0,
}

# --- fixed values: result texts ---------------------------------------------------------------
NO_FACTOR_TEXT = "No material risk concentration identified"
COMPLIANCE_FACTOR_TEXT = "Compliance evidence is missing, expired, or incomplete"
DEFAULT_QUERY_TEXT = "vendor risk contract obligations"
WORKFLOW_ACTIONS = {
    "High": "Escalate to procurement manager and block approval until review",
    "Medium": "Request compliance or SLA review before renewal/payment approval",
    "Low": "Approve normal processing",
}
SCORER_ACTIONS = {
    "High compliance": (
        "Open compliance remediation task, hold renewal approval, and request updated audit evidence."
    ),
    "High": "Escalate to procurement owner, review contract protections, and pause discretionary spend.",
    "Medium": "Schedule vendor review, validate invoice exposure, and confirm SLA corrective actions.",
    "Low": "Continue standard monitoring and refresh vendor evidence at the next review cycle.",
}
EVENT_REVIEW = "vendor_risk_review_required"
EVENT_APPROVED = "vendor_risk_auto_approved"


@dataclass(frozen=True)
class Bands:
    """Lower bounds (inclusive) of the High and Medium levels."""

    high: float
    medium: float


@dataclass(frozen=True)
class RiskConfig:
    """Every threshold in one place. There are three band sets, one per score."""

    points_bands: Bands = Bands(70.0, 40.0)  # rule score, 0-100
    probability_bands: Bands = Bands(0.75, 0.45)  # model probability, or rule score / 100
    additive_bands: Bands = Bands(0.70, 0.40)  # additive score, 0-1
    renewal_window_days: int = 90
    pending_limit: float = 100_000.0
    overdue_limit: float = 50_000.0
    sla_floor: float = 5_000.0
    top_k: int = 5
    evidence_top_k: int = 4
    max_factors: int = 6
    top_chart_rows: int = 15
    preview_chars: int = 180


DEFAULT = RiskConfig()
