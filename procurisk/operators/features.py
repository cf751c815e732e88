"""One feature row per vendor from vendors, invoices and tickets."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurisk.config import DEFAULT, OPEN_TICKET_STATUS, RiskConfig
from procurisk.functions import risk
from procurisk.functions.text import contract_file_name
from procurisk.operators.skew import ROWS_PER_SALT, join_salted

DUPLICATE_KEY = ("vendor_id", "invoice_date", "amount")
TOTAL = "decimal(28,2)"
HOURS = "decimal(30,6)"

_INVOICE_MEASURES = (
    "total_spend",
    "paid_spend",
    "pending_invoice_amount",
    "overdue_invoice_amount",
    "invoice_count",
    "duplicate_invoice_count",
    "po_mismatch_count",
)
_TICKET_MEASURES = (
    "average_resolution_hours",
    "max_resolution_hours",
    "ticket_count",
    "critical_ticket_count",
    "sla_breach_count",
    "open_ticket_count",
)

# --- fixed values: column order of the stored table --------------------------------------------
FEATURE_COLUMNS = (
    "vendor_id",
    "vendor_name",
    "category",
    "country",
    "criticality",
    "contract_start",
    "contract_end",
    "compliance_status",
    "account_manager",
    "business_owner",
    "annual_contract_value",
    "annual_spend",
    "owner",
    "contract_file",
    "security_rating",
    "total_spend",
    "paid_spend",
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
    "open_ticket_count",
    "sla_breach_rate",
    "contract_end_date",
    "days_until_contract_end",
    "renewal_within_90_days",
    "compliance_missing_flag",
    "criticality_score",
    "high_risk_vendor",
    "pending_invoice_exposure",
    "days_to_renewal",
    "missing_compliance",
    "avg_response_hours",
    "max_days_late",
    "late_invoice_count",
    "total_invoice_amount",
    "risk_score_rule",
    "risk_level_rule",
    "risk_target",
)


def invoice_key_groups(invoices: DataFrame) -> DataFrame:
    """One row per (vendor, date, amount) with counters only; null keys group together.

    A group with more than one row holds duplicates. The counters combine before the shuffle, so a key
    that many copies share costs one row per task.
    """
    status = F.col("invoice_status")
    return invoices.groupBy(*DUPLICATE_KEY).agg(
        F.count("*").alias("copies"),
        F.count("invoice_id").alias("invoices"),
        F.count_if(status == "Paid").alias("paid"),
        F.count_if(status == "Pending").alias("pending"),
        F.count_if(status == "Overdue").alias("overdue"),
        F.count_if(F.col("po_match") == "No").alias("mismatches"),
    )


def invoice_features(invoices: DataFrame) -> DataFrame:
    """Invoice measures per vendor: two aggregations, no window over the invoices.

    The amount is part of the first key, so every sum is amount times a counter.
    """

    def total(counter: str) -> Column:
        return F.sum(F.col("amount") * F.col(counter).cast("decimal(15,0)")).cast(TOTAL)

    return (
        invoice_key_groups(invoices)
        .groupBy("vendor_id")
        .agg(
            total("copies").alias("total_spend"),
            total("paid").alias("paid_spend"),
            total("pending").alias("pending_invoice_amount"),
            total("overdue").alias("overdue_invoice_amount"),
            F.sum("invoices").alias("invoice_count"),
            F.sum(F.when(F.col("copies") > 1, F.col("copies")).otherwise(F.lit(0))).alias(
                "duplicate_invoice_count"
            ),
            F.sum("mismatches").alias("po_mismatch_count"),
        )
    )


def ticket_features(tickets: DataFrame) -> DataFrame:
    """Ticket measures per vendor. Hours are added as decimals: the sum does not hinge on row order."""
    hours, sla = F.col("resolution_hours"), F.col("sla_hours")
    return tickets.groupBy("vendor_id").agg(
        F.try_divide(F.sum(hours.try_cast(HOURS)).cast("double"), F.count(hours).cast("double")).alias(
            "average_resolution_hours"
        ),
        F.max(hours).alias("max_resolution_hours"),
        F.count("ticket_id").alias("ticket_count"),
        F.count_if(F.col("severity") == "Critical").alias("critical_ticket_count"),
        F.count_if(hours > sla).alias("sla_breach_count"),
        F.count_if(F.col("status").isin(*OPEN_TICKET_STATUS)).alias("open_ticket_count"),
    )


#: Size of the bitmap of possibly repeated keys: 16 MB. With more invoices than that, more of them are looked at closely.
FILTER_BITS = 1 << 27


def duplicate_flags(invoices: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Every invoice with a flag telling whether its (vendor, date, amount) occurs more than once.

    No window over the key: a key shared by very many invoices would sit in one task. A bitmap of bounded size, built by aggregation,
    tells which invoices may have an equal: those whose key hash falls into a bucket with another invoice. Only these are counted by
    key and meet the repeated keys, large groups salted; all others pass by without a shuffle. The plan runs nothing by itself.
    """
    keys = [F.col(c) for c in DUPLICATE_KEY]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS)) + 1  # bitmap functions count from 1
    shared = invoices.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    bitmap = shared.groupBy(F.expr("bitmap_bucket_number(_bucket)").alias("_part")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(_bucket))").alias("_bits")
    )
    part, at = F.call_function("bitmap_bucket_number", bucket), F.call_function("bitmap_bit_position", bucket)
    # FILTER_BITS / 32768 rows of 4 KB at most
    marked = invoices.withColumns({"_part": part, "_at": at}).join(F.broadcast(bitmap), "_part", "left")
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(F.col("_at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may_repeat = F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False))
    rows = marked.withColumn("_may_repeat", may_repeat)
    unique = rows.where(~F.col("_may_repeat")).select(*invoices.columns, F.lit(False).alias("duplicate_invoice_flag"))
    possible = rows.where("_may_repeat").select(*invoices.columns)
    repeated = possible.groupBy(*DUPLICATE_KEY).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    flagged = join_salted(possible, repeated, DUPLICATE_KEY, "left", sizes=repeated, rows_per_salt=rows_per_salt)
    found = flagged.withColumn("duplicate_invoice_flag", F.col("n").isNotNull())
    return unique.unionByName(found.select(*invoices.columns, "duplicate_invoice_flag"))


def vendor_features(
    vendors: DataFrame,
    invoices: DataFrame,
    tickets: DataFrame,
    reference_date: datetime.date,
    config: RiskConfig = DEFAULT,
) -> DataFrame:
    """Vendor rows with all measures, flags, labels and scores (45 columns)."""
    return features_of_measures(vendors, invoice_features(invoices), ticket_features(tickets), reference_date, config)


def features_of_measures(
    vendors: DataFrame,
    invoice_measures: DataFrame,
    ticket_measures: DataFrame,
    reference_date: datetime.date,
    config: RiskConfig = DEFAULT,
) -> DataFrame:
    """The same from measures per vendor. Where all three are stored by vendor, nothing is shuffled."""
    joined = vendors.join(invoice_measures, "vendor_id", "left").join(ticket_measures, "vendor_id", "left")
    filled = joined.withColumns(
        {
            **{c: F.coalesce(F.col(c), F.lit(0)) for c in _INVOICE_MEASURES},
            **{c: F.coalesce(F.col(c), F.lit(0)) for c in _TICKET_MEASURES},
        }
    )
    if "country" not in vendors.columns:
        filled = filled.withColumn("country", F.lit(None).cast("string"))
    base = filled.withColumns(
        {
            "annual_spend": F.col("annual_contract_value"),
            "owner": F.col("business_owner"),
            "contract_file": contract_file_name(F.col("vendor_name")),
            "security_rating": risk.security_rating(),
            "sla_breach_rate": risk.sla_breach_rate(),
            "contract_end_date": F.col("contract_end"),
            "days_until_contract_end": F.datediff(F.col("contract_end"), F.lit(reference_date)),
            "compliance_missing_flag": risk.compliance_missing_flag(),
            "criticality_score": risk.criticality_score(),
            "pending_invoice_exposure": F.col("pending_invoice_amount"),
            "avg_response_hours": F.col("average_resolution_hours"),
            "max_days_late": F.lit(0),
            "late_invoice_count": (F.col("overdue_invoice_amount") > 0).cast("int"),
            "total_invoice_amount": F.col("total_spend"),
        }
    )
    flagged = base.withColumns(
        {
            "renewal_within_90_days": risk.renewal_flag(config),
            "days_to_renewal": F.col("days_until_contract_end"),
            "missing_compliance": F.col("compliance_missing_flag") == 1,
        }
    )
    scored = flagged.withColumns(
        {"high_risk_vendor": risk.high_risk_label(config), "risk_score_rule": risk.rule_score()}
    ).withColumns(
        {
            "risk_level_rule": risk.level(F.col("risk_score_rule"), config.points_bands),
            "risk_target": F.col("high_risk_vendor"),
        }
    )
    return scored.select(*FEATURE_COLUMNS)
