"""Schemas of the base tables.

Raw tables are read as strings, so that a bad value becomes a data-quality issue and not a failed read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
#: Invoice amounts keep six decimals, so that rounding comes after grouping. The gate refuses values from ``TOO_LARGE`` on:
#: smaller ones fit here, and so do their totals.
AMOUNT = T.DecimalType(24, 6)
TOO_LARGE = 1e15

VENDORS = "vendor_master.csv"
INVOICES = "invoices.csv"
TICKETS = "support_tickets.csv"

# --- fixed values: columns every raw table must have -------------------------------------------
REQUIRED_COLUMNS = {
    VENDORS: (
        "vendor_id",
        "vendor_name",
        "category",
        "criticality",
        "compliance_status",
        "contract_start",
        "contract_end",
        "account_manager",
        "business_owner",
        "annual_contract_value",
    ),
    INVOICES: (
        "invoice_id",
        "vendor_id",
        "invoice_date",
        "due_date",
        "paid_date",
        "amount",
        "invoice_status",
        "po_match",
        "currency",
        "cost_center",
    ),
    TICKETS: (
        "ticket_id",
        "vendor_id",
        "created_date",
        "severity",
        "resolution_hours",
        "sla_hours",
        "status",
        "issue_type",
    ),
}

# --- fixed values: texts that a CSV reader of data frames takes as missing ----------------------
MISSING_TEXTS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

_DATE_COLUMNS = ("contract_start", "contract_end", "invoice_date", "due_date", "paid_date", "created_date")
_MONEY_COLUMNS = ("annual_contract_value",)
_HOUR_COLUMNS = ("resolution_hours", "sla_hours")


def number(c: Column) -> Column:
    """A double, or null where the text is not a number."""
    text = c.cast("string")
    plain = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    return F.when(plain, text.try_cast("double"))


def amount_value(c: Column) -> Column:
    """An invoice amount as a decimal, or null where the text is not a number."""
    return F.when(number(c).isNotNull(), c.cast("string").try_cast(AMOUNT))


def typed(raw: DataFrame) -> DataFrame:
    """Cast the columns of a raw table; values that do not parse become null."""
    columns = []
    for name in raw.columns:
        if name in _DATE_COLUMNS:
            columns.append(F.col(name).try_cast("date").alias(name))
        elif name in _MONEY_COLUMNS:
            columns.append(F.col(name).try_cast(MONEY).alias(name))
        elif name == "amount":
            columns.append(amount_value(F.col(name)).alias(name))
        elif name in _HOUR_COLUMNS:
            columns.append(number(F.col(name)).alias(name))
        else:
            columns.append(F.col(name).cast("string").alias(name))
    return raw.select(*columns)
