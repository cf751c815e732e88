"""Literal rows of three vendors with known results, and builders for edge cases."""

import datetime

from procurisk.sources.schemas import INVOICES, REQUIRED_COLUMNS, TICKETS, VENDORS

REFERENCE_DATE = datetime.date(2026, 6, 17)

VENDOR_COLUMNS = [
    "vendor_id", "vendor_name", "category", "country", "criticality", "contract_start", "contract_end",
    "compliance_status", "account_manager", "business_owner", "annual_contract_value",
]
INVOICE_COLUMNS = list(REQUIRED_COLUMNS[INVOICES])
TICKET_COLUMNS = list(REQUIRED_COLUMNS[TICKETS])

# --- fixed values: three vendors, their invoices and tickets -----------------------------------
VENDOR_ROWS = [
    ("V001", "DataBridge Solutions", "Data Processing", "USA", "High", "2024-08-01", "2026-07-20", "Missing SOC2", "Priya Shah", "Data Engineering", "820000"),
    ("V002", "CloudNova Systems", "Cloud Infrastructure", "USA", "High", "2024-08-01", "2027-08-31", "Complete", "Maya Chen", "Infrastructure", "1850000"),
    ("V003", "Supportly India", "Customer Support", "India", "Low", "2025-01-01", "2027-01-01", "Complete", "Arjun Mehta", "Customer Operations", "300000"),
]
# vendor, date, amount, paid date (None: not paid), status, purchase order matches
INVOICE_ROWS = [
    ("V001", "2026-01-10", "60564", "2026-01-28", "Paid", "Yes"),
    ("V001", "2026-02-06", "61200", "2026-02-19", "Paid", "Yes"),
    ("V001", "2026-03-13", "78163", "2026-03-25", "Paid", "Yes"),
    ("V001", "2026-04-10", "185000", None, "Pending", "No"),
    ("V001", "2026-04-10", "185000", None, "Pending", "No"),
    ("V002", "2026-01-09", "152417", "2026-02-02", "Paid", "Yes"),
    ("V002", "2026-02-07", "172258", "2026-02-17", "Paid", "Yes"),
    ("V002", "2026-03-14", "139194", "2026-04-06", "Paid", "Yes"),
    ("V002", "2026-04-10", "138981", "2026-04-30", "Paid", "Yes"),
    ("V002", "2026-05-09", "199939", None, "Pending", "Yes"),
    ("V003", "2026-01-07", "27908", "2026-01-31", "Paid", "Yes"),
    ("V003", "2026-02-05", "29278", "2026-02-27", "Paid", "Yes"),
    ("V003", "2026-03-12", "23668", "2026-04-10", "Paid", "Yes"),
    ("V003", "2026-04-10", "26013", "2026-04-22", "Paid", "Yes"),
    ("V003", "2026-05-14", "23130", "2026-06-02", "Paid", "Yes"),
]
# vendor, severity, resolution hours, agreed hours, status
TICKET_ROWS = [
    ("V001", "Medium", "7", "12", "Resolved"),
    ("V001", "High", "3", "6", "Resolved"),
    ("V001", "High", "30", "6", "Resolved"),
    ("V001", "Critical", "19", "2", "Escalated"),
    ("V002", "Low", "14", "24", "Resolved"),
    ("V002", "High", "2", "6", "Resolved"),
    ("V002", "Medium", "9", "12", "Resolved"),
    ("V002", "High", "11", "6", "Resolved"),
    ("V003", "Medium", "11", "12", "Resolved"),
    ("V003", "Low", "10", "24", "Resolved"),
    ("V003", "Medium", "4", "12", "Resolved"),
    ("V003", "Low", "8", "24", "Resolved"),
]


def vendor(**changes):
    base = dict(zip(VENDOR_COLUMNS, VENDOR_ROWS[2]))
    return {**base, **changes}


def invoice(**changes):
    base = {
        "invoice_id": "INV-1", "vendor_id": "V003", "invoice_date": "2026-01-01", "due_date": "2026-01-31",
        "paid_date": None, "amount": "1000", "invoice_status": "Pending", "po_match": "Yes",
        "currency": "USD", "cost_center": "DATA-ENG",
    }
    return {**base, **changes}


def ticket(**changes):
    base = {
        "ticket_id": "T-1", "vendor_id": "V003", "created_date": "2026-01-01", "severity": "Low",
        "resolution_hours": "5", "sla_hours": "24", "status": "Resolved", "issue_type": "Billing",
    }
    return {**base, **changes}


def table(spark, columns, rows):
    """A raw table: every column as text."""
    data = [tuple(None if row[c] is None else str(row[c]) for c in columns) for row in rows]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns))


def raw_tables(spark, vendors=None, invoices=None, tickets=None):
    if vendors is None:
        vendors = [dict(zip(VENDOR_COLUMNS, row)) for row in VENDOR_ROWS]
    if invoices is None:
        invoices = [
            invoice(
                invoice_id=f"INV-{i}", vendor_id=v, invoice_date=d, amount=a, paid_date=p, invoice_status=s, po_match=m
            )
            for i, (v, d, a, p, s, m) in enumerate(INVOICE_ROWS)
        ]
    if tickets is None:
        tickets = [
            ticket(ticket_id=f"T-{i}", vendor_id=v, severity=s, resolution_hours=r, sla_hours=h, status=t)
            for i, (v, s, r, h, t) in enumerate(TICKET_ROWS)
        ]
    return {
        VENDORS: table(spark, VENDOR_COLUMNS, vendors),
        INVOICES: table(spark, INVOICE_COLUMNS, invoices),
        TICKETS: table(spark, TICKET_COLUMNS, tickets),
    }


CONTRACT = """DataBridge Solutions Master Services Agreement

Payment Terms
Invoices are billed monthly. Undisputed invoices are paid by the due date.

SLA Obligations
Vendor keeps 95% service availability.

An extra paragraph that belongs to the heading above it
and has a second line.

Closing Remarks

Vendor keeps evidence of compliance after the closing heading.

Short but a sentence.
"""
