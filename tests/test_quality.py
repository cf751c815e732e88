import pytest
from fixtures import INVOICE_COLUMNS, invoice, raw_tables, table, ticket, vendor

from procurisk.operators import features, quality
from procurisk.plans import jobs
from procurisk.sources.schemas import INVOICES, TICKETS, VENDORS, typed


def found(df):
    return {(r["severity"], r["field"], r["affected_rows"]) for r in df.collect()}


def test_shipped_rows_pass_with_two_warnings(spark):
    report = jobs.validate(raw_tables(spark)).first()
    assert report["passed"] and report["errors"] == []
    assert [w["message"] for w in report["warnings"]] == [
        "Vendors have missing or incomplete compliance evidence",
        "Potential duplicate invoices found",
    ]
    assert report["duplicate_invoice_rows"] == 2
    assert (report["error_count"], report["warning_count"]) == (0, 2)
    shapes = {k: (v["rows"], v["columns"]) for k, v in report["datasets"].items()}
    assert shapes == {VENDORS: (3, 11), INVOICES: (15, 10), TICKETS: (12, 8)}


def test_vendor_checks(spark):
    rows = [
        vendor(vendor_id=None),
        vendor(vendor_id=""),
        vendor(vendor_id=" \t"),
        vendor(vendor_name=None),
        vendor(criticality=None),
        vendor(criticality="Severe"),
        vendor(compliance_status=None),
        vendor(contract_start="2026-12-31", contract_end="2026-01-01"),
        vendor(contract_start="2026-01-01", contract_end="2026-01-01"),
        vendor(contract_end="someday"),
        vendor(compliance_status="Missing DPA"),
        vendor(),
    ]
    issues = quality.vendor_issues(raw_tables(spark, vendors=rows)[VENDORS])
    assert found(issues) == {
        ("error", "vendor_id", 3),
        ("error", "vendor_name", 1),
        ("error", "criticality", 2),
        ("error", "compliance_status", 1),
        ("error", "contract_end", 3),
        ("warning", "compliance_status", 2),
    }


def test_invoice_checks(spark):
    rows = [
        invoice(amount="abc"),
        invoice(amount="0"),
        invoice(amount="-1"),
        invoice(amount=None),
        invoice(invoice_status=None, amount="5"),
        invoice(po_match="Maybe", amount="6"),
        invoice(paid_date="", amount="7"),
        invoice(paid_date="2025-12-31", amount="8"),
        invoice(paid_date="later", amount="9"),
        invoice(paid_date="2026-01-01", amount="10"),
        invoice(vendor_id="V999", amount="11"),
        invoice(vendor_id=None, amount="12"),
        invoice(invoice_id="  ", amount="1e3"),
    ]
    tables = raw_tables(spark, invoices=rows)
    assert found(quality.invoice_issues(tables[INVOICES], tables[VENDORS])) == {
        ("error", "invoice_id", 1),
        ("error", "amount", 4),
        ("error", "invoice_status", 1),
        ("error", "po_match", 1),
        ("error", "paid_date", 2),
        ("error", "vendor_id", 1),  # blank
        ("error", "vendor_id", 2),  # unknown, the null one included
    }
    without_master = quality.invoice_issues(tables[INVOICES])
    assert "Invoices reference unknown vendors" not in {r["message"] for r in without_master.collect()}


def test_ticket_checks(spark):
    rows = [
        ticket(severity="Urgent"),
        ticket(status=None),
        ticket(resolution_hours="-1"),
        ticket(resolution_hours="x"),
        ticket(resolution_hours="0"),
        ticket(sla_hours="0"),
        ticket(vendor_id="V404"),
        ticket(ticket_id=None),
    ]
    tables = raw_tables(spark, tickets=rows)
    assert found(quality.ticket_issues(tables[TICKETS], tables[VENDORS])) == {
        ("error", "ticket_id", 1),
        ("error", "severity", 1),
        ("error", "status", 1),
        ("error", "resolution_hours", 2),
        ("error", "sla_hours", 1),
        ("error", "vendor_id", 1),
    }


@pytest.mark.parametrize(
    "rows, affected",
    [
        ([invoice(po_match="Yes"), invoice(po_match="No", invoice_id="INV-2")], 2),
        ([invoice(), invoice(), invoice()], 3),
        ([invoice(amount="1000"), invoice(amount="1000.0")], 2),
        ([invoice(vendor_id=None), invoice(vendor_id=None)], 2),
        ([invoice(amount="abc"), invoice(amount="abd")], 0),
        ([invoice(), invoice(invoice_date="2026-01-02")], 0),
    ],
)
def test_duplicates(spark, rows, affected):
    assert quality.duplicate_row_count(table(spark, INVOICE_COLUMNS, rows)).first()[0] == affected


def test_duplicate_pair_is_a_warning_only(spark):
    tables = raw_tables(spark, invoices=[invoice(), invoice(invoice_id="INV-2", po_match="No")])
    assert found(quality.invoice_issues(tables[INVOICES], tables[VENDORS])) == {("warning", None, 2)}


def test_missing_column_stops_other_checks(spark):
    tables = raw_tables(spark, invoices=[invoice(amount="abc"), invoice()])
    rows = quality.invoice_issues(tables[INVOICES].drop("po_match", "amount"), tables[VENDORS]).collect()
    assert [(r["message"], r["affected_rows"]) for r in rows] == [("Missing columns: ['amount', 'po_match']", 2)]


def test_empty_tables(spark):
    tables = raw_tables(spark, vendors=[], invoices=[], tickets=[])
    report = jobs.validate(tables).first()
    assert not report["passed"]
    assert [e["dataset"] for e in report["errors"]] == [VENDORS, INVOICES, TICKETS]
    assert {e["message"] for e in report["errors"]} == {"Dataset is empty"}


def test_gate(spark):
    quality.gate(raw_tables(spark))
    with pytest.raises(quality.DataQualityError, match="amount must be greater than 0"):
        quality.gate(raw_tables(spark, invoices=[invoice(amount="0")]))


def test_amounts_are_grouped_before_they_are_rounded(spark):
    tables = raw_tables(spark, invoices=[invoice(amount="10.001"), invoice(amount="10.004", invoice_id="INV-2")])
    assert jobs.validate(tables).first()["duplicate_invoice_rows"] == 0
    row = features.invoice_features(typed(tables[INVOICES])).first()
    assert (row["duplicate_invoice_count"], float(row["total_spend"])) == (0, 20.01)
    copies = raw_tables(spark, invoices=[invoice(amount="1e1"), invoice(amount=" 10.000 ", invoice_id="INV-2")])
    assert jobs.validate(copies).first()["duplicate_invoice_rows"] == 2
    assert features.invoice_features(typed(copies[INVOICES])).first()["duplicate_invoice_count"] == 2


@pytest.mark.parametrize("amount", ["1e15", "1e17", "1e300", "1e999"])
def test_amounts_too_large_stop_the_build(spark, amount):
    with pytest.raises(quality.DataQualityError, match="amount must be less than 1e\\+15"):
        quality.gate(raw_tables(spark, invoices=[invoice(amount=amount)]))


def test_largest_amounts_and_hours_keep_their_value(spark):
    tables = raw_tables(spark, invoices=[invoice(amount="999999999999999.25")] * 2, tickets=[ticket(resolution_hours="1e13")])
    quality.gate(tables)
    assert str(features.invoice_features(typed(tables[INVOICES])).first()["total_spend"]) == "1999999999999998.50"
    assert features.ticket_features(typed(tables[TICKETS])).first()["average_resolution_hours"] == 1e13
    with pytest.raises(quality.DataQualityError, match="hours must be less than"):
        quality.gate(raw_tables(spark, tickets=[ticket(sla_hours="1e15")]))
