import datetime

import pytest
from fixtures import REFERENCE_DATE, invoice, raw_tables, ticket, vendor
from pyspark.sql import functions as F

from procurisk.operators import features, portfolio, skew
from procurisk.plans import jobs
from procurisk.sources.schemas import INVOICES, typed


def build(spark, **tables):
    return jobs.build_features(raw_tables(spark, **tables), REFERENCE_DATE)


def by_vendor(df):
    return {r["vendor_id"]: r.asDict() for r in df.collect()}


def test_known_vendors(spark):
    rows = by_vendor(build(spark))
    keys = (
        "total_spend", "paid_spend", "pending_invoice_amount", "invoice_count", "average_resolution_hours",
        "sla_breach_count", "days_until_contract_end", "risk_score_rule",
    )
    assert tuple(float(rows["V001"][k]) for k in keys) == (569927, 199927, 370000, 5, 14.75, 2, 33, 100.0)
    second, third = rows["V002"], rows["V003"]
    assert (second["pending_invoice_amount"], second["sla_breach_rate"]) == (199939, 0.25)
    assert (second["days_until_contract_end"], second["risk_score_rule"], second["risk_level_rule"]) == (
        440,
        53.99,
        "Medium",
    )
    assert (third["total_spend"], third["sla_breach_count"], third["days_until_contract_end"]) == (129997, 0, 198)
    assert (third["risk_score_rule"], third["risk_level_rule"]) == (3.6, "Low")
    assert rows["V001"]["duplicate_invoice_count"] == 2 and rows["V001"]["po_mismatch_count"] == 2
    assert (rows["V001"]["high_risk_vendor"], third["high_risk_vendor"]) == (1, 0)
    assert rows["V001"]["security_rating"] == 64 and rows["V001"]["missing_compliance"] is True
    assert rows["V001"]["contract_file"] == "databridge_solutions_contract.txt"


def test_columns(spark):
    table = build(spark)
    assert table.columns == list(features.FEATURE_COLUMNS) and len(table.columns) == 45


def test_vendor_without_invoices_and_tickets(spark):
    row = build(spark, invoices=[invoice(vendor_id="V003")], tickets=[ticket()], vendors=[vendor(), vendor(vendor_id="V9")])
    got = by_vendor(row)["V9"]
    for name in features._INVOICE_MEASURES + features._TICKET_MEASURES + ("sla_breach_rate", "late_invoice_count"):
        assert got[name] == 0


def test_repeated_master_rows_multiply(spark):
    rows = build(spark, vendors=[vendor(), vendor()], invoices=[invoice()], tickets=[ticket()]).collect()
    assert [(r["vendor_id"], float(r["total_spend"])) for r in rows] == [("V003", 1000.0)] * 2


@pytest.mark.parametrize("days, flag", [(-1, 0), (0, 1), (90, 1), (91, 0)])
def test_renewal_window(spark, days, flag):
    end = (REFERENCE_DATE + datetime.timedelta(days=days)).isoformat()
    row = build(spark, vendors=[vendor(contract_end=end)], invoices=[invoice()], tickets=[ticket()]).first()
    assert (row["days_until_contract_end"], row["renewal_within_90_days"]) == (days, flag)


def test_mean_skips_missing_hours(spark):
    tickets = spark.createDataFrame(
        [("a", "V1", "Low", 3.0, 5.0, "Open"), ("b", "V1", "Low", None, 5.0, None), ("c", "V1", "Critical", 6.0, 5.0, "Escalated")],
        "ticket_id string, vendor_id string, severity string, resolution_hours double, sla_hours double, status string",
    )
    row = features.ticket_features(tickets).first()
    assert (row["average_resolution_hours"], row["max_resolution_hours"], row["ticket_count"]) == (4.5, 6.0, 3)
    assert (row["sla_breach_count"], row["critical_ticket_count"], row["open_ticket_count"]) == (1, 1, 2)


def test_spend_adds_up(spark):
    tables = raw_tables(spark)
    total = typed(tables[INVOICES]).agg(F.sum("amount")).first()[0]
    assert jobs.build_features(tables, REFERENCE_DATE).agg(F.sum("total_spend")).first()[0] == total


def hot_invoices(spark):
    """A third of the rows are copies of one invoice; some keys have nulls."""
    return spark.range(3000).select(
        F.col("id").cast("string").alias("invoice_id"),
        F.when(F.col("id") % 3 == 0, "HOT").when(F.col("id") % 3 == 1, None).otherwise(
            (F.col("id") % 50).cast("string")
        ).alias("vendor_id"),
        F.when(F.col("id") % 7 == 1, None).otherwise(F.lit("2026-01-01")).cast("date").alias("invoice_date"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).cast("decimal(18,2)").alias("amount"),
        F.lit("Paid").alias("invoice_status"),
        F.lit("Yes").alias("po_match"),
    )


@pytest.mark.parametrize("rows_per_salt", [1, 7, 100, 1_000_000])
def test_flags_agree_with_a_window_whatever_the_salts(spark, rows_per_salt):
    from pyspark.sql import Window as W

    invoices = hot_invoices(spark)
    flagged = features.duplicate_flags(invoices, rows_per_salt)
    got = {(r["invoice_id"], r["duplicate_invoice_flag"]) for r in flagged.collect()}
    window = W.partitionBy(*features.DUPLICATE_KEY)
    wanted = invoices.withColumn("flag", F.count("*").over(window) > 1).select("invoice_id", "flag").collect()
    assert flagged.count() == 3000
    assert got == {tuple(r) for r in wanted}


def test_flag_counts_agree_with_the_vendor_measure(spark):
    invoices = hot_invoices(spark)
    flags = features.duplicate_flags(invoices).groupBy("vendor_id").agg(
        F.count_if("duplicate_invoice_flag").alias("n")
    )
    measure = features.invoice_features(invoices).select("vendor_id", "duplicate_invoice_count")
    assert sorted(map(str, flags.collect())) == sorted(
        str(r).replace("duplicate_invoice_count", "n") for r in measure.collect()
    )


def test_salted_join_keeps_every_match(spark):
    big = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (5, "d")], "k long, v string")
    for how in ("inner", "left"):
        plain = big.join(small, "k", how).select("k", "id", "v")
        salted = skew.join_salted(big, small, ["k"], how, rows_per_salt=10).select("k", "id", "v")
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_portfolio_of_known_vendors(spark):
    table = build(spark)
    points = portfolio.portfolio_summary(table).first()
    assert (points["high_risk_vendors"], points["medium_risk_vendors"], points["low_risk_vendors"]) == (1, 1, 1)
    assert points["duplicate_invoice_exposure"] == 148000.0
    # V001 534,400 and V002 218,439 at Medium
    assert points["total_estimated_exposure"] == 534400.0 + 218439.0
    additive = portfolio.portfolio_summary(table, "additive").first()
    assert (additive["high_risk_vendors"], additive["low_risk_vendors"]) == (1, 2)
    assert additive["total_estimated_exposure"] == 534400.0 + 18500.0
    preventable = portfolio.preventable_exposure(table).first()
    assert preventable["renewal_risk_exposure"] == 820000 * 0.04
    assert preventable["sla_penalty_estimate"] == (2 * 820000 + 1850000) * 0.01
    assert [r[0] for r in portfolio.review_queue(table).collect()] == ["V001"]
    assert [r[0] for r in portfolio.top_vendors(table, "total_spend", 2).collect()] == ["V002", "V001"]
    assert [r["vendor_id"] for r in portfolio.renewal_timeline(table).collect()] == ["V001", "V003", "V002"]


def test_empty_portfolio(spark):
    empty = build(spark).where("false")
    row = portfolio.portfolio_summary(empty).first()
    assert (row["total_vendors"], row["total_spend"], row["total_estimated_exposure"]) == (0, 0, 0)
    assert portfolio.preventable_exposure(empty).first()["preventable_exposure"] == 0


def test_roi_grid(spark):
    table = build(spark).where("vendor_id = 'V003'")
    rows = portfolio.roi_grid(table, [("paid", 10, 50, 1000), ("free", 10, 50, 0)]).collect()
    got = {r["scenario"]: r for r in rows}
    assert got["paid"]["labor_savings"] == 6000.0 and got["paid"]["spend_leakage_reduction"] == 1500.0
    assert (got["paid"]["net_benefit"], got["paid"]["roi_percent"]) == (6500.0, 650.0)
    assert (got["free"]["net_benefit"], got["free"]["roi_percent"]) == (7500.0, 0.0)
