from fixtures import REFERENCE_DATE, raw_tables
from pyspark.sql import functions as F

from procurisk.config import DEFAULT, NO_FACTOR_TEXT, SCORER_ACTIONS, WORKFLOW_ACTIONS
from procurisk.functions import risk
from procurisk.operators import scoring
from procurisk.plans import jobs

BASE = {
    "vendor_id": "V1",
    "compliance_status": "Complete",
    "compliance_missing_flag": 0,
    "duplicate_invoice_count": 0,
    "sla_breach_count": 0,
    "pending_invoice_amount": 0.0,
    "po_mismatch_count": 0,
    "renewal_within_90_days": 0,
    "overdue_invoice_amount": 0.0,
    "invoice_count": 0,
    "annual_contract_value": 0.0,
    "days_until_contract_end": 10,
    "criticality_score": 1,
    "risk_score_rule": 0.0,
}
SCHEMA = (
    "vendor_id string, compliance_status string, compliance_missing_flag int, duplicate_invoice_count long, "
    "sla_breach_count long, pending_invoice_amount double, po_mismatch_count long, renewal_within_90_days int, "
    "overdue_invoice_amount double, invoice_count long, annual_contract_value double, days_until_contract_end int, "
    "criticality_score int, risk_score_rule double"
)


def rows(spark, *changes):
    return spark.createDataFrame(
        [tuple({**BASE, "vendor_id": f"V{i}", **c}.values()) for i, c in enumerate(changes)], SCHEMA
    )


def column(df, expression):
    return [r[0] for r in df.orderBy("vendor_id").select(expression).collect()]


def test_additive_score_and_inclusive_bands(spark):
    df = rows(
        spark,
        {},
        {"compliance_missing_flag": 1, "renewal_within_90_days": 1},  # .40
        {"duplicate_invoice_count": 1, "sla_breach_count": 2, "compliance_missing_flag": 1},  # .70
        {"sla_breach_count": 1},
        {"pending_invoice_amount": 100000.0, "overdue_invoice_amount": 50000.0, "po_mismatch_count": 1},
        {"pending_invoice_amount": 100000.01, "overdue_invoice_amount": 50000.01, "po_mismatch_count": 2},
        {"compliance_status": "Expired Insurance"},
        {c: 9 for c in ("duplicate_invoice_count", "sla_breach_count", "po_mismatch_count")}
        | {"compliance_missing_flag": 1, "renewal_within_90_days": 1, "pending_invoice_amount": 1e6},
    )
    assert column(df, risk.additive_score()) == [0.0, 0.4, 0.7, 0.15, 0.0, 0.5, 0.25, 1.0]
    levels = column(df, risk.level(risk.additive_score(), DEFAULT.additive_bands))
    assert levels == ["Low", "Medium", "High", "Low", "Low", "Medium", "Low", "High"]


def test_three_band_sets(spark):
    df = spark.createDataFrame([(70.0,), (69.99,), (40.0,), (39.99,), (None,)], "s double")
    got = [r[0] for r in df.select(risk.level(F.col("s"), DEFAULT.points_bands)).collect()]
    assert got == ["High", "Medium", "Medium", "Low", "Low"]
    df = spark.createDataFrame([(0.75,), (0.7499,), (0.45,), (0.4499,)], "s double")
    got = [r[0] for r in df.select(risk.level(F.col("s"), DEFAULT.probability_bands)).collect()]
    assert got == ["High", "Medium", "Medium", "Low"]


def test_label_needs_two_criteria(spark):
    df = rows(
        spark,
        {"compliance_missing_flag": 1},
        {"compliance_missing_flag": 1, "duplicate_invoice_count": 2},
        {"sla_breach_count": 1, "po_mismatch_count": 1, "renewal_within_90_days": 1},
        {"sla_breach_count": 2, "po_mismatch_count": 2},
        {"pending_invoice_amount": 100000.0, "renewal_within_90_days": 1},
    )
    assert column(df, risk.high_risk_label()) == [0, 1, 0, 1, 0]


def test_rule_score(spark):
    df = rows(
        spark,
        {"annual_contract_value": 300000.0},
        {"annual_contract_value": None},
        {c: 9 for c in ("duplicate_invoice_count", "sla_breach_count", "po_mismatch_count")}
        | {"compliance_missing_flag": 1, "annual_contract_value": 9e9, "pending_invoice_amount": 9e9},
        {"criticality_score": 3, "sla_breach_count": 1, "pending_invoice_amount": 116290.0, "annual_contract_value": 1.32e6},
    )
    assert column(df, risk.rule_score()) == [3.6, None, 100.0, 43.47]


def test_exposure(spark):
    df = rows(
        spark,
        {"duplicate_invoice_count": 5, "pending_invoice_amount": 1000.0, "invoice_count": 4},
        {"duplicate_invoice_count": 1, "pending_invoice_amount": 1000.0, "invoice_count": 0},
        {"sla_breach_count": 2, "annual_contract_value": 100000.0, "overdue_invoice_amount": 7.0},
        {"sla_breach_count": 2, "annual_contract_value": 900000.0},
    )
    assert column(df, risk.exposure(F.lit("Low"))) == [750.0, 1000.0, 10007.0, 18000.0]
    assert column(df, risk.exposure(F.lit("Medium"))) == [1750.0, 2000.0, 10007.0, 18000.0]


def test_capped_exposure(spark):
    df = spark.createDataFrame(
        [(1000.0, 1e6, 2, 1, 0), (0.0, 5e6, 1, 2, 91), (0.0, 100.0, 0, 0, -1)],
        "pending_invoice_exposure double, annual_spend double, sla_breach_count int, duplicate_invoice_count int, days_to_renewal int",
    )
    got = [r[0] for r in df.select(risk.exposure_capped()).collect()]
    assert got == [350.0 + 20000 + 15000 + 40000, 25000.0 + 40000, 0.0]


def test_factors_differ_between_the_paths(spark):
    df = rows(
        spark,
        {},
        {"po_mismatch_count": 1, "overdue_invoice_amount": 60000.0},
        {
            "duplicate_invoice_count": 2,
            "sla_breach_count": 3,
            "compliance_missing_flag": 1,
            "renewal_within_90_days": 1,
            "pending_invoice_amount": 1234567.0,
            "po_mismatch_count": 2,
            "overdue_invoice_amount": 60000.0,
        },
    )
    six = [
        "2 duplicate invoice candidates detected",
        "3 SLA breach events identified",
        "Compliance evidence is missing, expired, or incomplete",
        "Contract renewal is within 10 days",
        "High pending invoice exposure: $1,234,567",
        "2 invoices have PO mismatches",
    ]
    assert column(df, risk.model_factors()) == [[NO_FACTOR_TEXT], ["1 invoices have PO mismatches"], six]
    assert column(df, risk.rule_factors()) == [[NO_FACTOR_TEXT], ["Overdue invoice exposure: $60,000"], six]


def test_actions(spark):
    df = spark.createDataFrame(
        [("High", ["Compliance gap"]), ("High", ["late"]), ("Medium", ["Compliance gap"]), ("Low", [])],
        "level string, factors array<string>",
    )
    level = F.col("level")
    got = df.select(risk.scorer_action(level, F.col("factors")), risk.workflow_action(level), risk.review_required(level))
    assert [tuple(r) for r in got.collect()] == [
        (SCORER_ACTIONS["High compliance"], WORKFLOW_ACTIONS["High"], True),
        (SCORER_ACTIONS["High"], WORKFLOW_ACTIONS["High"], True),
        (SCORER_ACTIONS["Medium"], WORKFLOW_ACTIONS["Medium"], True),
        (SCORER_ACTIONS["Low"], WORKFLOW_ACTIONS["Low"], False),
    ]


def test_known_vendor_scores(spark):
    table = jobs.build_features(raw_tables(spark), REFERENCE_DATE)
    got = {
        r["vendor_id"]: (r["risk_score"], r["risk_level"], r["estimated_financial_exposure"])
        for r in jobs.score_portfolio_rules(table).collect()
    }
    assert got == {"V001": (1.0, "High", 534400.0), "V002": (0.35, "Low", 18500.0), "V003": (0.0, "Low", 0.0)}
    fallback = {r["vendor_id"]: r for r in jobs.score_portfolio_model(table).collect()}
    assert fallback["V002"]["risk_level"] == "Medium" and fallback["V002"]["risk_score"] == 0.5399
    assert fallback["V002"]["estimated_financial_exposure"] == 218439.0
    assert fallback["V001"]["model_name"] == "rule_based"


def test_lookup_takes_one_row_and_marks_unknown_ids(spark):
    table = rows(spark, {}, {}).unionByName(rows(spark, {"sla_breach_count": 3}))
    requested = spark.createDataFrame([("V0",), ("V0",), ("V7",)], "vendor_id string")
    got = {r["vendor_id"]: (r["exists"], r["sla_breach_count"]) for r in scoring.look_up_vendors(table, requested).collect()}
    assert got == {"V0": (True, 0), "V7": (False, None)}


def test_min_max_and_logistic(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "x double")
    assert sorted(r["y"] for r in scoring.min_max(df, "x", "y").collect()) == [0.0, 0.5, 1.0]
    constant = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert [r["y"] for r in scoring.min_max(constant, "x", "y").collect()] == [0.5, 0.5]
    assert df.where("x = 1").select(scoring.logistic(F.col("x") - 1.0)).first()[0] == 0.5


def test_percent_change(spark):
    df = spark.createDataFrame([(12.0, 10.0), (3.0, 0.0), (1.0, -2.0), (5.0, 5.0)], "c double, b double")
    assert [r[0] for r in df.select(risk.percent_change(F.col("c"), F.col("b"))).collect()] == [20.0, 300.0, 150.0, 0.0]
