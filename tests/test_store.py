"""The feature store: no shuffle below its joins, look-ups that skip data, and duplicate flags that leave unique rows in place."""

import datetime
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from procurisk.functions import risk
from procurisk.operators import features
from procurisk.sources import feature_store, roles

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    tables = (roles.vendors(spark, SF_DIR), roles.invoices_portfolio(spark, SF_DIR), roles.tickets(spark, SF_DIR))
    folder = str(tmp_path_factory.mktemp("store"))
    return folder, feature_store.write_store(*tables, roles.REFERENCE_DATE, folder, buckets=4)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_stored_features_are_the_built_ones(spark, store):
    folder, stored = store
    built = features.vendor_features(
        roles.vendors(spark, SF_DIR), roles.invoices_portfolio(spark, SF_DIR), roles.tickets(spark, SF_DIR), roles.REFERENCE_DATE
    )
    again = feature_store.open_store(spark, folder)
    for table in (stored.features, again.features):
        assert table.columns == built.columns
        assert sorted(map(str, table.collect())) == sorted(map(str, built.collect()))


@needs_data
def test_no_exchange_below_joins_of_stored_tables(spark, store, no_broadcast):
    folder, _ = store
    stored = feature_store.open_store(spark, folder)
    rebuilt = features.features_of_measures(stored.vendors, stored.invoice_measures, stored.ticket_measures, roles.REFERENCE_DATE)
    plan = plan_of(rebuilt)
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan  # J1, J2
    requested = spark.createDataFrame([("1",), ("x",)], "vendor_id string")
    plan = plan_of(requested.join(stored.features, "vendor_id", "left"))  # J8: only the requests travel
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("FileScan")
    assert "Exchange" not in plan_of(stored.features.groupBy("vendor_id").agg(F.max(risk.rule_score()).alias("score")))


def rows_read(df):
    """Rows that left the scans of an executed query."""
    total, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if "AdaptiveSparkPlan" in node.getClass().getSimpleName():
            nodes.append(node.executedPlan())
            continue
        if "QueryStage" in node.getClass().getSimpleName():
            nodes.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return total


def test_look_up_reads_few_rows(spark, tmp_path):
    vendors = spark.range(4000).select(
        F.format_string("v%05d", "id").alias("vendor_id"), F.concat(F.lit("Name "), "id").alias("vendor_name"), F.lit("Tools").alias("category"),
        F.lit("US").alias("country"), F.lit("Low").alias("criticality"), F.lit("owner").alias("business_owner"),
        F.lit("manager").alias("account_manager"), F.lit(datetime.date(2025, 1, 1)).alias("contract_start"),
        F.lit(datetime.date(2027, 1, 1)).alias("contract_end"), F.lit(10).cast("decimal(18,2)").alias("annual_contract_value"),
        F.lit("Complete").alias("compliance_status"),
    )
    missing = set(roles.vendors(spark, SF_DIR).columns) - set(vendors.columns) if os.path.isdir(SF_DIR) else set()
    vendors = vendors.withColumns({c: F.lit(None).cast("string") for c in missing})
    nothing = (roles.invoices_portfolio(spark, SF_DIR).limit(0), roles.tickets(spark, SF_DIR).limit(0))
    stored = feature_store.write_store(vendors, *nothing, datetime.date(2026, 6, 17), str(tmp_path / "store"), buckets=40)
    found = stored.look_up(["v00007", "v03999", "unknown", "v00007", None])
    got = {r["vendor_id"]: (r["exists"], r["vendor_name"]) for r in found.collect()}
    assert got == {"v00007": (True, "Name 7"), "v03999": (True, "Name 3999"), "unknown": (False, None)}
    assert 2 <= rows_read(found) <= 450  # three of 40 buckets at most, of 4,000 rows
    assert stored.look_up([]).count() == 0


# duplicate flags

INVOICES = "invoice_id string, vendor_id string, invoice_date date, amount decimal(18,6), other string"


def invoices(spark, n, copies):
    day = datetime.date(2025, 5, 5)
    rows = [(f"i{i}", f"v{i % 50}", day, Decimal(i), "x") for i in range(n)]
    rows += [(f"c{i}", f"v{i % copies}", day, Decimal(10**6 + i % copies), "x") for i in range(2 * copies)]
    rows += [("n1", None, None, None, None), ("n2", None, None, None, "y"), ("n3", None, day, None, None), (None, "v1", day, Decimal(10**7), None)]
    return spark.createDataFrame(rows, INVOICES), {f"c{i}" for i in range(2 * copies)} | {"n1", "n2"}


@pytest.mark.parametrize("bits", [features.FILTER_BITS, 4096, 1])
def test_flags_with_any_size_of_the_bitmap(spark, monkeypatch, bits):
    monkeypatch.setattr(features, "FILTER_BITS", bits)
    table, repeated = invoices(spark, 500, 20)
    flagged = features.duplicate_flags(table, rows_per_salt=10)
    assert flagged.count() == table.count() and flagged.columns == [*table.columns, "duplicate_invoice_flag"]
    assert {r["invoice_id"] for r in flagged.where("duplicate_invoice_flag").collect()} == repeated
    assert features.duplicate_flags(table.limit(0)).count() == 0


def jobs_run(spark, action):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "")
    try:
        result = action()
        return result, len(tracker.getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_flags_run_nothing_early_and_leave_unique_rows(spark, no_broadcast):
    """Building the plan starts no job, and rows whose key is unique are not part of any shuffle of invoices."""
    table, repeated = invoices(spark, 3000, 5)
    flagged, started = jobs_run(spark, lambda: features.duplicate_flags(table))
    assert started == 0
    written = []
    flagged.collect()
    nodes = [flagged._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if "AdaptiveSparkPlan" in kind:
            nodes.append(node.executedPlan())
            continue
        if "QueryStage" in kind:
            nodes.append(node.plan())
            continue
        if kind == "ShuffleExchangeExec" and "invoice_id" in node.output().toString():
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    assert written and max(written) < 100  # of 3,014 invoices; 12 are repeated
