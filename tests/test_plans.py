"""The plans that Spark chooses: what must and what must not be in them."""

import os
import re

import pytest

import __spark_entry__ as entry_point

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
WITH_JOINS = (
    "analysis auc_histogram chunk_numbers contract_match dq_report dq_unknown_vendors drift_report duplicate_flags "
    "evidence_filter keyword_topk portfolio_summary roi_grid score_normalization split_rows vector_topk "
    "vendor_features vendor_lookup vendor_name_pairs vendor_preferred_topk"
).split()


def plan_of(spark, name):
    return entry_point.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as for sides too large to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", WITH_JOINS)
def test_no_pairwise_joins_and_no_row_functions(spark, no_broadcast, name):
    plan = plan_of(spark, name)
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert unwanted not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "invoice_features")
    scan = re.search(r"FileScan parquet \[([^\]]*)\].*ReadSchema: ([^\n]*)", plan)
    assert len(scan.group(1).split(",")) == 6  # of 11 columns
    # every line item counts: no date cut below the portfolio
    assert not re.search(r"PushedFilters: \[[^\]]*l_shipdate", plan_of(spark, "vendor_features"))


def test_features_shuffle_invoices_twice_and_tickets_once(spark, no_broadcast):
    plan = plan_of(spark, "vendor_features")
    assert plan.count("Exchange hashpartitioning(vendor_id#") == 4  # key, vendor, tickets, master
    assert "Window" not in plan


def test_top_lists_do_not_sort_everything(spark):
    for name in ("top_sla", "top_pending", "top_duplicates"):
        assert "TakeOrderedAndProject" in plan_of(spark, name)


def test_ranks_are_cut_before_the_shuffle(spark):
    plan = plan_of(spark, "vendor_preferred_topk")
    assert plan.count("row_number(), 5, Partial") == 2


def test_flags_pass_unique_invoices_by_through_a_bitmap(spark):
    plan = plan_of(spark, "duplicate_flags")  # tests/test_store.py counts the rows that are shuffled
    assert "bitmap_construct_agg" in plan and "BroadcastHashJoin" in plan and "Window" not in plan



def test_splitting_contracts_needs_no_shuffle(spark):
    from procurisk.operators import contracts
    from procurisk.sources import readers

    folder = os.path.dirname(os.path.abspath(__file__))
    texts = readers.read_contracts(spark, folder)
    for operator in (contracts.clause_chunks, contracts.clause_sections):
        plan = operator(texts)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("posexplode") == 1


def test_evidence_is_worked_out_once(spark):
    for name in ("keyword_topk", "evidence_groups"):
        plan = plan_of(spark, name)
        assert plan.count("regexp_extract_all(") == 1, name


def test_texts_are_split_and_their_words_looked_up_once(spark):
    assert "Supplementary Terms" not in plan_of(spark, "chunk_numbers")
    assert "md5(" not in plan_of(spark, "text_vectors")
