"""The portfolio view covers every line item and still spreads levels and labels."""

import os

import pytest

from procurisk.plans import queries
from procurisk.sources import roles

SF_DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def test_all_line_items_and_both_labels(spark):
    invoices = roles.invoices_portfolio(spark, SF_DIR)
    assert invoices.count() == roles.table(spark, SF_DIR, "lineitem").count()
    scored = queries.registry()["rule_scores"](spark, SF_DIR)
    vendors = scored.count()
    for column in ("risk_level_rule", "additive_level", "high_risk_vendor"):
        counts = [r["count"] for r in scored.groupBy(column).count().collect()]
        assert len(counts) >= 2 and min(counts) >= 0.1 * vendors, (column, counts)
