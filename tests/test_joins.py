"""Joins of tables that grow with the records are dealt by key: no side of them is broadcast, whatever the files' size.

improved_brand is left out: it broadcasts similarities of at most FEW_PAIRS counted pairs (see test_large_tables).
"""

import pytest

from veriframe.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["turn_search", "bin_refs", "bin_fields", "bin_complete", "bin_validity", "mapping_outcomes", "rescue_outcomes", "rescue_recompare", "model_rescue", "brand_verdict_fuzzy"])
def test_no_broadcast(spark, name):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
