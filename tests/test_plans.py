"""What no plan may hold: cross joins, row-at-a-time Python, unbounded windows."""

import os

import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_plan_has_no_cross_join_and_no_row_udf(spark, name):
    plan = contract.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert banned not in plan


def test_report_scans_read_only_their_columns(spark):
    plan = contract.queries()["agg_topic_summary"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "summary" not in schema and "topic_id" in schema


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = contract.queries()["topk_lexical"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # partial and final
