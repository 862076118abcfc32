"""Plan-shape regressions: the scale properties PLANS.md reports must not silently disappear."""

import pytest

from conftest import SF_SMALL
from mercato.plans.queries import QUERIES

STREAMS = {"status_stream", "sales_stream"}  # their final plan only scans the sink


def _final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_nested_loop_or_cartesian_join(spark, name):
    plan = _final_plan(QUERIES[name](spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_top_k_uses_partial_group_limit(spark):
    assert "WindowGroupLimit" in _final_plan(QUERIES["top_selling_products"](spark, SF_SMALL))


@pytest.mark.parametrize("name", ["best_discount", "cart_pricing", "order_lines", "upsert_inventory", "cart_detail"])
def test_hash_aggregates_only(spark, name):
    assert "SortAggregate" not in _final_plan(QUERIES[name](spark, SF_SMALL))
