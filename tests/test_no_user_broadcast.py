"""Sides that grow with the users do not pass through the driver."""

import __spark_entry__ as entry


def test_candidates_are_not_broadcast(spark):
    for name in ("rank_components", "rank_composite"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [user_id" not in plan and "SortMergeJoin [user_id" in plan, name
