"""Units are read once for each distinct value, and line items stay where they are."""

from quarryline.plans import registry


def test_values_are_read_once(spark):
    plan = registry.queries()["unit_conversion"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
