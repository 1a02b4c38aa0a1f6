"""Localised urls: parts are spread, a template is filled with what it asks for."""

from pyspark.sql import functions as F

from quarryline.functions.keys import fill_template
from quarryline.plans import registry

SF = "/root/testdata/sf0.001"


def test_parts_are_spread_before_their_urls_are_made(spark):
    assert "Exchange hashpartitioning(p_partkey" in registry.queries()["localized_urls"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    made = spark.createDataFrame([("A:b c",)], "k string").select(*[fill_template(t, F.col("k")) for t in ("{part}/{partDash}", F.lit("{part}/{partDash}"), "none")]).first()
    assert list(made) == ["A%3Ab%20c/a-b-c"] * 2 + ["none"]
