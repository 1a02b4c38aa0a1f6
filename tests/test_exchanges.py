"""Rows travel once: few distinct texts are broadcast, repeats are found after one exchange, words don't meet every question."""

from pyspark.sql import functions as F

from quarryline.operators import attributes, facts
from quarryline.plans import registry

SF = "/root/testdata/sf0.001"


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_few_texts_are_broadcast_and_many_or_long_are_not(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "c" * 1_001)], "i int, t string")
    read = lambda r: {(x.i, x.n) for x in attributes.with_read(r, "t", F.length, "n").collect()}
    assert read(rows) == {(1, 1), (2, 1), (3, 1), (4, None), (5, 1_001)}
    assert exchanges(attributes.with_read(rows.filter("i < 5"), "t", F.length, "n")) == 0 < exchanges(attributes.with_read(rows, "t", F.length, "n"))
    few = rows.select("t").distinct()
    assert exchanges(attributes.broadcast_if_few(few, most=3)) > 0 and exchanges(attributes.broadcast_if_few(few, most=4, longest=2_000)) == 0


def test_first_of_keeps_the_first_of_each_key(spark):
    rows = spark.createDataFrame([(1, "A", 3, "x"), (1, "a", 2, "y"), (1, None, 5, "z"), (1, None, 4, "w"), (None, "a", 1, "v")], "item int, name string, ord int, other string")
    best = attributes.first_of(rows, [F.lower("name")], ["ord"], ["item"])
    assert exchanges(best) == 1
    assert {(r.item, r.name, r.ord, r.other) for r in best.collect()} == {(1, "a", 2, "y"), (1, None, 4, "w"), (None, "a", 1, "v")}


def test_facts_and_fields_travel_once(spark):
    for name in ("best_facts", "field_resolutions", "fact_search"):
        assert exchanges(registry.queries()[name](spark, SF)) == 1, name
    assert exchanges(registry.queries()["fill_missing_fields"](spark, SF)) <= 2


def test_questions_without_words_or_with_words_in_common(spark):
    index = facts.fact_index(spark.createDataFrame([(1, "Rated voltage", "24 V", 1), (2, "Rated voltage", "30 V", 2), (2, "Mass", "24 kg", 3)], "item int, key string, value string, ord int").withColumns({c: F.lit(None).cast("string") for c in ("source_kind", "source_url", "source_type", "rule")}).withColumn("confidence", F.lit(0.5)))
    asked = spark.createDataFrame([("a", "rated V"), ("b", "24"), ("c", "24 rated 24"), ("d", " "), ("e", None), ("f", "rated kg"), ("a", "rated V")], "question string, text string")
    got = sorted((r.question, r.item, r.ord, r.hits) for r in facts.search_facts(facts.fact_words(index), asked).collect())
    assert got == [("a", 1, 1, 2), ("a", 2, 2, 2), ("b", 1, 1, 1), ("b", 2, 3, 1), ("c", 1, 1, 2)]
