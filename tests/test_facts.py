"""Facts and cells: ranks, repeats, ties, odd rows, the stored index, and rules against plain loops."""

import random

import pytest

from quarryline.operators import facts

FACT = "item int, key string, value string, source_kind string, source_url string, source_type string, rule string, confidence double, ord int, extra string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (10 - len(r))) for r in rows], FACT)


def plain_rank(r):
    kind = {"attribute": 40, "normalized": 34, "document": 32, "repair": 28}.get(r[3], 20)
    return kind + 10 * {"official": 4, "official-fallback": 3, "generated": 2, "cache": 1, "distributor": -2}.get(r[5], 0) + (r[7] or 0.0)


def test_best_fact_equals_a_full_scan(spark):
    rng = random.Random(6)
    pick = lambda *v: rng.choice(v)
    rows = [(pick(1, 2, None), pick("a", "b", None), pick("x", "X!", "y 1", "", None, "±"), pick("attribute", "repair", "other", None), pick("u", None), pick("official", "distributor", "odd", None), pick("r", None), pick(0.5, 0.9, None), i % 40) for i in range(300)]
    index = facts.fact_index(table(spark, rows)).cache()
    seen, best = {}, {}
    for r in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2]), key=lambda r: r[8]):
        bare = "".join(c for c in r[2].lower() if c.isascii() and c.isalnum()) or r[2]
        key = (r[0], r[1], bare, r[3] or "", r[4] or "", r[6] or "")
        seen.setdefault(key, r[8])
        best[r[:2]] = None
    assert sorted((r.item, r.key, r.comparable, r.source_kind or "", r.source_url or "", r.rule or "", r.ord) for r in index.collect()) == sorted((*k, v) for k, v in seen.items())
    listed = index.collect()
    for r in facts.best_facts(index).collect():
        among = [x for x in listed if (x.item, x.key) == (r.item, r.key)]
        assert (r["rank"], r.ord) == min(((x["rank"], x.ord) for x in among), key=lambda p: (-p[0], p[1]))
    assert {(r.item, r.key) for r in facts.best_facts(index).collect()} == set(best)
    assert all(abs(x["rank"] - plain_rank((0, 0, 0, x.source_kind, 0, x.source_type, 0, x.confidence))) < 1e-9 for x in listed)


def test_lookups(spark):
    index = facts.fact_index(table(spark, [(1, "ratedVoltage", "24 V", "attribute", None, None, None, 0.5, 1), (1, "mass", "2.4 kg", "repair", None, None, None, 0.5, 2), (2, "ratedVoltage", "24 V", "attribute", None, None, None, None, 3), (1, "sign", "±", "repair", None, None, None, 0.1, 4)]))
    asked = spark.createDataFrame([(1, "24"), (1, "about 24 V DC"), (1, "!"), (2, None), (3, "24")], "item int, asked string")
    assert sorted((r.item, r.asked, r.key) for r in facts.facts_with_value(index, asked).collect()) == [(1, "24", "mass"), (1, "24", "ratedVoltage"), (1, "about 24 V DC", "ratedVoltage")]
    questions = spark.createDataFrame([(1, "Voltage 24"), (2, "kg"), (3, "kg volt"), (4, ""), (5, None)], "question int, text string")
    found = facts.search_facts(facts.fact_words(index), questions)
    assert sorted((r.question, r.item, r.ord) for r in found.collect()) == [(1, 1, 1), (1, 2, 3), (2, 1, 2)]
    assert facts.fact_index(table(spark, [])).count() == 0 and facts.best_facts(facts.fact_index(table(spark, []))).count() == 0


def test_stored_index_is_read_without_a_shuffle(spark, tmp_path):
    index = facts.fact_index(table(spark, [(i % 7, f"k{i % 3}", f"v{i}", "attribute", None, None, None, 0.5, i) for i in range(60)]))
    spark.sql("DROP TABLE IF EXISTS facts_for_test")
    stored = facts.store_index(index, "facts_for_test", 4)
    try:
        best = facts.best_facts(stored)
        assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.item, r.key, r.ord) for r in best.collect()) == sorted((r.item, r.key, r.ord) for r in facts.best_facts(index).collect())
    finally:
        spark.sql("DROP TABLE facts_for_test")


@pytest.mark.parametrize("rules, want", [
    ([("U", 1, "label", "rated voltage", "unit", "V")], {("U", "24")}), ([("U", 1, "label", "voltage", "number", None)], {("U", "24")}), ([("U", 1, "label", "voltage", "number", None), ("W", 1, "label", "rated voltage", "text", None)], {("W", "24 V"), ("U", "690")}),
    ([("Y", 1, "label", "marked", "yes_no", None)], {("Y", "yes")}), ([("N", 2, "fact", "mass", "text", None), ("N", 1, "fact", "nothing", "text", None)], {("N", "2 kg")}), ([("N", 1, "fact", "mass", "yes_no", None), ("N", 2, "fact", "mass", "unit", "g")], {("N", "2000")}),
    ([(None, 1, "fact", "mass", "text", None), ("E", 1, "label", "", "text", None)], set()), ([], set()),
])
def test_cells(spark, rules, want):
    attributes = spark.createDataFrame(
        [(1, 1, "Insulation voltage", "690 V", None, None, 0.9), (1, 2, "Rated voltage", "24 V", "u", "official", 0.5), (1, 3, "Marked", "Yes, it is", None, None, None), (1, 4, None, "x", None, None, None), (1, 5, "Voltage", None, None, None, None)],
        "item int, ord int, name string, value string, source_url string, source_type string, confidence double",
    )
    index = facts.fact_index(table(spark, [(1, "mass", "2 kg", "repair", "w", None, None, 0.5, 1)]))
    got = facts.resolve_columns(attributes, index, spark.createDataFrame(rules, facts.RULE_SCHEMA)).collect()
    assert {(r.column, r.value) for r in got} == want
