"""Queries that fill missing fields from evidence. Orders are items here, their lines the evidence, so that most items lack some field."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import devices, repair
from ..sources.analogues import spec_attributes
from ..sources.tables import read_table
from .base import query
from .product_queries import SPECS

_FIELDS = ["weight", "material", "voltage", "current", "protection", "color", "certificates", "operatingTemperature", "image"]
#: The readings of an item's lines, the best of each field; images are on the first three of five hosts. An order that 11 divides is another product.
VALUES = f"""{SPECS.replace("l_partkey AS item", "l_orderkey AS item")},
readings AS (SELECT item, ord, source_url, least(confidence, 0.78) AS confidence, ['voltage', 'current', 'weight', '', 'operatingTemperature', 'material', 'protection', 'certificates', 'color'][k + 1] AS field,
  ['Voltage', 'Current', 'Weight', '', 'Operating temperature', 'Material', 'Protection rating', 'Certificates', 'Color'][k + 1] AS label,
  CASE k WHEN 0 THEN q || ' V DC' WHEN 1 THEN q || ' A' WHEN 2 THEN q || ' kg' WHEN 4 THEN '-' || q || '..' || (q + 20) || ' °C' WHEN 5 THEN ['Steel', 'aluminum', 'Plastic'][q % 3 + 1] WHEN 6 THEN 'IP' || (20 + q) WHEN 7 THEN 'UL; CE' ELSE 'RAL ' || (7000 + q) END AS value,
  CAST(CASE source_type WHEN 'official' THEN 100 WHEN 'official-fallback' THEN 85 ELSE 45 END + CASE WHEN parser IN ('pdf-table', 'customer-document') THEN 25 ELSE 0 END + floor(confidence * 10 + 0.5) + CASE k WHEN 2 THEN 35 WHEN 5 THEN 30 ELSE 0 END AS INTEGER) AS points
  FROM specs WHERE k NOT IN (3, 9)),
vals AS (SELECT * EXCLUDE (n) FROM (SELECT item, field, label, value, source_url, confidence, points, ord, row_number() OVER (PARTITION BY item, field ORDER BY points DESC, ord, value, source_url) AS n FROM readings) WHERE n = 1)"""
REPAIRS = f"""{VALUES}, grid AS (SELECT o_orderkey AS item, field, (o_orderkey + length(field)) % 3 <> 0 AS wanted FROM orders, (SELECT unnest({_FIELDS!r}) AS field) WHERE o_orderkey % 11 <> 0),
known AS (SELECT item, field, 'held ' || item AS value, field AS label, NULL AS source_url, 0.78 AS confidence FROM grid WHERE NOT wanted
  UNION ALL SELECT item, field, value, label, source_url, confidence FROM vals JOIN grid USING (item, field) WHERE wanted
  UNION ALL SELECT item, field, 'https://s' || item % 5 || '.example/img/part-' || item || '.jpg', 'Product image', 'https://s' || item % 5 || '.example/x', 0.62 FROM grid WHERE wanted AND field = 'image' AND item % 5 < 3),
chained AS (SELECT g.*, sum(CASE WHEN g.item % 6 = 0 OR g.item % 11 = 1 OR g.before IS DISTINCT FROM g.item - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY field ORDER BY item) AS chain, k.item AS own
  FROM (SELECT *, lag(item) OVER (PARTITION BY field ORDER BY item) AS before FROM grid) g LEFT JOIN known k USING (item, field)),
nearest AS (SELECT item, field, wanted, last_value(own IGNORE NULLS) OVER (PARTITION BY field, chain ORDER BY item ROWS UNBOUNDED PRECEDING) AS from_item FROM chained),
repairs AS (SELECT n.item, field, k.label, k.value, k.source_url, k.confidence, from_item, CAST(n.item - from_item AS INTEGER) AS round FROM nearest n JOIN (SELECT item AS from_item, * EXCLUDE (item) FROM known) k USING (from_item, field) WHERE wanted)"""


def _evidence(spark, d):
    return spec_attributes(read_table(spark, d, "lineitem")).withColumn("item", F.floor(F.col("ord") / 10))


@query("evidence_values", f"WITH {VALUES} SELECT * FROM vals")
def _(spark, d):
    return repair.evidence_values(_evidence(spark, d))


def _grid(spark, d):
    fields = F.explode(F.array(*map(F.lit, _FIELDS))).alias("field")
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), fields).withColumn("wanted", (F.col("item") + F.length("field")) % 3 != 0)


def _held(grid):
    return grid.filter("not wanted").select("item", "field", F.concat(F.lit("held "), F.col("item").cast("string")).alias("value"))


def _repairs(spark, d, repaired=repair.repair_from_evidence):
    """Lines' evidence and a gallery for each order; the base of an order is the one before it, in chains of up to six."""
    orders = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("item"))
    key = F.col("item").cast("string")
    gallery = orders.select(
        "item", F.lit(0).cast("long").alias("ord"), F.lit("Gallery").alias("name"), F.concat(F.lit("see /img/logo-part-"), key, F.lit(".png or '/img/part-"), key, F.lit(".jpg'")).alias("value"),
        F.concat(F.lit("https://s"), (F.col("item") % 5).cast("string"), F.lit(".example/x")).alias("source_url"),
    )
    items = orders.select("item", F.concat(F.lit("Part-"), key).alias("key"), F.array(F.lit("s0.example"), F.lit("s1.example"), F.lit("s2.example")).alias("hosts"), (F.col("item") % 11 == 0).alias("conflict"))
    bases = orders.filter("item % 6 <> 0").select("item", (F.col("item") - 1).alias("base"))
    grid = _grid(spark, d)
    return repaired(grid.filter("wanted"), _evidence(spark, d).unionByName(gallery, allowMissingColumns=True), items, bases, _held(grid))


@query("evidence_repairs", f"WITH {REPAIRS} SELECT * FROM repairs")
def _(spark, d):
    return _repairs(spark, d)


@query(
    "repaired_completeness",
    f"""WITH {REPAIRS}, need AS (SELECT o_orderkey AS item, field, (o_orderkey + length(field)) % 3 <> 0 AS wanted, CASE WHEN field = 'color' AND o_orderkey % 4 = 0 THEN 'not-applicable' ELSE 'preferred' END AS requirement FROM orders, (SELECT unnest({_FIELDS!r}) AS field))
    SELECT n.item, n.field, requirement, CASE WHEN requirement = 'not-applicable' THEN requirement WHEN NOT wanted THEN 'present' WHEN r.item IS NOT NULL THEN 'found-after-repair' WHEN n.item % 5 = 0 THEN 'not-published' WHEN n.item % 5 = 1 THEN 'retry-skipped' ELSE 'missing' END AS status
    FROM need n LEFT JOIN repairs r ON n.item = r.item AND n.field = r.field""",
)
def _(spark, d):
    grid, filled = _grid(spark, d), _repairs(spark, d, repair.repaired_fields).select("item", "field")
    need = grid.select("item", "field", F.when((F.col("field") == "color") & (F.col("item") % 4 == 0), "not-applicable").otherwise("preferred").alias("requirement"))
    retried = F.when(F.col("item") % 5 == 0, True).when(F.col("item") % 5 == 1, False)
    return devices.completeness(need, _held(grid), _held(grid).unionByName(filled.withColumn("value", F.lit("repaired"))), filled, retried)


@query(
    "retry_decisions",
    f"""WITH open AS (SELECT o_orderkey AS item, field, CASE WHEN field = 'image' THEN 'required' ELSE 'preferred' END AS requirement, (o_orderkey + length(field)) % 7 = 0 AS gone
      FROM orders, (SELECT unnest({_FIELDS!r}) AS field) WHERE (o_orderkey * length(field)) % 13 < CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 5 END AND field <> 'certificates'),
    it AS (SELECT o_orderkey AS item, o_orderkey % 10 = 0 AS force, o_orderkey % 8 = 0 AS skip, o_orderstatus = 'F' AS passed, CASE WHEN o_orderkey % 9 = 0 THEN [] ELSE ['discovery', 'reader', 'browser'] END AS possible, CASE WHEN o_custkey % 3 = 0 THEN ['discovery', 'browser', 'reader'] ELSE ['reader'] END AS tried FROM orders),
    agg AS (SELECT item, count(field) AS n, count(*) FILTER (field = 'image' AND requirement = 'required') AS images FROM it LEFT JOIN open USING (item) GROUP BY item),
    lst AS (SELECT a.item, n, array_to_string(list(field ORDER BY field) FILTER (field IS NOT NULL), ',') AS everything, array_to_string(list(field ORDER BY field) FILTER (worth), ',') AS worth, array_to_string(list(field ORDER BY field) FILTER (kept), ',') AS kept, count(*) FILTER (kept AND requirement <> 'preferred') AS must
      FROM (SELECT a.item, a.n, o.field, o.requirement, o.field IS NOT NULL AND (i.force OR o.field <> 'image' OR a.n = 1 AND a.images = 1) AS worth, o.field IS NOT NULL AND (i.force OR (o.field <> 'image' OR a.n = 1 AND a.images = 1) AND NOT o.gone) AS kept FROM agg a JOIN it i USING (item) LEFT JOIN open o ON o.item = a.item) a GROUP BY a.item, n),
    why AS (SELECT l.*, i.*, list_filter(possible, lambda x: NOT list_contains(tried, x)) AS untried,
      CASE WHEN n = 0 THEN 'nothing-missing' WHEN worth IS NULL THEN 'final-only' WHEN kept IS NULL THEN 'exhausted' WHEN must = 0 AND NOT force AND skip THEN 'preferred-only' WHEN must = 0 AND NOT force AND passed THEN 'passed'
        WHEN len(list_filter(possible, lambda x: NOT list_contains(tried, x))) > 0 THEN 'untried-stages' WHEN len(possible) > 0 THEN 'all-tried' ELSE 'no-stage' END AS reason FROM lst l JOIN it i ON i.item = l.item)
    SELECT item, reason = 'untried-stages' AS retry, reason, coalesce(CASE reason WHEN 'final-only' THEN everything WHEN 'exhausted' THEN worth ELSE kept END, '') AS fields, CASE WHEN reason = 'untried-stages' THEN array_to_string(untried, ',') ELSE '' END AS untried FROM why""",
)
def _(spark, d):
    grid, orders = _grid(spark, d), read_table(spark, d, "orders")
    key, size = F.col("item"), F.length("field")
    audit = grid.select("item", "field", F.when(F.col("field") == "image", "required").otherwise("preferred").alias("requirement"), (key * size % 13 < F.when(key % 3 == 0, 1).otherwise(5)).alias("missing"))
    number, stage = F.col("o_orderkey"), lambda *names: F.array(*map(F.lit, names)).cast("array<string>")
    items = orders.select(
        number.alias("item"), (number % 10 == 0).alias("force"), (number % 8 == 0).alias("skip_preferred"), (F.col("o_orderstatus") == "F").alias("passed"),
        F.when(number % 9 == 0, stage()).otherwise(stage("discovery", "reader", "browser")).alias("possible"), F.when(F.col("o_custkey") % 3 == 0, stage("discovery", "browser", "reader")).otherwise(stage("reader")).alias("tried"),
    )
    return repair.retry_decisions(audit, items, grid.filter((key + size) % 7 == 0))
