"""Queries over facts: their index, the best of each key, lookups by value and by words, cells of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts
from ..sources.analogues import spec_attributes
from ..sources.tables import read_table
from .base import query
from .product_queries import SPECS

#: The facts of line items in SQL: a label is a key, a parser a rule; every third is a repair, every third normalised.
_FACTS = f"""{SPECS}, facts AS (SELECT item, name AS key, value, ['attribute', 'normalized', 'repair'][CAST(ord % 3 AS INTEGER) + 1] AS source_kind, source_url, source_type, parser AS rule, confidence, ord, regexp_replace(lower(value), '[^a-z0-9]+', '', 'g') AS comparable,
  CAST([40, 34, 28][CAST(ord % 3 AS INTEGER) + 1] + 10 * CASE source_type WHEN 'official' THEN 4 WHEN 'official-fallback' THEN 3 ELSE -2 END AS DOUBLE) + confidence AS rank FROM specs),
idx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item, key, comparable, source_kind, source_url, rule ORDER BY ord) AS n FROM facts) WHERE n = 1)"""


def _facts(spark, d):
    kind = F.element_at(F.array(F.lit("attribute"), F.lit("normalized"), F.lit("repair")), (F.col("ord") % 3 + 1).cast("int"))
    rows = spec_attributes(read_table(spark, d, "lineitem"))
    return rows.select("item", F.col("name").alias("key"), "value", kind.alias("source_kind"), "source_url", "source_type", F.col("parser").alias("rule"), "confidence", "ord")


def _index(spark, d):
    return facts.fact_index(_facts(spark, d))


@query("fact_index", f"WITH {_FACTS} SELECT item, key, comparable, rank, ord FROM idx")
def _(spark, d):
    return _index(spark, d).select("item", "key", "comparable", "rank", "ord")


@query("best_facts", f"WITH {_FACTS} SELECT item, key, value, source_kind, rank, ord FROM (SELECT *, row_number() OVER (PARTITION BY item, key ORDER BY rank DESC, ord) AS r FROM idx) WHERE r = 1")
def _(spark, d):
    return facts.best_facts(_index(spark, d)).select("item", "key", "value", "source_kind", "rank", "ord")


@query(
    "facts_with_value",
    f"""WITH {_FACTS}, asked AS (SELECT p_partkey AS item, p_size || ' kg' AS asked, p_size || 'kg' AS bare FROM part)
    SELECT item, asked, key, ord FROM idx JOIN asked USING (item) WHERE contains(comparable, bare) OR contains(bare, comparable)""",
)
def _(spark, d):
    asked = read_table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.concat(F.col("p_size").cast("string"), F.lit(" kg")).alias("asked"))
    return facts.facts_with_value(_index(spark, d), asked).select("item", "asked", "key", "ord")


@query(
    "fact_search",
    f"""WITH {_FACTS}, asked AS (SELECT 'q' || p_size AS question, list_distinct(['rated', 'v', CAST(p_size AS VARCHAR)]) AS words FROM part GROUP BY p_size),
    w AS (SELECT *, list_distinct(list_filter(string_split(regexp_replace(lower(key || ' ' || value), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS words FROM idx)
    SELECT question, item, key, ord FROM w JOIN asked ON len(list_intersect(w.words, asked.words)) = len(asked.words)""",
)
def _(spark, d):
    size = F.col("p_size").cast("string")
    asked = read_table(spark, d, "part").select(F.concat(F.lit("q"), size).alias("question"), F.concat(F.lit("Rated V "), size).alias("text")).distinct()
    return facts.search_facts(facts.fact_words(_index(spark, d)), asked).select("question", "item", "key", "ord")


_RULES = [
    ("U", 1, "label", "rated voltage", "unit", "V"), ("U", 2, "label", "voltage", "number", None), ("I", 1, "fact", "Rated current", "unit", "mA"), ("I", 2, "label", "current", "number", None), ("Mass", 1, "label", "net weight", "unit", "lb"),
    ("Body", 1, "fact", "Housing material", "text", None), ("Body", 0, "label", "no such label", "text", None), ("Marked", 1, "label", "approvals", "yes_no", None), ("Also U", 1, "label", "rated voltage", "text", None), (None, 1, "label", "colour", "text", None),
]


@query(
    "resolved_columns",
    f"""WITH {_FACTS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item, key ORDER BY rank DESC, ord) AS r FROM idx) WHERE r = 1),
    attrs AS (SELECT *, CAST(40 + 10 * CASE source_type WHEN 'official' THEN 4 WHEN 'official-fallback' THEN 3 ELSE -2 END AS DOUBLE) + confidence AS rank FROM specs),
    first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item, k ORDER BY rank DESC, ord) AS r FROM attrs) WHERE r = 1)
    SELECT item, 'U' AS "column", CAST(q AS VARCHAR) AS value, 'label rated voltage' AS rule, 'attribute' AS source_kind, source_url FROM first WHERE k = 0 UNION ALL SELECT item, 'Also U', value, 'label rated voltage', 'attribute', source_url FROM first WHERE k = 0
    UNION ALL SELECT item, 'I', CAST(CAST(regexp_extract(value, '^[0-9]+') AS INTEGER) * 1000 AS VARCHAR), 'fact Rated current', source_kind, source_url FROM best WHERE key = 'Rated current'
    UNION ALL SELECT item, 'Mass', regexp_replace(regexp_replace(printf('%.6f', q * 1000.0 / 453.59237), '(\\.\\d*?)0+$', '\\1'), '\\.$', ''), 'label net weight', 'attribute', source_url FROM first WHERE k = 2
    UNION ALL SELECT item, 'Body', value, 'fact Housing material', source_kind, source_url FROM best WHERE key = 'Housing material'""",
)
def _(spark, d):
    rules = spark.createDataFrame(_RULES, facts.RULE_SCHEMA)
    cells = facts.resolve_columns(spec_attributes(read_table(spark, d, "lineitem")), _index(spark, d), rules)
    return cells.select("item", "column", "value", "rule", "source_kind", "source_url")
