"""Queries over pages as trees and over data in scripts. SQL on ``pages`` works from tags alone, SQL on parts from the tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import page_data, page_tree, script_json
from ..sources.analogues import nested_table_page, offer_page, state_page
from ..sources.tables import read_table
from .base import query

#: A page without comments, scripts, styles and declarations, in SQL.
_BARE = r"regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</(script|style)>', '', 'g'), '<![^>]*>', '', 'g')"
_BLOCK_TAGS = "|".join(sorted(page_tree.BLOCKS))
_SPACES = r"[\s\x{A0}\x{2000}-\x{200A}]+"


def _nodes(spark, d):
    return page_tree.page_nodes(read_table(spark, d, "pages"))


@query(
    "page_blocks",
    rf"""WITH lines AS (SELECT page_id, unnest(string_split_regex(regexp_replace(regexp_replace({_BARE}, '(?i)<br\s*/?>', ' ', 'g'), '(?i)</?({_BLOCK_TAGS})(\s[^>]*)?>', chr(1), 'g'), chr(1))) AS line FROM pages)
    SELECT page_id, text, count(*) AS n FROM (SELECT page_id, replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(line, '<[^>]*>', '', 'g'), '{_SPACES}', ' ', 'g')), '&amp;', '&'), '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>') AS text FROM lines) WHERE text <> '' GROUP BY 1, 2""",
)
def _(spark, d):
    return page_tree.block_texts(_nodes(spark, d)).groupBy("page_id", "text").agg(F.count(F.lit(1)).alias("n"))


@query(
    "page_elements",
    rf"""WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<(script|style)\b[^>]*>).*?</(script|style)>', '\1', 'g') AS html FROM pages)
    SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '<([a-z][^\s/>]*)', 1)) AS tag FROM bare) GROUP BY 1, 2""",
)
def _(spark, d):
    return _nodes(spark, d).filter("tag <> '#text'").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "article_links",
    rf"""SELECT page_id, (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(lower({_BARE}), '(?s)<nav\b.*?</nav>')) AS nav), LATERAL (SELECT unnest(regexp_extract_all(nav, '<a\b')))) AS links,
    (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(lower({_BARE}), '(?s)<article\b.*?</article>')) AS body), LATERAL (SELECT unnest(regexp_extract_all(body, '<p\b')))) AS paragraphs FROM pages WHERE html IS NOT NULL""",
)
def _(spark, d):
    nodes = _nodes(spark, d)
    count = lambda outer, inner, name: page_tree.inside(nodes.filter(F.col("tag") == outer), nodes.filter(F.col("tag") == inner)).groupBy("page_id").agg(F.count(F.lit(1)).alias(name))
    pages = read_table(spark, d, "pages").filter("html is not null").select("page_id")
    made = pages.join(count("nav", "a", "links"), "page_id", "left").join(count("article", "p", "paragraphs"), "page_id", "left")
    return made.select("page_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"))


@query(
    "nested_tables",
    """SELECT p_partkey AS page_id, row, cells FROM part, LATERAL (VALUES (0, ['Outer', 'A ' || p_brand || ' B']), (1, ['Inner', CAST(p_partkey AS VARCHAR)]), (2, ['Last', 'x & y z'])) AS v(row, cells)""",
)
def _(spark, d):
    rows = page_tree.tree_rows(page_tree.page_nodes(nested_table_page(read_table(spark, d, "part"))))
    inner = F.dense_rank().over(Window.partitionBy("page_id").orderBy("row")) - 1
    return rows.select("page_id", inner.cast("int").alias("row"), "cells")


@query(
    "nested_blocks",
    """SELECT p_partkey AS page_id, tag, text FROM part, LATERAL (VALUES ('div', 'Kind: ' || p_type || 'tail'), ('p', 'Voltage: ' || p_size || ' V'), ('p', 'Weight: ' || p_size || ' kg'), ('li', 'One'), ('li', 'Two: ' || p_partkey),
    ('th', 'Outer'), ('td', 'A ' || p_brand || ' B'), ('td', 'Inner'), ('td', CAST(p_partkey AS VARCHAR)), ('td', 'Last'), ('td', 'x & y z')) AS v(tag, text)""",
)
def _(spark, d):
    return page_tree.block_texts(page_tree.page_nodes(nested_table_page(read_table(spark, d, "part")))).select("page_id", "tag", "text")


def _blocks(spark, d):
    return script_json.script_blocks(state_page(read_table(spark, d, "part")))


#: A part's record in a state page, in SQL; k is whose it is.
_RECORD = """'{{"sku":"P-' || {k} || '","specifications":{{"netWeight":"' || p_size || ' kg","wallThickness":{{"value":' || p_size || ',"unit":"mm"}},"url":"/x","sizes":["a","b","a"]}},"features":[{{"label":"For part","value":"' || {k} || '"}},{{"name":"Range","minValue":1,"maxValue":"' || p_size || '","unit":"V"}}]}}'"""


@query(
    "script_blocks",
    f"""WITH b AS (SELECT p_partkey AS page_id, '{{"note":"}} ] \\" {{","deep":[[[{{"product":{{"list":[' || {_RECORD.format(k='p_partkey')} || ',' || {_RECORD.format(k='(p_partkey + 1)')} || ']}}}}]]],"config":"{{\\"attributes\\":{{\\"mainColour\\":\\"' || p_brand || '\\"}}}}"}}' AS block FROM part)
    SELECT page_id, 'window.__INITIAL_STATE__' AS marker, CAST(48 AS INTEGER) AS "begin", CAST(48 + length(block) AS INTEGER) AS "end", true AS complete, block FROM b
    UNION ALL SELECT page_id, 'dataLayer.push', CAST(48 + length(block) + 33 AS INTEGER), NULL, false, NULL FROM b""",
)
def _(spark, d):
    return _blocks(spark, d)


def _state_nodes(spark, d):
    blocks = _blocks(spark, d).filter("complete").select("page_id", F.col("begin").alias("ord"), F.col("block").alias("json"))
    return script_json.json_nodes(blocks)


_PAIRS = """('pair', 'For part', CAST({k} AS VARCHAR)), ('pair', 'Range', '1...' || p_size || ' V'), ('map', 'Net Weight', p_size || ' kg'), ('map', 'Wall Thickness', p_size || ' mm'), ('map', 'Sizes', 'a; b')"""


@query(
    "product_pairs",
    f"""SELECT p_partkey AS page_id, shape, name, value FROM part, LATERAL (VALUES {_PAIRS.format(k='p_partkey')}, ('pair', 'For part', CAST(p_partkey + 1 AS VARCHAR)), ('map', 'Main Colour', p_brand)) AS v(shape, name, value)""",
)
def _(spark, d):
    return script_json.product_pairs(_state_nodes(spark, d)).select("page_id", "shape", "name", "value")


@query(
    "item_product_pairs",
    f"SELECT p_partkey AS page_id, shape, name, value FROM part, LATERAL (VALUES {_PAIRS.format(k='p_partkey')}, ('map', 'Main Colour', p_brand)) AS v(shape, name, value)",
)
def _(spark, d):
    keys = state_page(read_table(spark, d, "part")).select("page_id", "item")
    return script_json.product_pairs(script_json.only_item(_state_nodes(spark, d), keys)).select("page_id", "shape", "name", "value")


@query(
    "json_scalars",
    """SELECT p_partkey AS page_id, path, count(*) AS n FROM part, LATERAL (VALUES ('note'), ('deep / product / list / sku'), ('deep / product / list / sku'), ('deep / product / list / specifications / netWeight'), ('deep / product / list / specifications / netWeight'),
    ('deep / product / list / specifications / wallThickness / value'), ('deep / product / list / specifications / wallThickness / value'), ('deep / product / list / specifications / wallThickness / unit'), ('deep / product / list / specifications / wallThickness / unit'),
    ('deep / product / list / specifications / url'), ('deep / product / list / specifications / url'), ('deep / product / list / specifications / sizes'), ('deep / product / list / specifications / sizes'), ('deep / product / list / specifications / sizes'),
    ('deep / product / list / specifications / sizes'), ('deep / product / list / specifications / sizes'), ('deep / product / list / specifications / sizes'), ('deep / product / list / features / label'), ('deep / product / list / features / label'),
    ('deep / product / list / features / value'), ('deep / product / list / features / value'), ('deep / product / list / features / name'), ('deep / product / list / features / name'), ('deep / product / list / features / minValue'), ('deep / product / list / features / minValue'),
    ('deep / product / list / features / maxValue'), ('deep / product / list / features / maxValue'), ('deep / product / list / features / unit'), ('deep / product / list / features / unit'), ('config / attributes / mainColour')) AS v(path) GROUP BY 1, 2""",
)
def _(spark, d):
    return _state_nodes(spark, d).filter("text is not null").groupBy("page_id", "path").agg(F.count(F.lit(1)).alias("n"))


def _offer_nodes(spark, d, markers):
    blocks = script_json.script_blocks(offer_page(read_table(spark, d, "part")), markers).filter("complete")
    return script_json.json_nodes(blocks.select("page_id", F.col("begin").alias("ord"), F.col("block").alias("json")))


_CELLS = """('P-' || p_partkey, 1, 0, 'Part', 'P-' || p_partkey), ('P-' || p_partkey, 1, 1, 'Width', CAST(p_size AS VARCHAR)), ('P-' || p_partkey, 1, 2, 'Note', 'a, b')"""


@query(
    "embedded_tables",
    f"""SELECT p_partkey AS page_id, CAST(row AS INTEGER) AS row, CAST("column" AS INTEGER) AS "column", header, value FROM part,
    LATERAL (VALUES {_CELLS}, ('', 2, 0, 'Part', 'P-' || (p_partkey + 1)), ('', 2, 1, 'Width', 'x'), ('', 2, 3, NULL, '5')) AS v(own, row, "column", header, value)""",
)
def _(spark, d):
    return page_data.embedded_tables(_offer_nodes(spark, d, page_data.TABLE_NAMES)).select("page_id", "row", "column", "header", "value")


@query("embedded_item_rows", f"SELECT p_partkey AS page_id, header, value FROM part, LATERAL (VALUES {_CELLS}) AS v(own, row, col, header, value)")
def _(spark, d):
    keys = offer_page(read_table(spark, d, "part")).select("page_id", "item")
    return page_data.rows_of_items(page_data.embedded_tables(_offer_nodes(spark, d, page_data.TABLE_NAMES)), keys).select("page_id", "header", "value")


@query(
    "structured_urls",
    "SELECT p_partkey AS page_id, key, url, context FROM part, LATERAL (VALUES ('url', '/p/' || p_partkey || '?a=1&b=2', p_name || ' P-' || p_partkey), ('link', 'item-' || (p_partkey + 1) || '.html', 'next')) AS v(key, url, context)",
)
def _(spark, d):
    return page_data.structured_urls(_offer_nodes(spark, d, ["window.productData"])).select("page_id", "key", "url", "context")


@query(
    "page_forms",
    """SELECT p_partkey AS page_id, action, method, field, kind, value FROM part, LATERAL (VALUES ('/find', 'get', 'q', 'text', CAST(p_partkey AS VARCHAR)), ('/find', 'get', 'lang', 'hidden', 'en'), ('/cart', 'post', 'qty', 'select', NULL), ('/cart', 'post', 'note', 'textarea', NULL)) AS v(action, method, field, kind, value)""",
)
def _(spark, d):
    forms = page_data.page_forms(page_tree.page_nodes(offer_page(read_table(spark, d, "part"))))
    return forms.select("page_id", "action", "method", F.explode("fields").alias("f")).select("page_id", "action", "method", F.col("f.name").alias("field"), "f.kind", "f.value")
