"""Queries over product attributes, labels, markup and gates. The SQL states its results from the tables' columns, not from texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, quantities, units, urls
from ..functions.text import collapse, collapse_or_null, split_name_value, truncated, unique_strings
from ..operators import attributes, gates, markup, ontology
from ..sources.analogues import spec_attributes, spec_page
from ..sources.tables import read_table
from .base import query

#: The attributes of spec_attributes, in SQL: k is the label's number, q the quantity.
SPECS = """base AS (SELECT *, CAST(l_quantity AS INTEGER) AS q, CAST((l_suppkey + l_linenumber) % 10 AS INTEGER) AS k, l_orderkey * 10 + l_linenumber AS ord, CAST(round(l_tax * 100) AS INTEGER) + 1 AS tol FROM lineitem),
specs AS (SELECT l_partkey AS item, ord, k, q, tol,
  ['Rated voltage', 'Rated current', 'Net weight', 'Width', 'Operating temperature', 'Housing material', 'Degree of protection', 'Approvals', 'Colour', 'Frobnication index'][k + 1] AS name,
  CASE k WHEN 0 THEN q || ' V DC ±' || tol || '%' WHEN 1 THEN q || ' A at 40 °C' WHEN 2 THEN q || ' kg' WHEN 3 THEN q || ' mm' WHEN 4 THEN '-' || q || ' to ' || (q + 20) || ' °C'
    WHEN 5 THEN ['Steel', 'Aluminium', 'Plastic'][q % 3 + 1] WHEN 6 THEN 'IP' || (20 + q) WHEN 7 THEN 'UL, CE' WHEN 8 THEN 'RAL ' || (7000 + q) ELSE q || ' W' END AS value,
  'https://s' || l_suppkey % 5 || '.example/' || l_partkey AS source_url, CASE l_returnflag WHEN 'A' THEN 'official' WHEN 'N' THEN 'official-fallback' ELSE 'distributor' END AS source_type,
  CASE l_linenumber WHEN 1 THEN 'customer-document' WHEN 2 THEN 'pdf-table' WHEN 3 THEN 'browser-network' ELSE 'generic' END AS parser, round(1 - l_discount, 2) AS confidence FROM base)"""


def _specs(spark, d):
    return spec_attributes(read_table(spark, d, "lineitem"))


@query(
    "dedupe_attributes",
    f"WITH {SPECS} SELECT item, ord, name, value FROM (SELECT *, row_number() OVER (PARTITION BY item, lower(name), lower(value) ORDER BY ord) AS n FROM specs) WHERE n = 1",
)
def _(spark, d):
    return attributes.dedupe_attributes(_specs(spark, d)).select("item", "ord", "name", "value")


@query(
    "dedupe_sources",
    f"WITH {SPECS} SELECT item, min(ord) AS ord, parser, source_url AS url FROM specs GROUP BY item, parser, source_url",
)
def _(spark, d):
    return attributes.dedupe_sources(_specs(spark, d).withColumnRenamed("source_url", "url")).select("item", "ord", "parser", "url")


@query(
    "dedupe_evidence",
    f"WITH {SPECS} SELECT item, min(ord) AS ord, name, value, source_url, parser FROM specs GROUP BY item, name, value, source_url, parser",
)
def _(spark, d):
    rows = _specs(spark, d).withColumns({"kind": F.lit("attribute"), "url": F.lit(None).cast("string")})
    return attributes.dedupe_evidence(rows).select("item", "ord", "name", "value", "source_url", "parser")


@query(
    "parse_quantities",
    f"""WITH {SPECS} SELECT item, ord, CASE k WHEN 0 THEN 'voltage' WHEN 1 THEN 'current' WHEN 2 THEN 'mass' WHEN 3 THEN 'length' WHEN 4 THEN 'temperature' ELSE 'power' END AS kind,
    ['V', 'A', 'kg', 'mm', '°C', 'W'][least(k, 5) + 1] AS unit, CASE WHEN k <> 4 THEN CAST(q AS DOUBLE) END AS value, CASE WHEN k = 4 THEN CAST(-q AS DOUBLE) END AS low, CASE WHEN k = 4 THEN CAST(q + 20 AS DOUBLE) END AS high,
    CASE k WHEN 0 THEN 'nominal' WHEN 4 THEN 'range' ELSE 'point' END AS qualifier, CASE WHEN k = 0 THEN CAST(tol AS DOUBLE) END AS tolerance, CASE WHEN k = 0 THEN 'DC' END AS current_type,
    CASE WHEN k = 1 THEN 'at 40 °C' END AS condition, true AS plausible FROM specs WHERE k < 5 OR k = 9""",
)
def _(spark, d):
    rows = attributes.with_read(_specs(spark, d), "value", quantities.parse_quantities, "parsed").select("item", "ord", F.explode("parsed").alias("x"))
    return rows.select(
        "item", "ord", "x.kind", "x.unit", "x.value", F.col("x.min").alias("low"), F.col("x.max").alias("high"), "x.qualifier", F.col("x.tolerance.value").alias("tolerance"), "x.current_type", "x.condition",
        quantities.is_plausible(F.col("x")).alias("plausible"),
    )


@query(
    "quantity_ends",
    f"""WITH {SPECS}, texts AS (SELECT ord, q, tol, CAST(ord % 5 AS INTEGER) AS form FROM specs)
    SELECT ord, ['alternatives', 'max', 'min', 'range', 'point'][form + 1] AS qualifier, CASE form WHEN 4 THEN floor((q - 32) * 5 / 9 * 10 + 0.5) / 10 ELSE CAST(q AS DOUBLE) END AS low,
    CASE form WHEN 0 THEN CAST(q + 100 AS DOUBLE) WHEN 3 THEN q + 0.5 WHEN 4 THEN floor((q - 32) * 5 / 9 * 10 + 0.5) / 10 ELSE CAST(q AS DOUBLE) END AS high FROM texts""",
)
def _(spark, d):
    q = F.col("l_quantity").cast("int")
    s = q.cast("string")
    ord_ = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    forms = [F.concat(s, F.lit("/"), (q + 100).cast("string"), F.lit(" V")), F.concat(F.lit("≤ "), s, F.lit(" kW")), F.concat(F.lit("min. "), s, F.lit(" mm")), F.concat(s, F.lit(" … "), s, F.lit(",5 bar")), F.concat(s, F.lit(" °F"))]
    rows = read_table(spark, d, "lineitem").select(ord_.alias("ord"), F.element_at(F.array(*forms), (ord_ % 5 + 1).cast("int")).alias("text"))
    parsed = attributes.with_read(rows, "text", quantities.parse_quantities, "parsed").select("ord", F.explode("parsed").alias("x"))
    return parsed.select("ord", "x.qualifier", quantities.quantity_min(F.col("x")).alias("low"), quantities.quantity_max(F.col("x")).alias("high"))


@query(
    "temperature_ranges",
    f"WITH {SPECS} SELECT ord, CASE WHEN q % 2 = 0 THEN CAST(-q AS DOUBLE) END AS low, CASE WHEN q % 2 = 0 THEN CAST(q + 20 AS DOUBLE) END AS high FROM specs WHERE k = 4",
)
def _(spark, d):
    rows = _specs(spark, d).filter("name = 'Operating temperature'")
    even = F.regexp_extract("value", r"^-(\d+)", 1).cast("int") % 2 == 0
    text = F.when(even, F.concat(F.lit("Storage -60 to 90 °C; operating temperature "), "value")).otherwise(F.concat(F.lit("20 A at 40 °C, storage "), "value"))
    read = attributes.with_read(rows.withColumn("text", text), "text", quantities.temperature_range, "range")
    return read.select("ord", F.col("range.min").alias("low"), F.col("range.max").alias("high"))


@query(
    "unit_conversion",
    f"""WITH {SPECS} SELECT ord, CASE k WHEN 2 THEN round(q * 1000.0 / 453.59237, 6) END AS pounds, CASE k WHEN 3 THEN round(q / 25.4, 6) WHEN 8 THEN CAST(7000 + q AS DOUBLE) WHEN 6 THEN CAST(20 + q AS DOUBLE) END AS inches,
    CASE k WHEN 1 THEN q * 1000.0 WHEN 8 THEN CAST(7000 + q AS DOUBLE) WHEN 6 THEN CAST(20 + q AS DOUBLE) END AS milliamps FROM specs WHERE k IN (0, 1, 2, 3, 6, 8)""",
)
def _(spark, d):
    rows = _specs(spark, d).filter("name in ('Rated voltage', 'Rated current', 'Net weight', 'Width', 'Degree of protection', 'Colour')")
    rows = rows.withColumn("value", F.regexp_replace("value", "( at .*| DC .*)$", ""))
    read = attributes.with_read(rows, "value", lambda v: F.struct(*[units.max_in_unit(v, u).alias(name) for name, u in (("pounds", "lb"), ("inches", "inch"), ("milliamps", "mA"))]), "read")
    own = F.when(F.col("name").isin("Degree of protection", "Colour"), None).otherwise(F.col("read.pounds"))
    return read.select("ord", own.alias("pounds"), "read.inches", "read.milliamps")


def _rules(spark):
    return spark.createDataFrame(ontology.PROPERTIES, ontology.PROPERTY_SCHEMA)


_KEYS = "['ratedVoltage', 'ratedCurrent', 'weight', 'width', 'operatingTemperature', 'material', 'protection', 'certificates', 'colour', NULL]"


@query(
    "understand_attributes",
    f"WITH {SPECS} SELECT item, ord, {_KEYS}[k + 1] AS property, CAST(CASE WHEN k < 5 OR k = 9 THEN 1 ELSE 0 END AS INTEGER) AS quantities FROM specs",
)
def _(spark, d):
    return ontology.understand(_specs(spark, d), _rules(spark)).select("item", "ord", "property", F.size("quantities").alias("quantities"))


@query("property_frequency", f"WITH {SPECS} SELECT {_KEYS}[k + 1] AS property, count(*) AS n, count(DISTINCT item) AS items FROM specs WHERE k < 9 GROUP BY 1")
def _(spark, d):
    known = ontology.understand(_specs(spark, d), _rules(spark)).filter("property is not null")
    return known.groupBy("property").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item").alias("items"))


@query("unmapped_labels", f"WITH {SPECS} SELECT name AS label, count(*) AS n, count(DISTINCT item) AS items FROM specs WHERE k = 9 GROUP BY 1")
def _(spark, d):
    aliases = spark.createDataFrame([("Nominal voltage", "ratedVoltage"), ("Power loss", "powerLoss")], "alias string, key string")
    return ontology.unmapped_labels(_specs(spark, d), _rules(spark), aliases)


_PLAIN = "trim(regexp_replace(lower(regexp_replace({}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "suggest_aliases",
    f"""WITH l AS (SELECT DISTINCT p_name AS label FROM part), a AS (SELECT DISTINCT p_name AS alias, 'k' || p_name AS key FROM part WHERE p_partkey % 3 = 0),
    x AS (SELECT label, alias, key, {_PLAIN.format('label')} AS p, {_PLAIN.format('alias')} AS r FROM l CROSS JOIN a),
    y AS (SELECT *, replace(p, ' ', '') AS c, replace(r, ' ', '') AS e, list_distinct(string_split(p, ' ')) AS pt, list_distinct(string_split(r, ' ')) AS rt FROM x),
    z AS (SELECT *, 2.0 * len(list_intersect(pt, rt)) / (len(pt) + len(rt)) AS words, list_transform(range(1, length(c)), lambda i: substr(c, i, 2)) AS cb, list_transform(range(1, length(e)), lambda i: substr(e, i, 2)) AS eb FROM y),
    w AS (SELECT *, 2.0 * list_sum(list_transform(list_distinct(cb), lambda b: least(len(list_filter(cb, lambda q: q = b)), len(list_filter(eb, lambda q: q = b))))) / (length(c) + length(e) - 2) AS dice FROM z),
    s AS (SELECT label, alias, key, CASE WHEN c = e THEN 1.0 ELSE least(1.0, greatest(words * 0.62 + dice * 0.38, dice,
      CASE WHEN least(length(p), length(r)) >= 8 AND contains(CASE WHEN length(p) < length(r) THEN r ELSE p END, CASE WHEN length(p) < length(r) THEN p ELSE r END) THEN 0.92 - least(0.12, abs(length(p) - length(r)) / 160.0) ELSE 0 END,
      CASE WHEN words = 1 AND len(string_split(p, ' ')) >= 2 AND len(string_split(r, ' ')) >= 2 THEN 0.95 ELSE 0 END)) END AS score FROM w)
    SELECT label, alias, key, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, alias, key) AS n FROM s WHERE score > 0) WHERE n = 1""",
)
def _(spark, d):
    part = read_table(spark, d, "part")
    aliases = part.filter("p_partkey % 3 = 0").select(F.col("p_name").alias("alias"), F.concat(F.lit("k"), "p_name").alias("key")).distinct()
    return ontology.suggest_aliases(part.select(F.col("p_name").alias("label")), aliases)


CANDIDATES = f"""{SPECS}, fields AS (SELECT *, unnest(CASE k WHEN 0 THEN ['voltage'] WHEN 1 THEN ['current'] WHEN 2 THEN ['weight'] WHEN 3 THEN ['dimensions'] WHEN 4 THEN ['operatingTemperature'] WHEN 5 THEN ['material']
  WHEN 6 THEN ['protection'] WHEN 8 THEN ['color'] ELSE [] END) AS field FROM specs),
ladder AS (SELECT *, CASE WHEN parser = 'customer-document' THEN 1000 WHEN source_type = 'official' AND parser = 'pdf-table' THEN 900 WHEN source_type = 'official' THEN 860
  WHEN source_type = 'official-fallback' AND parser = 'browser-network' THEN 790 WHEN source_type = 'official-fallback' THEN 730 ELSE 300 END + CAST(floor(confidence * 20 + 0.5) AS INTEGER) AS priority FROM fields),
candidates AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item, field, lower(value), source_url, parser ORDER BY ord) AS n FROM ladder) WHERE n = 1)"""


def _candidates(spark, d):
    return attributes.field_candidates(_specs(spark, d))


@query("field_candidates", f"WITH {CANDIDATES} SELECT item, field, value, parser, priority, ord FROM candidates")
def _(spark, d):
    return _candidates(spark, d).select("item", "field", "value", "parser", "priority", "ord")


@query(
    "field_resolutions",
    f"""WITH {CANDIDATES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY item, field ORDER BY priority DESC, confidence DESC, ord) AS r FROM candidates),
    counts AS (SELECT item, field, count(*) AS candidates, count(DISTINCT lower(value)) - 1 AS conflicts FROM candidates GROUP BY 1, 2)
    SELECT item, field, value AS selected, source_url, parser, candidates, conflicts FROM ranked JOIN counts USING (item, field) WHERE r = 1""",
)
def _(spark, d):
    return attributes.field_resolutions(_candidates(spark, d)).select("item", "field", "selected", "source_url", "parser", "candidates", "conflicts")


@query(
    "field_conflicts",
    f"""WITH {CANDIDATES}, p AS (SELECT *, CASE WHEN parser = 'customer-document' THEN 1000 WHEN source_type = 'official' AND parser = 'pdf-table' THEN 880 WHEN source_type = 'official' THEN 850
      WHEN source_type = 'official-fallback' THEN 720 ELSE 300 END + CAST(floor(confidence * 20 + 0.5) AS INTEGER) AS points FROM candidates),
    first AS (SELECT item, field, lower(value) AS v, row_number() OVER (PARTITION BY item, field ORDER BY points DESC, ord) AS r FROM p),
    g AS (SELECT item, field, lower(value) AS v, min_by(value, ord) AS value, max(confidence) AS confidence, max(points) AS priority, min(ord) AS seen FROM p GROUP BY 1, 2, 3),
    m AS (SELECT g.*, first.v IS NOT NULL AS selected, count(*) OVER (PARTITION BY item, field) AS n FROM g LEFT JOIN (SELECT * FROM first WHERE r = 1) AS first USING (item, field, v))
    SELECT item, field, CAST(row_number() OVER (PARTITION BY item, field ORDER BY selected DESC, priority DESC, seen) AS INTEGER) AS rank, value, confidence, priority, selected FROM m WHERE n > 1""",
)
def _(spark, d):
    return attributes.field_conflicts(_candidates(spark, d)).select("item", "field", "rank", "value", "confidence", "priority", "selected")


_ALL_FIELDS = "['" + "', '".join(f[0] for f in attributes.FIELDS) + "']"
HEALTH = f"""{CANDIDATES}, items AS (SELECT DISTINCT item, unnest({_ALL_FIELDS}) AS field FROM (SELECT DISTINCT item FROM specs)),
g AS (SELECT item, field, count(DISTINCT lower(value)) AS n, max(confidence) AS confidence FROM candidates GROUP BY 1, 2),
health AS (SELECT item, field, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'conflicting' WHEN confidence < 0.95 THEN 'low-confidence' ELSE 'found' END AS status FROM items LEFT JOIN g USING (item, field))"""


def _health(spark, d):
    specs = _specs(spark, d)
    return attributes.field_health(specs, attributes.field_candidates(specs), least=0.95)


@query("field_health", f"WITH {HEALTH} SELECT item, field, status FROM health")
def _(spark, d):
    return _health(spark, d).select("item", "field", "status")


@query(
    "field_health_summary",
    f"""WITH {HEALTH} SELECT item, count(*) FILTER (status = 'found') AS found, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'low-confidence') AS low_confidence,
    count(*) FILTER (status = 'conflicting') AS conflicting FROM health GROUP BY 1""",
)
def _(spark, d):
    return attributes.field_health_summary(_health(spark, d))


@query(
    "fill_missing_fields",
    f"""WITH {CANDIDATES}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item, field ORDER BY priority DESC, confidence DESC, ord) AS r FROM candidates) WHERE r = 1),
    n AS (SELECT p_partkey AS item, CASE WHEN p_size % 2 = 0 THEN p_size || ' kg' ELSE '' END AS weight, CAST(NULL AS VARCHAR) AS material FROM part)
    SELECT n.item, CASE WHEN n.weight <> '' THEN n.weight ELSE w.value END AS weight, m.value AS material FROM n LEFT JOIN (SELECT * FROM best WHERE field = 'weight') AS w USING (item) LEFT JOIN (SELECT * FROM best WHERE field = 'material') AS m USING (item)""",
)
def _(spark, d):
    size = F.col("p_size")
    normalized = read_table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.when(size % 2 == 0, F.concat(size.cast("string"), F.lit(" kg"))).otherwise("").alias("weight"), F.lit(None).cast("string").alias("material"))
    return attributes.fill_missing(normalized, attributes.field_resolutions(_candidates(spark, d)), ["weight", "material"])


@query(
    "attribute_categories",
    f"""WITH {SPECS} SELECT category, count(*) AS n FROM (SELECT CASE WHEN k IN (0, 1) THEN 'Electrical' WHEN k IN (2, 3, 4, 5, 6) THEN 'Mechanical' WHEN k = 7 THEN 'Compliance' ELSE 'Other' END AS category FROM specs) GROUP BY 1""",
)
def _(spark, d):
    return _specs(spark, d).groupBy(attributes.category(F.lit(None).cast("string"), F.col("name")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "document_ranking",
    """WITH b AS (SELECT page_id, url, CAST(page_id % 4 AS INTEGER) AS k FROM pages), r AS (SELECT page_id % 25 AS item, page_id, k, ['datasheet', 'manual', 'image', 'other'][k + 1] AS type FROM b),
    s AS (SELECT *, CASE k WHEN 0 THEN 130 + 20 + 12 + 10 WHEN 1 THEN 80 + 15 + 10 WHEN 2 THEN 50 + 10 ELSE 10 - 60 END + CAST(floor(CASE WHEN page_id % 3 = 0 THEN 0.9 ELSE 0.4 END * 10 + 0.5) AS INTEGER) AS quality FROM r)
    SELECT item, k AS slot, min(page_id) AS first_seen, count(*) AS copies, min_by(page_id, (-quality, page_id)) AS ord, max(quality) AS quality FROM s GROUP BY item, k""",
)
def _(spark, d):
    k = (F.col("page_id") % 4).cast("int")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), k + 1)
    rows = read_table(spark, d, "pages").select(
        (F.col("page_id") % 25).alias("item"), F.col("page_id").alias("ord"), pick("datasheet", "manual", "image", "other").alias("type"), pick("Technical data sheet of it", "Manual", "picture of it", "downloads").alias("label"),
        F.concat(F.lit("https://d.example/"), (F.col("page_id") % 25).cast("string"), F.lit("/"), k.cast("string"), F.lit("?utm_source="), F.col("page_id").cast("string")).alias("url"), F.lit("official").alias("source_type"),
        F.when(F.col("page_id") % 3 == 0, 0.9).otherwise(0.4).alias("confidence"), F.lit(False).alias("held"),
    )
    best = attributes.dedupe_documents(rows)
    return best.select("item", F.regexp_extract("url_key", r"/(\d)$", 1).cast("int").alias("slot"), "first_seen", "copies", "ord", "quality")


# ---------------------------------------------------------------- markup


def _spec_pages(spark, d):
    return spec_page(read_table(spark, d, "part"))


_PRICE = "CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR)"


@query("page_tables", f"SELECT p_partkey AS page_id, 'Width' AS name, p_size || ' mm' AS value FROM part UNION ALL SELECT p_partkey, 'Part price', {_PRICE} || ' | EUR' FROM part")
def _(spark, d):
    return markup.table_rows(_spec_pages(spark, d)).select("page_id", "name", "value")


@query("page_definitions", "SELECT p_partkey AS page_id, 'Brand & model' AS name, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'Product type', p_type FROM part")
def _(spark, d):
    return markup.definition_lists(_spec_pages(spark, d)).select("page_id", "name", "value")


@query(
    "mined_pairs",
    f"""SELECT p_partkey AS page_id, source, name, value FROM part, LATERAL (VALUES ('table', 'Width', p_size || ' mm'), ('table', 'Part price', {_PRICE} || ' | EUR'), ('definition', 'Brand & model', p_brand), ('definition', 'Product type', p_type),
    ('text', 'Voltage', p_size || ' V'), ('text', 'Weight', p_size || ' kg'), ('data', 'data-part-number', CAST(p_partkey AS VARCHAR)), ('data', 'data-weight', p_size || ' kg'), ('hidden', 'Weight', p_size || ' kg')) AS v(source, name, value)""",
)
def _(spark, d):
    return markup.mined_pairs(_spec_pages(spark, d)).select("page_id", "source", "name", "value")


@query("json_ld_products", "SELECT p_partkey AS page_id, CAST(p_partkey AS VARCHAR) AS sku, p_name AS name, p_brand AS brand FROM part")
def _(spark, d):
    return markup.json_products(_spec_pages(spark, d)).select("page_id", "sku", "name", "brand")


@query("breadcrumb_leaves", "SELECT p_partkey AS page_id, '/p/' || p_partkey AS url, 'Leaf' AS name FROM part")
def _(spark, d):
    return markup.breadcrumb_leaves(_spec_pages(spark, d))


@query(
    "json_ld_paths",
    """SELECT p_partkey AS page_id, path, value FROM part, LATERAL (VALUES ('@context', 'x'), ('@graph / 0 / @type', 'Product'), ('@graph / 0 / sku', CAST(p_partkey AS VARCHAR)), ('@graph / 0 / name', p_name), ('@graph / 0 / brand / name', p_brand),
    ('@graph / 1 / @type', 'BreadcrumbList'), ('@graph / 1 / itemListElement / 0 / position', '1'), ('@graph / 1 / itemListElement / 0 / item / @id', '/c'), ('@graph / 1 / itemListElement / 0 / item / name', 'All'),
    ('@graph / 1 / itemListElement / 1 / position', '2'), ('@graph / 1 / itemListElement / 1 / item / @id', '/p/' || p_partkey), ('@graph / 1 / itemListElement / 1 / item / name', 'Leaf')) AS v(path, value)""",
)
def _(spark, d):
    return markup.flatten_json(markup.json_blocks(_spec_pages(spark, d)))


@query("page_images", "SELECT p_partkey AS page_id, CAST(k AS INTEGER) AS ord, '/i/' || p_partkey || ['.jpg', '-1.webp', '-2.webp'][k + 1] AS url FROM part, range(3) AS r(k)")
def _(spark, d):
    return markup.page_images(_spec_pages(spark, d))


@query("page_states", "SELECT page_id, 'page' AS state FROM pages UNION ALL SELECT p_partkey + 1000000, CASE p_partkey % 3 WHEN 0 THEN 'blocked' WHEN 1 THEN 'search' ELSE 'page' END FROM part")
def _(spark, d):
    heads = F.element_at(F.array(F.lit("404 Page not found"), F.lit("Search results for x"), F.lit("A page")), (F.col("p_partkey") % 3 + 1).cast("int"))
    made = read_table(spark, d, "part").select((F.col("p_partkey") + 1_000_000).alias("page_id"), F.concat(F.lit("<html><TITLE>"), heads, F.lit("</TITLE>")).alias("html"))
    return markup.page_state(read_table(spark, d, "pages").select("page_id", "html").union(made))


@query("sitemap_locs", "SELECT n_nationkey AS page_id, CAST(0 AS INTEGER) AS ord, 'https://a.example/?n=' || n_nationkey || '&r=' || n_regionkey AS url FROM nation")
def _(spark, d):
    html = F.concat(F.lit("<urlset><url><loc> https://a.example/?n="), F.col("n_nationkey").cast("string"), F.lit("&amp;r="), F.col("n_regionkey").cast("string"), F.lit("\n</loc></url><url><LOC>ftp://no</LOC></url></urlset>"))
    return markup.sitemap_locs(read_table(spark, d, "nation").select(F.col("n_nationkey").alias("page_id"), html.alias("html")))


@query("robots_sitemaps", "SELECT r_regionkey AS page_id, 'https://r' || r_regionkey || '.example/sitemap.xml' AS url FROM region")
def _(spark, d):
    text = F.concat(F.lit("User-agent: *\nSITEMAP: https://r"), F.col("r_regionkey").cast("string"), F.lit(".example/sitemap.xml \nDisallow: /x"))
    return markup.robots_sitemaps(read_table(spark, d, "region").select(F.col("r_regionkey").alias("page_id"), text.alias("text")))


@query("name_value_lines", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE NULL END AS name, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) END AS value FROM part")
def _(spark, d):
    size = F.col("p_size").cast("string")
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" : "), size)).when(F.col("p_partkey") % 3 == 1, F.concat(size, F.lit(" kg: x"))).otherwise(F.col("p_name"))
    made = split_name_value(line)
    return read_table(spark, d, "part").select("p_partkey", made["name"].alias("name"), made["value"].alias("value"))


# ---------------------------------------------------------------- keys and urls

_PART_KEY = "'AB:' || p_brand || '/' || p_partkey || ' x'"


@query(
    "key_variants",
    """SELECT p_partkey, lower('ABBrand' || regexp_replace(p_brand, '[^0-9]', '', 'g') || p_partkey || 'x') AS compact, p_brand || '/' || p_partkey || ' x' AS after_colon, 'ab_' || replace(lower(p_brand), '#', '_') || '_' || p_partkey || '_x' AS snake,
    'ab-' || replace(lower(p_brand), '#', '-') || '-' || p_partkey || '-x' AS dash, 'AB%3A' || replace(p_brand, '#', '%23') || '%7B%7D' || p_partkey || '%20x' AS slash_braces FROM part""",
)
def _(spark, d):
    key = F.concat(F.lit("AB:"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(" x"))
    return read_table(spark, d, "part").select("p_partkey", keys.key_variants(key).alias("v")).select("p_partkey", "v.*")


@query(
    "template_placeholders",
    """SELECT p_partkey, 'https://c.example/AB%3A' || replace(p_brand, '#', '%23') || '%2F' || p_partkey || '%20x?l=' || replace(lower(p_brand), '#', '%23') || '%2F' || p_partkey || '%20x&d=ab-' || replace(lower(p_brand), '#', '-') || '-' || p_partkey || '-x' AS url FROM part""",
)
def _(spark, d):
    key = F.concat(F.lit("AB:"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(" x"))
    return read_table(spark, d, "part").select("p_partkey", keys.fill_template(F.lit("https://c.example/{part}?l={partAfterColonLower}&d={partDash}"), key).alias("url"))


@query("official_pages", r"SELECT page_id, regexp_matches(url, '^[a-z]+://([^/?#]*\.)?example\.net([/?#]|$)') AS official FROM pages")
def _(spark, d):
    return read_table(spark, d, "pages").select("page_id", urls.is_official_url(F.col("url"), ["example.net"]).alias("official"))


@query(
    "same_urls",
    """SELECT page_id, true AS normalized, NOT contains(url, '?') AS hashless, NOT contains(url, '?') AS origin_and_path FROM (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages WHERE contains(url, '#') OR NOT contains(url, '?'))""",
)
def _(spark, d):
    url = F.col("url")
    other = F.concat(F.regexp_replace(url, "#.*$", ""), F.lit("#other"))
    rows = read_table(spark, d, "pages").filter("contains(url, '#') or not contains(url, '?')")
    return rows.select("page_id", urls.same_normalized_url(url, F.upper(other)).alias("normalized"), urls.same_url_ignoring_hash(url, other).alias("hashless"), urls.same_origin_and_path(url, other).alias("origin_and_path"))


@query(
    "document_types",
    "SELECT p_partkey, ['certificate', 'datasheet', 'manual', 'cad', 'image', 'other'][p_partkey % 6 + 1] AS type, p_partkey % 6 IN (1, 3) AS downloadable FROM part",
)
def _(spark, d):
    k = (F.col("p_partkey") % 6 + 1).cast("int")
    labels = F.array(*map(F.lit, ["Declaration of conformity", "Data sheet", "Installation notes", "3D drawing", "front view", "more"]))
    ends = F.array(*map(F.lit, ["", ".pdf", "", ".stp", ".png", ""]))
    url = F.concat(F.lit("https://a.example/f/"), F.col("p_partkey").cast("string"), F.element_at(ends, k))
    return read_table(spark, d, "part").select("p_partkey", urls.document_type(F.element_at(labels, k), url).alias("type"), urls.is_downloadable_url(url).alias("downloadable"))


@query("candidate_keys", "SELECT page_id, lower(regexp_replace(url, '#.*$', '')) AS candidate_key FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/?#]+/')")
def _(spark, d):
    rows = read_table(spark, d, "pages").filter(F.col("url").rlike("^[a-z]+://[^/?#]+/"))
    return rows.select("page_id", urls.canonical_candidate_key(F.col("url")).alias("candidate_key"))


@query(
    "text_lists",
    "SELECT user_id, list_sort(list_distinct(list(event_type))) AS types, count(*) AS n FROM events GROUP BY 1",
)
def _(spark, d):
    made = read_table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("types"), F.count(F.lit(1)).alias("n"))
    return made.select("user_id", unique_strings("types", "trim").alias("types"), "n")


@query("collapsed_texts", r"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS collapsed, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = '' AS missing, least(length(text), 32000) AS kept FROM documents")
def _(spark, d):
    text = F.col("text")
    return read_table(spark, d, "documents").select("doc_id", F.md5(collapse(text)).alias("collapsed"), collapse_or_null(text).isNull().alias("missing"), F.length(truncated(text)).cast("long").alias("kept"))


# ---------------------------------------------------------------- gates and reviews


def _items(spark, d):
    """Orders as results: identity, confidence, attributes (their lines) and documents."""
    orders, lines = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    counts = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_attributes"), F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("n_documents"), F.collect_set("l_linestatus").alias("have"))
    return orders.join(counts, "o_orderkey", "left").na.fill(0, ["n_attributes", "n_documents"])


ITEMS = """lines AS (SELECT l_orderkey AS o_orderkey, count(*) AS n_attributes, count(*) FILTER (l_returnflag = 'A') AS n_documents, bool_or(l_linestatus = 'F') AS has_f, bool_or(l_linestatus = 'O') AS has_o FROM lineitem GROUP BY 1),
items AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, coalesce(n_attributes, 0) AS n_attributes, coalesce(n_documents, 0) AS n_documents, coalesce(has_f, false) AS has_f, coalesce(has_o, false) AS has_o FROM orders LEFT JOIN lines USING (o_orderkey))"""


@query(
    "quality_gate",
    f"""WITH {ITEMS}, s AS (SELECT *, o_orderstatus <> 'P' AS identity, o_orderkey % 5 = 0 AS far, CASE WHEN has_f THEN 0 ELSE 1 END + CASE WHEN has_o THEN 0 ELSE 1 END AS gaps FROM items),
    t AS (SELECT *, CASE WHEN NOT identity THEN 0 ELSE greatest(0, least(100, 35 + CAST(floor((2 - gaps) / 2.0 * 25 + 0.5) AS INTEGER) + 18 + 12 + CASE WHEN n_attributes >= 2 THEN 6 ELSE 0 END + CASE WHEN n_documents >= 1 THEN 4 ELSE 0 END + CASE WHEN n_attributes < 2 OR n_documents < 1 THEN -12 ELSE 0 END + CASE WHEN far THEN -18 ELSE 8 END + CASE WHEN n_documents > 1 THEN 4 ELSE 0 END + CASE o_orderkey % 3 WHEN 0 THEN 3 WHEN 1 THEN -2 ELSE -4 END)) END AS score,
      array_to_string(list_filter([CASE WHEN NOT identity THEN 'identity' END, CASE WHEN NOT has_f THEN 'attribute:F' END, CASE WHEN NOT has_o THEN 'attribute:O' END, CASE WHEN n_attributes < 2 THEN 'minAttributes:2' END, CASE WHEN n_documents < 1 THEN 'minDocuments:1' END], lambda x: x IS NOT NULL), '; ') AS missing FROM s),
    u AS (SELECT *, CASE WHEN identity AND missing = '' AND score >= 70 THEN 'found' WHEN identity THEN 'partial' ELSE 'failed' END AS grade FROM t)
    SELECT o_orderkey AS item, CAST(score AS INTEGER) AS score, missing, grade, CASE grade WHEN 'found' THEN 0.9 WHEN 'failed' THEN 0.0 ELSE CASE WHEN far THEN 0.45 ELSE 0.74 END END AS confidence FROM u""",
)
def _(spark, d):
    have = F.coalesce("have", F.array().cast("array<string>"))
    missing = F.filter(F.array(*[F.when(~F.array_contains(have, s), f"attribute:{s}") for s in "FO"]), lambda x: x.isNotNull())
    far = F.col("o_orderkey") % 5 == 0
    rows = _items(spark, d).select(
        F.col("o_orderkey").alias("item"), (F.col("o_orderstatus") != "P").alias("identity"), F.lit(0.9).alias("confidence"), "n_attributes", "n_documents", F.lit(2).alias("min_attributes"), (~far).alias("official"),
        far.alias("distributor_only"), F.create_map(F.lit("attribute"), F.lit(2)).alias("n_required"), missing.alias("missing"), F.lit(1).alias("min_documents"), (F.col("n_documents") > 1).alias("telling_document"),
        *[(F.col("o_orderkey") % 3 == k).alias(n) for k, n in enumerate(("template_stage", "reader", "browser"))],
    )
    return gates.score_results(rows)


@query(
    "missing_requirements",
    """SELECT o_orderkey AS item, array_to_string(list_filter([CASE WHEN NOT coalesce(bool_or(l_linestatus = 'F'), false) THEN 'status:F' END, CASE WHEN NOT coalesce(bool_or(l_linestatus = 'O'), false) THEN 'status:O' END, 'status:X'], lambda x: x IS NOT NULL), '; ') AS missing
    FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber > 1) AS l ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(spark, d):
    required = spark.createDataFrame([("status", s) for s in ("X", "O", "F", "O")], "kind string, name string")
    found = read_table(spark, d, "lineitem").filter("l_linenumber > 1").select(F.col("l_orderkey").alias("item"), F.lit("status").alias("kind"), F.col("l_linestatus").alias("name"))
    return gates.missing_requirements(read_table(spark, d, "orders").select(F.col("o_orderkey").alias("item")), found, required).select("item", F.array_join("missing", "; ").alias("missing"))


COVER = f"""{ITEMS}, cover AS (SELECT *, round((CASE WHEN n_attributes > 0 THEN 1 ELSE 0 END + CASE WHEN n_documents > 0 THEN 1 ELSE 0 END + CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END + CASE WHEN o_orderpriority <> '5-LOW' THEN 1 ELSE 0 END) / 4.0, 4) AS coverage,
  array_to_string(list_filter([CASE WHEN NOT n_attributes > 0 THEN 'Attributes' END, CASE WHEN NOT n_documents > 0 THEN 'Documents' END, CASE WHEN NOT o_totalprice > 200000 THEN 'Price' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'Priority' END], lambda x: x IS NOT NULL), '; ') AS lacks FROM items)"""


def _covered(spark, d):
    score, lacks = gates.coverage_of({"Attributes": F.col("n_attributes") > 0, "Documents": F.col("n_documents") > 0, "Price": F.col("o_totalprice") > 200_000, "Priority": F.col("o_orderpriority") != "5-LOW"})
    return _items(spark, d).withColumns({"coverage": score, "lacks": lacks})


_TIER = "CASE WHEN coverage >= 0.9 THEN 'Complete' WHEN coverage >= 0.75 THEN 'Good' WHEN coverage >= 0.6 THEN 'Usable' WHEN coverage > 0 THEN 'Sparse' ELSE 'No data' END"


@query("field_coverage", f"WITH {COVER} SELECT o_orderkey AS item, coverage, lacks, {_TIER} AS tier FROM cover")
def _(spark, d):
    return _covered(spark, d).select(F.col("o_orderkey").alias("item"), "coverage", "lacks", gates.quality_tier(F.col("coverage")).alias("tier"))


REVIEW = f"""{COVER}, st AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'found' WHEN 'O' THEN 'partial' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 0.5 ELSE 0.8 END AS confidence, o_orderkey % 3 <> 0 AS gate FROM cover),
pts AS (SELECT *, CASE status WHEN 'failed' THEN 100 WHEN 'partial' THEN 70 ELSE 0 END + CASE WHEN confidence < 0.65 THEN 20 ELSE 0 END + CASE WHEN coverage < 0.6 THEN 30 ELSE 0 END + CASE WHEN gate THEN 0 ELSE 45 END + CASE WHEN n_attributes = 0 THEN 15 ELSE 0 END
   + CASE WHEN n_documents = 0 THEN 12 ELSE 0 END + CASE WHEN o_orderkey % 11 = 0 THEN 10 ELSE 0 END AS review_points,
   list_filter([CASE status WHEN 'failed' THEN 'Failed scrape' END, CASE status WHEN 'partial' THEN 'Partial scrape' END, CASE WHEN confidence < 0.65 THEN 'Low confidence' END, CASE WHEN coverage < 0.6 THEN 'Low coverage: ' || CAST(floor(coverage * 100 + 0.5) AS INTEGER) || '%' END,
   CASE WHEN NOT gate THEN 'Quality gate failed' END, CASE WHEN n_attributes = 0 THEN 'No attributes' END, CASE WHEN n_documents = 0 THEN 'No documents' END, CASE WHEN o_orderkey % 11 = 0 THEN 'Missing product URL' END], lambda x: x IS NOT NULL) AS why FROM st),
reviewed AS (SELECT o_orderkey AS item, {_TIER} AS tier, CAST(review_points AS INTEGER) AS review_points, CASE WHEN review_points >= 70 THEN 'High' WHEN review_points >= 30 THEN 'Medium' ELSE 'Low' END AS priority, why,
   CASE WHEN status = 'failed' THEN 'Exclude' WHEN len(why) > 0 THEN 'Review' ELSE 'Import' END AS decision FROM pts)"""


def _reviewed(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "found").when(F.col("o_orderstatus") == "O", "partial").otherwise("failed")
    rows = _covered(spark, d).select(
        F.col("o_orderkey").alias("item"), status.alias("status"), F.when(F.col("o_orderkey") % 7 == 0, 0.5).otherwise(0.8).alias("confidence"), "coverage", (F.col("o_orderkey") % 3 != 0).alias("gate_passed"),
        "n_attributes", "n_documents", F.when(F.col("o_orderkey") % 11 != 0, "u").alias("url"),
    )
    return gates.review_rows(rows)


@query("review_rows", f"WITH {REVIEW} SELECT item, tier, review_points, priority, array_to_string(why, '; ') AS reasons, decision FROM reviewed")
def _(spark, d):
    return _reviewed(spark, d)


@query(
    "issue_rows",
    f"""WITH {REVIEW}, x AS (SELECT item, priority, regexp_replace(unnest(why), ':.*$', '') AS issue FROM reviewed), g AS (SELECT issue, count(*) AS n, count(*) FILTER (priority = 'High') AS high, count(*) FILTER (priority = 'Medium') AS medium, count(*) FILTER (priority = 'Low') AS low, array_to_string(list_slice(list(item ORDER BY item), 1, 25), '; ') || CASE WHEN count(*) > 25 THEN '; +' || (count(*) - 25) || ' more' ELSE '' END AS items FROM x GROUP BY 1)
    SELECT issue, CASE WHEN high > 0 THEN 'High' WHEN medium > 0 THEN 'Medium' WHEN low > 0 THEN 'Low' ELSE 'Info' END AS severity, n, high, medium, low, items FROM g""",
)
def _(spark, d):
    return gates.issue_rows(_reviewed(spark, d))


@query(
    "workbook_readiness",
    f"""WITH {REVIEW}, c AS (SELECT count(*) AS total, count(*) FILTER (decision = 'Import') AS ready, count(*) FILTER (decision <> 'Import' AND priority = 'High') AS high, count(*) FILTER (decision <> 'Import' AND priority = 'Medium') AS medium, count(*) FILTER (decision <> 'Import' AND priority = 'Low') AS low FROM reviewed)
    SELECT *, CASE WHEN total = 0 THEN 'No rows exported' WHEN high > 0 THEN 'Needs review before import' WHEN medium + low > 0 THEN 'Review recommended' ELSE 'Ready to import' END AS state FROM c""",
)
def _(spark, d):
    return gates.readiness(_reviewed(spark, d))
