"""Queries over comparisons, legends, layouts, normalised fields, device types, completeness and delimited lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import compare, devices, layout, normalize
from ..sources import delimited
from ..sources.analogues import spec_attributes, spread
from ..sources.tables import read_table
from .base import query
from .product_queries import SPECS

# ---------------------------------------------------------------- comparison and legends

_CELLS = """m AS (SELECT 'P-' || p_partkey AS article, CASE p_partkey % 5 WHEN 0 THEN p_size || ' kg' WHEN 1 THEN p_size || ' to ' || (p_size + 5) || ' V' WHEN 2 THEN p_name WHEN 3 THEN '2024-05-12T00:00:00.000Z' ELSE NULL END AS value, p_partkey % 5 AS k, p_partkey, p_size FROM part WHERE p_partkey % 7 <> 0),
g AS (SELECT p_partkey, p_partkey % 5 AS k FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 5 <> 4)"""


def _cells(spark, d):
    part, size, k = read_table(spark, d, "part"), F.col("p_size"), F.col("p_partkey") % 5
    s = size.cast("string")
    manual = F.when(k == 0, F.concat(s, F.lit(" kg"))).when(k == 1, F.concat(s, F.lit(" to "), (size + 5).cast("string"), F.lit(" V"))).when(k == 2, F.col("p_name")).when(k == 3, F.lit("2024-05-12T00:00:00.000Z"))
    made = F.when(k == 0, F.concat(s, F.lit(".0"))).when(k == 1, F.concat(s, F.lit("..."), (size + 5).cast("string"), F.lit(" V"))).when(k == 2, F.concat(F.lit("  "), F.upper("p_name"), F.when(F.col("p_partkey") % 2 == 0, "!").otherwise(""))).when(k == 3, F.lit("12.5")).otherwise(" ")
    common = [F.lit("Sheet 1").alias("sheet"), F.lit("Col  A").alias("column"), F.lit(0).alias("ord")]
    article = F.concat(F.lit("P-"), F.col("p_partkey").cast("string"))
    left = part.filter("p_partkey % 7 <> 0").select(article.alias("article"), manual.alias("value"), *common)
    right = part.filter("p_partkey % 11 <> 0").select(F.lower(article).alias("article"), made.alias("value"), F.lit("sheet 1").alias("sheet"), F.lit("col a").alias("column"), F.lit(0).alias("ord"))
    return compare.compare_cells(left, right)


_STATUS = "CASE WHEN g.p_partkey IS NULL THEN 'manual-only' WHEN m.p_partkey IS NULL THEN 'generated-only' WHEN m.k = 2 AND m.p_partkey % 2 = 0 THEN 'mismatch' ELSE 'match' END"
_JOINED = "(SELECT * FROM m WHERE value IS NOT NULL) AS m FULL OUTER JOIN g ON m.p_partkey = g.p_partkey"


@query("compare_cells", f"WITH {_CELLS} SELECT status, count(*) AS n FROM (SELECT {_STATUS} AS status FROM {_JOINED}) GROUP BY 1")
def _(spark, d):
    return _cells(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "comparison_summary",
    f"""WITH {_CELLS}, s AS (SELECT {_STATUS} AS status FROM {_JOINED}), c AS (SELECT count(*) FILTER (status = 'match') AS match, count(*) FILTER (status = 'mismatch') AS mismatch, count(*) FILTER (status = 'generated-only') AS generated_only, count(*) FILTER (status = 'manual-only') AS manual_only FROM s)
    SELECT match + mismatch AS comparable, match, mismatch, generated_only, manual_only, CASE WHEN match + mismatch = 0 THEN 1.0 ELSE CAST(match AS DOUBLE) / (match + mismatch) END AS precision FROM c""",
)
def _(spark, d):
    return compare.comparison_summary(_cells(spark, d))


@query(
    "legend_codes",
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_size < 10 OR p_size = 10 AND p_partkey % 4 = 0 THEN '1' WHEN p_size <= 25 THEN '2' ELSE '3' END ELSE [NULL, '2', '3'][p_partkey % 3 + 1] END AS code FROM part",
)
def _(spark, d):
    key = F.col("p_partkey")
    volts = F.concat(F.col("p_size").cast("string"), F.when(key % 4 == 0, " V").otherwise(""))
    words = F.element_at(F.array(F.lit("ac?dc"), F.lit("AC, alternating current"), F.lit("3")), (key % 3 + 1).cast("int"))
    text = F.when(key % 2 == 0, F.lit("Range 1 - < 10 V 2 - 10 V to 25 V 3 - greater than 25 V")).otherwise(F.lit("Kind 1 - AC 2 - AC alternating current 3 - DC"))
    return spread(read_table(spark, d, "part"), "p_partkey").select("p_partkey", compare.match_legend(text, F.when(key % 2 == 0, volts).otherwise(words))["code"].alias("code"))


# ---------------------------------------------------------------- layout


def _positioned(spark, d):
    """Line items as a page's cells: an order is a page, lines are rows, three texts stand near three headers."""
    rows = spread(read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    cells = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x"), t.cast("string").alias("text")) for x, t in ((52, F.col("l_partkey")), (148, F.col("l_suppkey")), (157, F.lit("kg")), (330, F.col("l_linenumber")))])).alias("c")
    y = 700 - F.col("l_linenumber") * 12 + F.when(F.col("l_suppkey") % 2 == 0, 0.4).otherwise(-0.4)
    items = rows.select(F.lit(1).alias("doc"), F.col("l_orderkey").alias("page"), cells, y.alias("y")).select("doc", "page", "c.text", "c.x", "y")
    pages = rows.select(F.lit(1).alias("doc"), F.col("l_orderkey").alias("page")).distinct()
    headers = pages.select("doc", "page", F.inline(F.array(*[F.struct(F.lit(t).alias("text"), F.lit(float(x)).alias("x")) for t, x in (("Part", 50), ("Supplier", 150), ("Other", 400))])))
    return items, headers


@query(
    "positioned_tables",
    """WITH r AS (SELECT l_orderkey AS page, l_partkey, l_suppkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS row FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2))
    SELECT page, row, 'Part' AS "column", CAST(l_partkey AS VARCHAR) AS value FROM r UNION ALL SELECT page, row, 'Supplier', l_suppkey || ' kg' FROM r UNION ALL SELECT page, row, NULL, CAST(l_linenumber AS VARCHAR) FROM r""",
)
def _(spark, d):
    return layout.table_cells(*_positioned(spark, d)).select("page", "row", "column", "value")


@query(
    "carried_headers",
    "SELECT o_custkey AS doc, o_orderkey AS page, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS header FROM orders",
)
def _(spark, d):
    rows = read_table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("header"))
    return layout.carried_headers(rows)


@query(
    "tight_contexts",
    r"""WITH l AS (SELECT doc_id, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS line FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS s FROM documents)),
    f AS (SELECT *, contains(text, 'License') AS own, NOT contains(text, 'License') AND len(list_filter(list_transform(regexp_extract_all(text, '(?i)\b[A-Z0-9]{2,}([-:/.][A-Z0-9]+)+\b|\b[A-Z]{2,}[0-9]{3,}\b'), lambda t: regexp_replace(lower(t), '[^a-z0-9]+', '', 'g')), lambda c: length(c) >= 4 AND regexp_matches(c, '[0-9]'))) > 0 AS other FROM l),
    w AS (SELECT *, max(CASE WHEN own THEN line END) OVER b AS oa, max(CASE WHEN other THEN line END) OVER b AS fa, min(CASE WHEN own THEN line END) OVER a AS ob, min(CASE WHEN other THEN line END) OVER a AS fb FROM f
      WINDOW b AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT doc_id, CAST(line AS INTEGER) AS line, md5(text) AS text FROM w WHERE (line - oa <= 30 AND coalesce(fa, -1) < oa) OR (ob - line <= 6 AND ob < coalesce(fb, 1000000000))""",
)
def _(spark, d):
    return layout.tight_contexts(read_table(spark, d, "documents"), F.contains(F.col("text"), F.lit("License"))).withColumn("text", F.md5("text"))


@query(
    "character_windows",
    """WITH RECURSIVE o AS (SELECT doc_id, lower(text) AS t, length(text) AS n, CAST(strpos(lower(text), 'license') - 1 AS BIGINT) AS pos FROM documents WHERE strpos(lower(text), 'license') > 0
      UNION ALL SELECT doc_id, t, n, pos + 2501 + strpos(substr(t, pos + 2502), 'license') - 1 FROM o WHERE strpos(substr(t, pos + 2502), 'license') > 0)
    SELECT doc_id, CAST(greatest(0, pos - 2000) AS INTEGER) AS "begin", CAST(least(n, pos + 2500) AS INTEGER) AS "end" FROM o""",
)
def _(spark, d):
    return layout.character_windows(read_table(spark, d, "documents"), "License")


# ---------------------------------------------------------------- fields, devices, completeness

_FIRST = f"""{SPECS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY item, k ORDER BY confidence DESC, ord) AS r FROM specs), f AS (SELECT * FROM ranked WHERE r = 1)"""


@query(
    "normalized_fields",
    f"""WITH {_FIRST} SELECT item, max(CASE WHEN k = 2 THEN q || ' kg' END) AS weight, CAST(NULL AS VARCHAR) AS dimensions, max(CASE WHEN k = 5 THEN ['Steel', 'aluminum', 'Plastic'][q % 3 + 1] END) AS material, CAST(NULL AS VARCHAR) AS "wallThickness",
    CAST(NULL AS VARCHAR) AS finish, max(CASE WHEN k = 8 THEN 'RAL ' || (7000 + q) END) AS color, max(CASE WHEN k = 0 THEN q || ' V DC ±' || tol || '%' END) AS voltage, max(CASE WHEN k = 1 THEN q || ' A at 40 °C' END) AS current,
    max(CASE WHEN k = 6 THEN 'IP' || (20 + q) END) AS protection, CAST(NULL AS VARCHAR) AS certificates, max(CASE WHEN k = 4 THEN CAST(-q AS VARCHAR) END) AS "operatingTemperatureMin", max(CASE WHEN k = 4 THEN CAST(q + 20 AS VARCHAR) END) AS "operatingTemperatureMax"
    FROM f WHERE k IN (0, 1, 2, 4, 5, 6, 8) GROUP BY 1""",
)
def _(spark, d):
    return normalize.normalized_fields(spec_attributes(read_table(spark, d, "lineitem")))


@query(
    "normalized_part_fields",
    """WITH b AS (SELECT p_partkey AS item, p_size AS s, CAST(p_partkey % 6 AS INTEGER) AS k FROM part)
    SELECT item, s || ' x ' || (s + 1) || ' x ' || (s + 2) || ' mm' AS dimensions, ['stainless steel Type 304', 'PA66', 'glass-fiber reinforced polyamide', 'aluzinc coated steel', 'plastic', 'polyamide GF30'][k + 1] AS material, s || ' mm' AS "wallThickness",
    'Black powder coated' AS finish, ['light gray', 'gray; black', 'RAL ' || (7000 + s), 'ANSI-61 gray', 'blue', NULL][k + 1] AS color, ['cULus Listed E' || item, 'IEC 60947-1; CE', 'Registro Italiano Navale', 'CSA C22.2 No. 14; UL 508', 'TÜV; RoHS; CE', NULL][k + 1] AS certificates FROM b""",
)
def _(spark, d):
    key, s, k = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), (F.col("p_partkey") % 6 + 1).cast("int")
    pick = lambda *texts: F.element_at(F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts]), k)
    size = F.concat(s, F.lit(" x "), (F.col("p_size") + 1).cast("string"), F.lit(" x "), (F.col("p_size") + 2).cast("string"), F.lit(" mm"))
    values = {
        "Abmessungen": size, "Werkstoff": pick("Edelstahl V2A", "PA66", "Glass fiber reinforced polyamide", "aluzinc coated steel", "Kunststoff", "PA 6 GF30"), "Wall thickness": F.concat(s, F.lit(" mm sheet")), "Finish": F.lit("Black powder coated. Door"),
        "Farbe": pick("hellgrau", "GREY and schwarz", F.concat(F.lit("RAL"), (F.col("p_size") + 7000).cast("string")), "ANSI 61 gray", "bleu", "none"),
        "Certificates": pick(F.concat(F.lit("cULus Listed E"), key), "CE, IEC 60947-1", "Registro Italiano Navale", "CSA C22.2 No. 14; UL 508", "rohs CE tüv", "none"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(name).alias("name"), value.alias("value")) for i, (name, value) in enumerate(values.items())]))
    rows = read_table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.lit(0.5).alias("confidence"), each.alias("x")).select("item", "confidence", "x.ord", "x.name", "x.value")
    return normalize.normalized_fields(rows).select("item", "dimensions", "material", "wallThickness", "finish", "color", "certificates")


@query(
    "weights_and_dimensions",
    """SELECT p_partkey, p_size * CAST(CASE p_partkey % 3 WHEN 0 THEN 0.001 WHEN 1 THEN 0.45359237 ELSE 0.028349523125 END AS DOUBLE) AS kilograms, p_size * CASE WHEN p_partkey % 2 = 0 THEN 10.0 ELSE 25.4 END AS height, (p_size + 1) * CASE WHEN p_partkey % 2 = 0 THEN 10.0 ELSE 25.4 END AS width,
    CASE WHEN p_partkey % 2 = 0 THEN (p_size + 2) * 10.0 END AS depth, CASE WHEN p_partkey % 2 = 0 THEN p_size || ' x ' || (p_size + 1) || ' x ' || (p_size + 2) || ' cm (' || p_size * 10 || ' x ' || (p_size + 1) * 10 || ' x ' || (p_size + 2) * 10 || ' mm)' END AS shown FROM part""",
)
def _(spark, d):
    n, key = F.col("p_size"), F.col("p_partkey")
    s = [(n + k).cast("string") for k in range(3)]
    weight = F.concat(s[0], F.element_at(F.array(F.lit(" g"), F.lit(" lbs"), F.lit(" oz")), (key % 3 + 1).cast("int")))
    size = F.when(key % 2 == 0, F.concat(s[0], F.lit(" x "), s[1], F.lit(" x "), s[2], F.lit(" cm"))).otherwise(F.concat(F.lit("H "), s[0], F.lit(" in W "), s[1], F.lit(" in")))
    parts = normalize.dimension_parts(size)
    return read_table(spark, d, "part").select("p_partkey", normalize.weight_kilograms(weight).alias("kilograms"), parts["height"].alias("height"), parts["width"].alias("width"), parts["depth"].alias("depth"), normalize.dimension_text(size).alias("shown"))


_RULES = [("text", r"\bring\b", "Ring", 1000), ("text", r"\bwidget\b", "Widget", 1200), ("text", r"\bsmall\b", "Small part", 700), ("family", "^Brand#1", "Ring", 1400), ("url", "/eco", "Widget", 1300), ("eclass", "^27", "Small part", 1450)]


def _signals(spark, d):
    part = read_table(spark, d, "part")
    key = F.col("p_partkey")
    texts = F.inline(F.array(*[
        F.struct(F.lit(c).alias("channel"), t.alias("text"), F.lit(p).alias("priority"), s.alias("source_type"))
        for c, t, p, s in (
            ("text", F.col("p_name"), 100, F.when(key % 2 == 0, "official").otherwise("distributor")), ("family", F.col("p_brand"), 0, F.lit(None).cast("string")),
            ("url", F.concat(F.lit("https://a.example/"), F.lower("p_type")), 0, F.lit(None).cast("string")), ("eclass", F.when(key % 5 == 0, "27-1").otherwise("none"), 0, F.lit(None).cast("string")),
        )
    ]))
    return devices.type_signals(part.select(key.alias("item"), texts), spark.createDataFrame(_RULES, "channel string, pattern string, type string, points int"))


DEVICES = r"""b AS (SELECT *, 100 + CASE WHEN p_partkey % 2 = 0 THEN 90 ELSE -40 END AS plus FROM part),
s AS (SELECT p_partkey AS item, 'Ring' AS type, 1000.0 + plus AS score FROM b WHERE regexp_matches(p_name, '(?i)\bring\b') UNION ALL SELECT p_partkey, 'Widget', 1200.0 + plus FROM b WHERE regexp_matches(p_name, '(?i)\bwidget\b')
  UNION ALL SELECT p_partkey, 'Small part', 700.0 + plus FROM b WHERE regexp_matches(p_name, '(?i)\bsmall\b') UNION ALL SELECT p_partkey, 'Ring', 1400 * 1.2 FROM b WHERE starts_with(p_brand, 'Brand#1')
  UNION ALL SELECT p_partkey, 'Widget', 1300.0 FROM b WHERE contains('/' || lower(p_type), '/eco') UNION ALL SELECT p_partkey, 'Small part', 1450 * 1.25 FROM b WHERE p_partkey % 5 = 0),
t AS (SELECT item, type, CAST(sum(score) + 250 * (count(*) - 1) AS DOUBLE) AS score, count(*) AS channels FROM s GROUP BY 1, 2),
r AS (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY item ORDER BY score DESC, type)),
c AS (SELECT *, score - coalesce(second, 0) AS margin, CASE WHEN score >= 1500 THEN 0.98 WHEN score >= 1420 THEN 0.94 WHEN score >= 1320 THEN 0.88 WHEN score >= 1200 THEN 0.78 ELSE 0.68 END AS base FROM r WHERE n = 1),
devices AS (SELECT item, type, score, margin, channels, round(CASE WHEN second IS NOT NULL AND margin < 200 THEN greatest(0.5, CASE WHEN channels >= 2 THEN least(0.99, base + 0.05) ELSE base END - 0.12) WHEN channels >= 2 THEN least(0.99, base + 0.05) ELSE base END, 2) AS confidence FROM c)"""


@query("device_types", f"WITH {DEVICES} SELECT * FROM devices")
def _(spark, d):
    return devices.classify_devices(_signals(spark, d))


_FIELDS = ["weight", "material", "voltage", "current", "image"]
REQUIRED = f"""{DEVICES}, need AS (SELECT item, field, CASE WHEN field IN ('voltage', 'current') THEN CASE WHEN type = 'Widget' OR type = 'Ring' AND field = 'voltage' THEN 'required' ELSE 'not-applicable' END WHEN field = 'weight' AND type = 'Ring' THEN 'required' ELSE 'preferred' END AS requirement
  FROM devices, (SELECT unnest({_FIELDS!r}) AS field))"""


def _requirements(spark, d):
    profiles = spark.createDataFrame([("Ring", ["weight"], ["voltage"]), ("Widget", [], ["voltage", "current"])], "type string, critical array<string>, electrical array<string>")
    return devices.field_requirements(devices.with_profiles(devices.classify_devices(_signals(spark, d)), profiles), _FIELDS)


@query("field_requirements", f"WITH {REQUIRED} SELECT * FROM need")
def _(spark, d):
    return _requirements(spark, d)


@query(
    "completeness_audit",
    f"""WITH {REQUIRED}, audit AS (SELECT *, (item + length(field)) % 3 = 0 AS b, (item + length(field)) % 3 = 0 OR item % 2 = 0 AND field <> 'image' AS a, item % 4 = 0 AS r, CASE WHEN item % 5 = 0 THEN true WHEN item % 5 = 1 THEN false END AS again FROM need)
    SELECT item, field, requirement, CASE WHEN requirement = 'not-applicable' THEN 'not-applicable' WHEN a AND b THEN 'present' WHEN a THEN CASE WHEN r THEN 'found-after-repair' ELSE 'found-after-retry' END WHEN again THEN 'not-published' WHEN NOT again THEN 'retry-skipped' ELSE 'missing' END AS status FROM audit""",
)
def _(spark, d):
    need = _requirements(spark, d)
    keys = need.select("item", "field")
    was = (F.col("item") + F.length("field")) % 3 == 0
    before = keys.select("item", "field", F.when(was, "x").otherwise("").alias("value"))
    after = keys.select("item", "field", F.when(was | ((F.col("item") % 2 == 0) & (F.col("field") != "image")), "y").alias("value"))
    retried = F.when(F.col("item") % 5 == 0, True).when(F.col("item") % 5 == 1, False)
    return devices.completeness(need, before, after, keys.filter("item % 4 = 0"), retried)


# ---------------------------------------------------------------- delimited lines


def _lines(spark, d):
    """Parts as files of a delimiter each: file 0 has a header, file 1 none, file 2 a header without a name for keys."""
    part = read_table(spark, d, "part")
    key, kind = F.col("p_partkey"), F.col("p_partkey") % 3
    number = F.concat(F.lit("AB-"), F.lpad(F.floor(key / 6).cast("string"), 6, "0"))
    line = F.when(kind == 0, F.concat(number, F.lit(';"'), "p_name", F.lit('; ""x""";'), F.col("p_size").cast("string"))).when(kind == 1, F.concat(number, F.lit(","), F.col("p_name"))).otherwise(F.concat(F.col("p_name"), F.lit("\t"), F.lower(number), F.lit("\t\textra")))
    rows = part.select(kind.cast("string").alias("file"), (key + 10).alias("ord"), line.alias("line"))
    heads = spark.createDataFrame([("0", 0, "Part no;Title;Size"), ("2", 0, "title\tcode\t\t")], "file string, ord long, line string")
    return rows.unionByName(heads)


@query("delimited_keys", "SELECT CAST(p_partkey % 3 AS VARCHAR) AS file, min(p_partkey) + 10 AS ord, CASE WHEN p_partkey % 3 = 2 THEN 'ab-' ELSE 'AB-' END || lpad(CAST(p_partkey // 6 AS VARCHAR), 6, '0') AS catalog_number FROM part GROUP BY 1, 3")
def _(spark, d):
    return delimited.catalog_numbers(delimited.table_rows(_lines(spark, d)))


@query(
    "delimited_fields",
    """SELECT CAST(p_partkey % 3 AS VARCHAR) AS file, p_partkey + 10 AS ord, CASE p_partkey % 3 WHEN 0 THEN p_name || '; "x"' WHEN 1 THEN NULL ELSE p_name END AS title, CASE p_partkey % 3 WHEN 2 THEN '' END AS third FROM part""",
)
def _(spark, d):
    rows = delimited.table_rows(_lines(spark, d))
    title = F.coalesce(F.try_element_at("fields", F.lit("Title")), F.try_element_at("fields", F.lit("title")))
    return rows.select("file", "ord", title.alias("title"), F.try_element_at("fields", F.lit("Column 3")).alias("third"))


@query("delimited_key_columns", "SELECT * FROM (VALUES ('0', 'Part no'), ('1', 'Catalog Number'), ('2', 'code')) AS v(file, key_column) WHERE (SELECT count(*) FROM part) > 0")
def _(spark, d):
    return delimited.key_column(delimited.table_rows(_lines(spark, d)))


@query("flat_json", "SELECT event_id, 'k ' || json_extract_string(props, '$.k') AS line FROM events")
def _(spark, d):
    return read_table(spark, d, "events").select("event_id", F.explode(delimited.flat_json(F.col("props"))).alias("line"))
