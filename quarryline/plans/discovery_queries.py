"""Queries over candidates, learned templates, merges and further reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import is_official_url
from ..operators import discovery, reports
from ..sources.analogues import spread
from ..sources.tables import read_table
from .base import query

_STAGES = ["learned-endpoint", "direct-template", "search-result", "sitemap", "url-variant"]


def _candidates(spark, d):
    part, key = read_table(spark, d, "part"), F.col("p_partkey")
    number = F.concat(F.lit("AB-"), key.cast("string"))
    urls = F.array(F.concat(F.lit("https://a.example/p/"), number), F.concat(F.lit("https://A.example/p/"), number, F.lit("#x")), F.concat(F.lit("https://b.example/search?q="), number), F.concat(F.lit("https://b.example/f/"), number, F.lit(".pdf")), F.lit("https://a.example/other"))
    rows = part.select(key.alias("item"), number.alias("number"), F.posexplode(urls).alias("ord", "url"))
    stage = F.element_at(F.array(*map(F.lit, _STAGES)), ((F.col("item") + F.col("ord")) % 5 + 1).cast("int"))
    score = discovery.candidate_score(F.col("url"), F.col("number"), stage, is_official_url(F.col("url"), ["a.example"]))
    return rows.select("item", "ord", "url", score.alias("score"))


CANDIDATES = """c AS (SELECT p_partkey AS item, CAST(ord AS INTEGER) AS ord, ['https://a.example/p/AB-' || p_partkey, 'https://A.example/p/AB-' || p_partkey || '#x', 'https://b.example/search?q=AB-' || p_partkey, 'https://b.example/f/AB-' || p_partkey || '.pdf', 'https://a.example/other'][ord + 1] AS url,
  [74, 70, 58, 52, 40][(p_partkey + ord) % 5 + 1] AS base FROM part, range(5) AS r(ord)),
s AS (SELECT item, ord, url, CAST(greatest(0, least(100, base + CASE WHEN ord < 4 THEN 30 ELSE 0 END + CASE WHEN ord < 2 THEN 35 + 15 ELSE 0 END + CASE WHEN ord IN (0, 1, 4) THEN 10 ELSE 0 END - CASE ord WHEN 2 THEN 12 WHEN 3 THEN 45 ELSE 0 END)) AS INTEGER) AS score FROM c)"""


@query("candidate_scores", f"WITH {CANDIDATES} SELECT * FROM s")
def _(spark, d):
    return _candidates(spark, d)


@query(
    "best_candidates",
    f"""WITH {CANDIDATES}, o AS (SELECT *, row_number() OVER (PARTITION BY item, CASE WHEN ord < 2 THEN 0 ELSE ord END ORDER BY score DESC, ord) AS n FROM s)
    SELECT item, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, ord) AS INTEGER) AS rank, url, score FROM o WHERE n = 1""",
)
def _(spark, d):
    return discovery.best_candidates(_candidates(spark, d))


@query("url_identity", "SELECT p_partkey, p_partkey % 4 < 2 AS shown FROM part")
def _(spark, d):
    key = F.col("p_partkey")
    number = F.concat(F.lit("AB-"), key.cast("string"))
    forms = F.array(F.concat(F.lit("https://a.example/x/ab"), key.cast("string"), F.lit("/y")), F.concat(F.lit("https://a.example/?Part_Number="), number), F.concat(F.lit("https://a.example/?other="), number), F.lit("no url"))
    return read_table(spark, d, "part").select("p_partkey", discovery.url_shows_identity(F.element_at(forms, (key % 4 + 1).cast("int")), number).alias("shown"))


@query("learned_templates", "SELECT p_partkey, ['https://a.example/{part}/x', 'https://a.example/?k={partCompact}', 'https://a.example/{partAfterColon}', NULL][p_partkey % 4 + 1] AS template FROM part")
def _(spark, d):
    key = F.col("p_partkey")
    s = F.lpad(key.cast("string"), 6, "0")
    number = F.concat(F.lit("Q:AB-"), s)
    forms = F.array(F.concat(F.lit("https://a.example/q%3Aab-"), s, F.lit("/x")), F.concat(F.lit("https://a.example/?k=QAB"), s), F.concat(F.lit("https://a.example/AB-"), s), F.lit("https://a.example/"))
    return read_table(spark, d, "part").select("p_partkey", discovery.learned_template(F.element_at(forms, (key % 4 + 1).cast("int")), number).alias("template"))


@query("localized_urls", "SELECT p_partkey, locale, 'https://' || CASE locale WHEN 'en' THEN 'a' ELSE 'b' END || '.example/' || lower(replace(p_name, ' ', '-')) AS url FROM part, (VALUES ('en'), ('de')) AS l(locale)")
def _(spark, d):
    made = discovery.localized_urls(F.col("p_name"), {"en": "https://a.example/{partDash}", "de": "https://b.example/{partDash}", "fr": "https://c.example/{part}"})
    return spread(read_table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", F.explode(made).alias("locale", "url"))


@query("value_counts", "SELECT p_type AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, p_type) AS INTEGER) AS rank FROM part GROUP BY 1")
def _(spark, d):
    return reports.value_counts(read_table(spark, d, "part"), "p_type")


@query(
    "compact_lists",
    """WITH l AS (SELECT p_type, list(CAST(p_partkey AS VARCHAR) ORDER BY p_partkey) AS k FROM part GROUP BY 1) SELECT p_type, CASE WHEN len(k) <= 3 THEN array_to_string(k, '; ') ELSE array_to_string(k[1:3], '; ') || '; +' || (len(k) - 3) || ' more' END AS keys FROM l""",
)
def _(spark, d):
    listed = read_table(spark, d, "part").groupBy("p_type").agg(F.transform(F.sort_array(F.collect_list("p_partkey")), lambda x: x.cast("string")).alias("k"))
    return listed.select("p_type", reports.compact_list(F.col("k"), 3).alias("keys"))


@query(
    "column_differences",
    """WITH a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS name, CAST(p_size AS VARCHAR) AS size FROM part), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_name END AS name, CAST(p_size + p_partkey % 2 AS VARCHAR) AS size FROM part WHERE p_partkey % 7 <> 0),
    x AS (SELECT 'name' AS column_name, a.name AS l, nullif(trim(b.name), '') AS r FROM a JOIN b USING (k) UNION ALL SELECT 'size', a.size, b.size FROM a JOIN b USING (k))
    SELECT column_name, count(*) FILTER (l IS NOT NULL AND r IS NULL) AS left_only, count(*) FILTER (l IS NULL AND r IS NOT NULL) AS right_only, count(*) FILTER (l = r) AS "both", count(*) FILTER (l <> r) AS differ, count(*) FILTER (l IS NULL AND r IS NULL) AS both_empty FROM x GROUP BY 1""",
)
def _(spark, d):
    part, key = read_table(spark, d, "part"), F.col("p_partkey")
    left = part.select(key.alias("k"), F.when(key % 3 != 0, F.col("p_name")).alias("name"), F.col("p_size").alias("size"))
    right = part.filter("p_partkey % 7 <> 0").select(key.alias("k"), F.when(key % 5 == 0, " ").otherwise(F.col("p_name")).alias("name"), (F.col("p_size") + key % 2).alias("size"))
    return reports.column_differences(left, right, "k")


@query(
    "sorted_attributes",
    """WITH a AS (SELECT l_orderkey AS item, l_orderkey * 10 + l_linenumber AS ord, l_suppkey, l_partkey, ['Meta', 'Dimensions', 'Technical data', NULL][l_suppkey % 4 + 1] AS grp, [90, 10, 20, 60][l_suppkey % 4 + 1] AS rank FROM lineitem)
    SELECT item, ord, min(place) AS place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY rank, 'n' || l_suppkey % 3, CAST(l_partkey AS VARCHAR), ord) AS INTEGER) AS place FROM a) GROUP BY 1, 2""",
)
def _(spark, d):
    group = F.element_at(F.array(F.lit("Meta"), F.lit("Dimensions"), F.lit("Technical data"), F.lit(None)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    rows = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), group.alias("group"), F.concat(F.lit("N"), (F.col("l_suppkey") % 3).cast("string")).alias("name"), F.col("l_partkey").cast("string").alias("value"))
    return reports.sorted_attributes(rows).groupBy("item", "ord").agg(F.min("place").alias("place"))


@query(
    "processing_summary",
    "SELECT l_orderkey AS item, count(*) FILTER (l_returnflag = 'A') AS parsed, count(*) FILTER (l_returnflag = 'N') AS skipped, count(*) FILTER (l_returnflag = 'R') AS failed, CAST(sum(l_linenumber) AS BIGINT) AS attributes FROM lineitem GROUP BY 1",
)
def _(spark, d):
    action = F.when(F.col("l_returnflag") == "A", "parsed").when(F.col("l_returnflag") == "N", "skipped").when(F.col("l_returnflag") == "R", "failed")
    return reports.processing_summary(read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), action.alias("action"), F.col("l_linenumber").alias("attributes")))


@query(
    "merge_attempts",
    """WITH o AS (SELECT user_id AS item, event_type AS stage, CAST(floor(value / 10) AS BIGINT) AS reason, min(event_id) AS ord FROM events GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ord DESC) AS n FROM o) SELECT item, ord, stage, reason FROM r WHERE n <= 20""",
)
def _(spark, d):
    rows = read_table(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("ord"), F.col("event_type").alias("stage"), F.lit(None).cast("string").alias("url"), F.lit("p").alias("parser"), F.lit("x").alias("status"), F.floor(F.col("value") / 10).alias("reason"))
    return reports.merge_attempts(rows).select("item", "ord", "stage", "reason")


@query(
    "merged_fields",
    """WITH f AS (SELECT l_partkey AS item, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey AS VARCHAR) END AS weight, CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate::DATE::VARCHAR ELSE '' END AS colour FROM lineitem)
    SELECT item, min_by(weight, (ord, weight)) FILTER (weight IS NOT NULL) AS weight, min_by(colour, (ord, colour)) FILTER (colour <> '') AS colour FROM (SELECT item, ord, min(weight) AS weight, min(nullif(colour, '')) AS colour FROM f GROUP BY 1, 2) GROUP BY 1""",
)
def _(spark, d):
    weight, colour = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey").cast("string")), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_shipdate").cast("date").cast("string")).otherwise("")
    rows = read_table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), weight.alias("weight"), colour.alias("colour"))
    rows = rows.groupBy("item", "ord").agg(F.min("weight").alias("weight"), F.coalesce(F.min(F.nullif("colour", F.lit(""))), F.lit("")).alias("colour"))
    return reports.merged_fields(rows, ["weight", "colour"])


@query("source_rates", "SELECT source, count(*) AS n, round(100.0 * count(*) FILTER (n_chars > 500) / count(*), 2) AS long_pct, round(100.0 * count(*) FILTER (lang = 'en') / count(*), 2) AS english_pct FROM documents GROUP BY 1")
def _(spark, d):
    rows = read_table(spark, d, "documents").select("source", (F.col("n_chars") > 500).alias("long"), (F.col("lang") == "en").alias("english"))
    return reports.rates(rows, "source", ["long", "english"])
