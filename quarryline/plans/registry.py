"""All queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ENTITIES, clean_text, compact_key, plain_numbers, slug
from ..operators import pages, reports, resolve, state
from ..sources.tables import read_table
from ..streaming.health import hourly_counts
from . import discovery_queries, embedded_queries, fact_queries, learning_queries, product_queries, prose_queries, repair_queries, report_queries, state_queries  # noqa: F401  (they register their queries)
from .base import REGISTRY, query

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _clean(value: str) -> str:
    """Entities by number, then by name, mojibake, white space."""
    out = f"coalesce({value}, '')"
    for entity, digits in (("&#[xX][0-9a-fA-F]+;", "x0*([0-9a-fA-F]{1,6})"), ("&#[0-9]+;", "0*([0-9]{1,7})")):
        number = f"regexp_extract(t, '^&#{digits.replace('x0', '[xX]0')};$', 1)"
        point = f"CAST('0x' || {number} AS INTEGER)" if "x" in digits else f"CAST({number} AS INTEGER)"
        char = f"CASE WHEN regexp_matches(t, '^{entity}$') AND {number} <> '' THEN CASE WHEN {point} <= 1114111 THEN chr({point}) ELSE t END ELSE t END"
        out = f"array_to_string(list_transform(regexp_extract_all({out}, '{entity}|&|[^&]+'), lambda t: {char}), '')"
    for name, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&apos;|&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&deg;", "°"), ("&sup2;", "²"), ("&micro;", "µ")):
        out = f"regexp_replace({out}, '{name}', '{sign}', 'gi')"
    for broken, sign in (("â€¦", "..."), ("â€“", "-"), ("â€”", "-"), ("Â°", "°"), ("Â²", "²")):
        out = f"replace({out}, '{broken}', '{sign}')"
    return f"trim(regexp_replace({out}, '[\\s\\x0B\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+', ' ', 'g'))"


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1)), '^www\\.', '')"
_BARE = "regexp_replace(trim(coalesce(url, '')), '#.*$', '')"
_PARAMS = (
    f"array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(regexp_extract({_BARE}, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches("
    "lower(regexp_extract(p, '^[^=]*')), '^(utm_.*|fbclid|gclid|msclkid|_gl|cachebust|cachebuster|timestamp|ts)$')), lambda p, i: {'k': lower(regexp_extract(p, '^[^=]*')), 'i': i, 'p': p})), lambda x: x.p), '&')"
)
_URL_KEY = f"lower(regexp_extract({_BARE}, '^[^?]*') || CASE WHEN {_PARAMS} <> '' THEN '?' || {_PARAMS} ELSE '' END)"
_LINKS = rf"""
anchors AS (SELECT page_id, url, {_clean("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title, unnest(a) AS anchor, generate_subscripts(a, 1) - 1 AS ord FROM (SELECT *, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS a FROM pages)),
links AS (SELECT page_id, url, title, CAST(ord AS INTEGER) AS ord, regexp_extract(anchor, 'href="([^"]*)"', 1) AS href, {_clean("regexp_extract(anchor, '>([^<]*)<', 1)")} AS label FROM anchors),
keyed AS (SELECT *, first_value(label) OVER (PARTITION BY page_id, url ORDER BY ord) AS catalogue_number, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*')) || href AS target FROM links),
tests AS (SELECT *, lower(target || ' ' || label) AS hay, lower(target) AS low, regexp_replace(lower(target || ' ' || label), '[^a-z0-9]', '', 'g') AS chay, regexp_replace(lower(target), '[^a-z0-9]', '', 'g') AS clow,
  lower(trim(catalogue_number)) AS n, regexp_replace(lower(catalogue_number), '[^a-z0-9]', '', 'g') AS c, list_transform(string_split(href, '/'), lambda s: regexp_replace(lower(s), '[^a-z0-9]', '', 'g')) AS parts FROM keyed),
flags AS (SELECT *, n <> '' AND (contains(hay, n) OR length(c) >= 4 AND contains(chay, c)) AS named, n <> '' AND (contains(low, n) OR length(c) >= 4 AND contains(clow, c)) AS in_url, list_contains(parts, c) AS segment FROM tests),
scores AS (SELECT page_id, ord, target AS url, label, CAST(CASE WHEN named THEN 55 ELSE 0 END + CASE WHEN in_url THEN 25 ELSE 0 END + CASE WHEN segment THEN 50 ELSE 0 END
  + CASE WHEN regexp_matches(low, '\b(product|products|sku|catalog|detail|details|pdp|partnumber_info|skupage)\b|/p/|/item/') THEN 25 ELSE 0 END + CASE WHEN regexp_matches(lower(label), '\b(view|details?|product|catalog|part number|sku)\b') THEN 10 ELSE 0 END
  - CASE WHEN regexp_matches(low, '[?&](q|query|search|s|term)=') THEN 15 ELSE 0 END - CASE WHEN regexp_matches(low, '\b(cart|login|account|support|contact|news|blog|privacy|terms|download|pdf|image|thumbnail)\b') THEN 35 ELSE 0 END
  - CASE WHEN regexp_matches(low, '\.(pdf|zip|dwg|dxf|stp|step|png|jpe?g|webp)([?#]|$)') THEN 50 ELSE 0 END AS INTEGER) AS score, named OR segment AS confirmed FROM flags),
judged AS (SELECT *, CASE WHEN NOT confirmed THEN 'no exact catalog identity' WHEN score < 35 THEN 'low score' ELSE 'candidate' END AS verdict FROM scores)
"""
_TOP = """
once AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(url) ORDER BY score DESC, ord) AS n FROM judged WHERE verdict = 'candidate'),
ranked AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, length(url), ord) AS INTEGER) AS rank, url, label, score FROM once WHERE n = 1)
"""


@query("page_titles", f"SELECT page_id, {_clean("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title FROM pages")
def _(spark, d):
    return pages.page_titles(read_table(spark, d, "pages"))


@query("page_hosts", f"SELECT page_id, {_HOST} AS host, {_URL_KEY} AS url_key FROM pages")
def _(spark, d):
    return pages.page_hosts(read_table(spark, d, "pages"))


@query("page_links", f"WITH {_LINKS} SELECT page_id, ord, href, label FROM links")
def _(spark, d):
    return pages.page_links(read_table(spark, d, "pages"))


@query("link_scores", f"WITH {_LINKS} SELECT page_id, ord, url, label, score, verdict FROM judged")
def _(spark, d):
    return pages.link_scores(read_table(spark, d, "pages"))


@query("best_links_per_page", f"WITH {_LINKS}, {_TOP} SELECT * FROM ranked WHERE rank <= 8")
def _(spark, d):
    return pages.top_links(read_table(spark, d, "pages"))


@query(
    "dedupe_documents_by_url",
    f"""WITH k AS (SELECT page_id, {_URL_KEY} AS url_key, length(html) AS size FROM pages)
    SELECT url_key, min(page_id) AS first_seen, arg_max(page_id, size * 1000000000 - page_id) AS page_id, count(*) AS copies FROM k GROUP BY 1""",
)
def _(spark, d):
    return pages.distinct_urls(read_table(spark, d, "pages"))


@query(
    "source_lookup_two_tier",
    r"""WITH k AS (SELECT page_id, url, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') AS o, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages),
    m AS (SELECT page_id, min(page_id) OVER (PARTITION BY url) AS u, min(page_id) OVER (PARTITION BY lower(o), CASE WHEN p = '' THEN '/' ELSE p END) AS h FROM k)
    SELECT page_id, CASE WHEN u < page_id THEN u WHEN h < page_id THEN h END AS source_page, CASE WHEN u < page_id THEN 'url' WHEN h < page_id THEN 'origin_and_path' END AS tier FROM m""",
)
def _(spark, d):
    return pages.source_lookup(read_table(spark, d, "pages"))


@query("clean_text", f"SELECT doc_id, md5({_clean('text')}) AS cleaned FROM documents")
def _(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.md5(clean_text(F.col("text"))).alias("cleaned"))


@query("compact_keys", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS compact, substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS slug FROM part")
def _(spark, d):
    return read_table(spark, d, "part").select("p_partkey", compact_key(F.col("p_name")).alias("compact"), slug(F.col("p_name")).alias("slug"))


@query(
    "template_fill_urls",
    "SELECT p_partkey, 'https://catalog.example/' || lower(replace(p_brand, '#', '-')) || '/' || regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') || '/' || p_partkey AS url FROM part",
)
def _(spark, d):
    filled = F.lit("https://catalog.example/{brandLower}/{partCompact}/{key}")
    parts = {"{brandLower}": F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-"))), "{partCompact}": compact_key(F.col("p_name")), "{key}": F.col("p_partkey").cast("string")}
    for name, value in parts.items():
        filled = F.replace(filled, F.lit(name), value)
    return read_table(spark, d, "part").select("p_partkey", filled.alias("url"))


@query(
    "number_separators",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.5 kg' ELSE CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) AS VARCHAR) || ' kg' END AS number FROM lineitem WHERE l_linenumber % 4 <> 2 OR l_extendedprice >= 1000""",
)
def _(spark, d):
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    grouped = F.format_number(price, 2)
    swapped = F.translate(grouped, ",.", ".,")
    k = F.col("l_linenumber") % 4
    text = F.when(k == 0, grouped).when(k == 1, price.cast("string")).when(k == 2, swapped).otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(",5")))
    rows = read_table(spark, d, "lineitem").filter((k != 2) | (F.col("l_extendedprice") >= 1000))
    return rows.select("l_orderkey", "l_linenumber", plain_numbers(F.concat(text, F.lit(" kg"))).alias("number"))


_NUMBER = r"""CASE WHEN NOT regexp_matches(t, '^[0-9]') THEN t
    WHEN contains(t, ',') AND contains(t, '.') AND regexp_matches(t, ',[^.]*$') THEN replace(string_split(t, ',')[1], '.', '') || '.' || string_split(t, ',')[2]
    WHEN contains(t, ',') AND contains(t, '.') THEN replace(string_split(t, '.')[1], ',', '') || '.' || string_split(t, '.')[2]
    WHEN regexp_matches(t, '^[1-9][0-9]{0,2}(,[0-9]{3})+$') THEN replace(t, ',', '') WHEN contains(t, ',') THEN replace(t, ',', '.')
    WHEN regexp_matches(t, '^[1-9][0-9]{0,2}([.][0-9]{3}){2,}$') THEN replace(t, '.', '') ELSE t END"""


@query("number_separators_in_texts", f"SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '[^0-9]+|[0-9]([0-9.,]*[0-9])?'), lambda t: {_NUMBER}), '')) AS plain FROM documents")
def _(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.md5(plain_numbers(F.col("text"))).alias("plain"))


@query("latest_wins", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(spark, d):
    return state.latest_wins(read_table(spark, d, "events"))


@query(
    "learned_endpoints_topk",
    """WITH u AS (SELECT user_id, event_type, count(*) AS uses, max(ts) AS last_used FROM events GROUP BY 1, 2)
    SELECT user_id, CAST(rank AS INTEGER) AS rank, event_type, uses FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY uses DESC, last_used DESC, event_type) AS rank FROM u) WHERE rank <= 3""",
)
def _(spark, d):
    return state.learned_top(read_table(spark, d, "events"))


@query("exhausted_ttl_antijoin", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01')")
def _(spark, d):
    return state.open_after_ttl(read_table(spark, d, "orders"), read_table(spark, d, "customer"), "1998-01-01")


@query(
    "run_recount",
    """SELECT o_orderpriority AS run, count(*) AS items, count(*) FILTER (o_orderstatus = 'F') AS found, count(*) FILTER (o_orderstatus = 'O') AS open_items,
    count(*) FILTER (o_orderstatus = 'P') AS partial FROM orders GROUP BY 1""",
)
def _(spark, d):
    return state.recount(read_table(spark, d, "orders"))


@query(
    "resolve_candidates",
    """WITH c AS (SELECT l_partkey AS item, CASE l_returnflag WHEN 'N' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS priority, 1 - l_discount AS confidence, l_suppkey AS value, l_orderkey, l_linenumber FROM lineitem),
    b AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY priority DESC, confidence DESC, l_orderkey, l_linenumber) AS n FROM c),
    k AS (SELECT item, count(DISTINCT value) - 1 AS conflicts, count(*) AS candidates FROM c GROUP BY 1)
    SELECT item, value AS resolved, priority, conflicts, candidates FROM b JOIN k USING (item) WHERE n = 1""",
)
def _(spark, d):
    return resolve.resolve_candidates(resolve.lineitem_candidates(read_table(spark, d, "lineitem")))


@query(
    "full_outer_compare",
    """WITH l AS (SELECT doc_id, quality AS v, 1 AS here FROM labels), r AS (SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS w, 1 AS there FROM documents)
    SELECT doc_id, CASE WHEN here IS NULL THEN 'right_only' WHEN there IS NULL THEN 'left_only' WHEN l.v IS NOT DISTINCT FROM r.w THEN 'match' ELSE 'mismatch' END AS verdict FROM l FULL OUTER JOIN r USING (doc_id)""",
)
def _(spark, d):
    long = read_table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("quality"))
    return resolve.compare_relations(read_table(spark, d, "labels"), long, "doc_id", "quality")


@query(
    "multi_channel_score",
    """WITH s AS (SELECT p_partkey, string_split(p_type, ' ')[-1] AS kind, 5 AS points FROM part
      UNION ALL SELECT p_partkey, CASE WHEN p_size < 17 THEN 'small' WHEN p_size < 34 THEN 'medium' ELSE 'large' END, 3 FROM part
      UNION ALL SELECT p_partkey, string_split(p_type, ' ')[-1], CASE WHEN ends_with(p_brand, '1') THEN 2 ELSE 0 END FROM part),
    g AS (SELECT p_partkey, kind, CAST(sum(points) AS BIGINT) AS points FROM s GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER w AS n, lead(points, 1, 0) OVER w AS nx FROM g WINDOW w AS (PARTITION BY p_partkey ORDER BY points DESC, kind))
    SELECT p_partkey, kind, points, points - nx AS margin FROM r WHERE n = 1""",
)
def _(spark, d):
    return resolve.classify_channels(read_table(spark, d, "part"))


@query(
    "quality_grades",
    """WITH s AS (SELECT doc_id, CAST(CASE WHEN n_chars >= 200 THEN 40 ELSE 0 END + CASE WHEN lang IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN contains(text, chr(10)) THEN 10 ELSE 0 END + coalesce(quality, 0) * 30 AS INTEGER) AS score
    FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, score, CASE WHEN score >= 90 THEN 'found' WHEN score >= 50 THEN 'partial' ELSE 'failed' END AS grade FROM s""",
)
def _(spark, d):
    return resolve.quality_grades(read_table(spark, d, "documents"), read_table(spark, d, "labels"))


@query("key_containment_join", "SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''")
def _(spark, d):
    return resolve.containing_documents(read_table(spark, d, "benchmark"), read_table(spark, d, "documents"))


_COMPACT = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query(
    "catalog_text_matches",
    f"""WITH c AS (SELECT item_id, trim(unnest([text, string_split(text, ':')[-1]])) AS needle FROM benchmark),
    n AS (SELECT item_id, lower(needle) AS low, {_COMPACT.format("needle")} AS compact FROM c WHERE needle <> ''),
    d AS (SELECT doc_id, lower(text) AS low, {_COMPACT.format("text")} AS compact FROM documents)
    SELECT DISTINCT item_id, doc_id FROM n JOIN d ON contains(d.low, n.low) OR length(n.compact) >= 4 AND contains(d.compact, n.compact)""",
)
def _(spark, d):
    return resolve.catalog_matches(read_table(spark, d, "benchmark"), read_table(spark, d, "documents"))


@query(
    "coverage_ratio",
    """SELECT n_name, count(c_custkey) AS total, count(*) FILTER (c_acctbal > 0) AS covered, round(count(*) FILTER (c_acctbal > 0) / nullif(count(c_custkey), 0), 4) AS ratio
    FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1""",
)
def _(spark, d):
    return reports.coverage(read_table(spark, d, "customer"), read_table(spark, d, "nation"))


@query(
    "fill_rate_per_column",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({f'trim({c})' if s else c} {"<> ''" if s else 'IS NOT NULL'}) AS filled, count(*) AS total FROM documents"
        for c, s in (("doc_id", 0), ("text", 1), ("lang", 1), ("source", 1), ("n_chars", 0))
    ),
)
def _(spark, d):
    return reports.fill_rates(read_table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


@query("duplicate_keys", "SELECT md5(text) AS key_value, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return reports.duplicate_keys(read_table(spark, d, "documents").select(F.md5("text").alias("text_key")), "text_key")


@query("issue_summary", "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 10 AS user_group, count(*) AS issues, max(value) AS worst FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def _(spark, d):
    return reports.issue_summary(read_table(spark, d, "events"))


@query(
    "review_queue",
    """SELECT doc_id, source, reason FROM (SELECT doc_id, source, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'quality' WHEN n_chars < 100 THEN 'short' END AS reason
    FROM documents JOIN labels USING (doc_id)) WHERE reason IS NOT NULL""",
)
def _(spark, d):
    return reports.review_queue(read_table(spark, d, "documents"), read_table(spark, d, "labels"))


@query("primary_per_type", "SELECT p_type, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS n FROM part) WHERE n = 1")
def _(spark, d):
    return reports.primary_per_type(read_table(spark, d, "part"))


_TYPES = ["view", "signup", "error", "click", "purchase"]


@query("spec_matrix", "SELECT user_id, " + ", ".join(f"max(value) FILTER (event_type = '{t}') AS {t}" for t in _TYPES) + " FROM events GROUP BY 1")
def _(spark, d):
    return reports.spec_matrix(read_table(spark, d, "events"), _TYPES)


@query(
    "unmapped_label_frequency",
    """SELECT label, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM (SELECT conv_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS label FROM conversations)
    WHERE label <> '' GROUP BY 1 HAVING count(*) >= 5""",
)
def _(spark, d):
    return reports.label_frequencies(read_table(spark, d, "conversations"), least=5)


@query(
    "label_frequency",
    """SELECT label, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM (SELECT conv_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS label FROM conversations)
    WHERE label <> '' GROUP BY 1""",
)
def _(spark, d):
    return reports.label_frequencies(read_table(spark, d, "conversations"))


@query(
    "ordered_distinct_first_wins",
    """WITH f AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)
    SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS ord, event_id FROM f WHERE n = 1""",
)
def _(spark, d):
    return reports.first_wins(read_table(spark, d, "events"))


@query(
    "catalog_neighbourhood_windows",
    """WITH l AS (SELECT doc_id, unnest(s) AS words, generate_subscripts(s, 1) - 1 AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
    g AS (SELECT doc_id, line, CASE WHEN line - lag(line) OVER (PARTITION BY doc_id ORDER BY line) <= 3 THEN 0 ELSE 1 END AS gap FROM l WHERE contains(words, 'License')),
    r AS (SELECT doc_id, line, sum(gap) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM g)
    SELECT doc_id, CAST(greatest(min(line) - 1, 0) AS INTEGER) AS first_line, CAST(max(line) + 1 AS INTEGER) AS last_line FROM r GROUP BY doc_id, run""",
)
def _(spark, d):
    return reports.neighbourhoods(read_table(spark, d, "documents"), "License")


@query("hourly_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    counts = hourly_counts(read_table(spark, d, "events"))
    return counts.withColumn("hour", F.col("hour").cast("timestamp_ntz"))
