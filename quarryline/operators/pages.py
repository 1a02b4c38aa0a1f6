"""Pages: titles, links, their scores, and duplicates by canonical url."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import path_has_key, text_names_key
from ..functions.text import clean_text
from ..functions.urls import canonical_url_key, host_of, origin_of, path_of, unique_link_key


def page_titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", clean_text(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title"))


def page_hosts(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", host_of(F.col("url")).alias("host"), canonical_url_key(F.col("url")).alias("url_key"))


#: An attribute with its value in either quoting or none.
_ATTRIBUTE = r"""[^\s>=/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?+"""
#: An anchor: its attributes (group 1) and what it holds (group 2) up to its end, the next anchor or the end of the page.
_ANCHOR = rf"""(?is)<a(?=[\s/])((?:{_ATTRIBUTE}|[\s/]++|=)*+)>(.*?)(?:</a\s*>|(?=<a[\s/>])|\z)"""
_TAG = r"""(?s)<!--.*?-->|</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""


def _anchors(html: Column) -> Column:
    """Structs (href, label) of a page's anchors with an href, in order; the label is the text inside without tags."""
    heads, bodies = (F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(k)) for k in (1, 2))

    def read(x: Column) -> Column:
        attribute = F.get(F.filter(F.regexp_extract_all(x["head"], F.lit(f"({_ATTRIBUTE})"), F.lit(1)), lambda t: t.rlike(r"(?i)^href\s*=")), F.lit(0))
        value = F.regexp_replace(attribute, r"(?is)^href\s*=\s*", "")
        href = F.when(value.rlike("^[\"']"), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.struct(href.alias("href"), clean_text(F.regexp_replace(x["body"], _TAG, "")).alias("label"))

    return F.filter(F.transform(F.arrays_zip(heads.alias("head"), bodies.alias("body")), read), lambda x: x["href"].isNotNull())


def page_links(pages: DataFrame) -> DataFrame:
    """One row per anchor with an href in page order: page_id, ord, href, label (the text in it without tags)."""
    return pages.select("page_id", F.posexplode(_anchors(F.col("html"))).alias("ord", "a")).select("page_id", "ord", "a.href", "a.label")


#: What a link's url or label shows, with its points, and the least score of a candidate.
IN_URL = [
    (r"\b(product|products|sku|catalog|detail|details|pdp|partnumber_info|skupage)\b|/p/|/item/", 25), (r"[?&](?:q|query|search|s|term)=", -15),
    (r"\b(cart|login|account|support|contact|news|blog|privacy|terms|download|pdf|image|thumbnail)\b", -35), (r"\.(?:pdf|zip|dwg|dxf|stp|step|png|jpe?g|webp)(?:[?#]|$)", -50),
]
IN_LABEL = r"(?i)\b(view|details?|product|catalog|part number|sku)\b"
LEAST_SCORE = 35


def resolved_url(href: Column, base: Column) -> Column:
    """``href`` as seen from ``base``, without fragment; null for scripts, mail and telephone links. Dot segments stay as they are."""
    bare = F.regexp_replace(F.replace(F.trim(href), F.lit("&amp;"), F.lit("&")), "#.*$", "")
    folder = F.concat(origin_of(base), F.regexp_replace(path_of(base), "[^/]*$", ""))
    made = F.when(bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.concat(origin_of(bare), path_of(bare), F.regexp_extract(bare, r"(\?.*)$", 1)))
    made = made.when(bare.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), bare)).when(bare.startswith("/"), F.concat(origin_of(base), bare)).otherwise(F.concat(folder, bare))
    return F.when((F.trim(href) != "") & ~bare.rlike("(?i)^(?:javascript|mailto|tel|data):"), made)


def score_link(url: Column, label: Column, key: Column, base_score: int = 0) -> tuple[Column, Column]:
    """Points of a link for a catalogue key, and whether link or label names the key."""
    low, named, segment = F.lower(url), text_names_key(F.concat_ws(" ", url, label), key), path_has_key(path_of(url), key)
    score = F.lit(base_score) + F.when(named, 55).otherwise(0) + F.when(text_names_key(url, key), 25).otherwise(0) + F.when(segment, 50).otherwise(0)
    for pattern, points in IN_URL:
        score = score + F.when(low.rlike(pattern), points).otherwise(0)
    return (score + F.when(label.rlike(IN_LABEL), 10).otherwise(0)).cast("int"), named | segment


def link_scores(pages: DataFrame) -> DataFrame:
    """Each link of a page with its points for the page's key, the label of its first link: page_id, ord, url, label, score, verdict.

    Links that neither name the key nor have it as a segment, and those below 35 points, are told apart from candidates.
    A null url leaves relative links as they are; rows that repeat a page_id are scored on their own.
    """
    links = pages.select("page_id", F.coalesce("url", F.lit("")).alias("base"), _anchors(F.col("html")).alias("links")).withColumn("key", F.get("links", F.lit(0))["label"])
    rows = links.select("page_id", "base", "key", F.posexplode("links").alias("ord", "a")).select("page_id", "ord", "key", resolved_url(F.col("a.href"), F.col("base")).alias("url"), F.col("a.label").alias("label"))
    score, confirmed = score_link(F.col("url"), F.col("label"), F.col("key"))
    verdict = F.when(~confirmed, "no exact catalog identity").when(score < LEAST_SCORE, "low score").otherwise("candidate")
    return rows.filter("url is not null").select("page_id", "ord", "url", "label", score.alias("score"), verdict.alias("verdict"))


def top_links(pages: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` best candidates of each page, each link key once; ties go to the shorter url, then the earlier link."""
    found = link_scores(pages).filter("verdict = 'candidate'")
    once = found.groupBy("page_id", unique_link_key(F.col("url")).alias("link_key")).agg(F.min_by(F.struct("ord", "url", "label", "score"), F.struct(-F.col("score"), "ord")).alias("best")).select("page_id", "best.*")
    best = Window.partitionBy("page_id").orderBy(F.desc("score"), F.length("url"), "ord")
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("page_id", "rank", "url", "label", "score")


def distinct_urls(pages: DataFrame) -> DataFrame:
    """One page for each canonical url: the one with the longest text wins, at the place where the url was first seen."""
    keyed = pages.select("page_id", canonical_url_key(F.col("url")).alias("url_key"), F.length("html").alias("size"))
    best = F.max(F.struct("size", (-F.col("page_id")).alias("back")))
    rows = keyed.groupBy("url_key").agg(F.min("page_id").alias("first_seen"), best.alias("best"), F.count(F.lit(1)).alias("copies"))
    return rows.select("url_key", "first_seen", (-F.col("best.back")).alias("page_id"), "copies")


def source_lookup(pages: DataFrame) -> DataFrame:
    """For each page an earlier one that it may derive from: the first with the same url, else the first with its origin and path, else none.

    Both tables of firsts are grouped before they are joined, so of a frequent url one row travels for each task.
    """
    keyed = pages.select("page_id", "url", origin_of(F.col("url")).alias("origin"), path_of(F.col("url")).alias("path"))
    by_url = keyed.groupBy("url").agg(F.min("page_id").alias("by_url"))
    by_path = keyed.groupBy("origin", "path").agg(F.min("page_id").alias("by_path"))
    joined = keyed.join(by_url, "url", "left").join(by_path, ["origin", "path"], "left")
    first, second = F.col("by_url") < F.col("page_id"), F.col("by_path") < F.col("page_id")
    return joined.select("page_id", F.when(first, F.col("by_url")).when(second, F.col("by_path")).alias("source_page"), F.when(first, "url").when(second, "origin_and_path").alias("tier"))
