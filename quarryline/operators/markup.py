"""What a page says besides its prose: label and value shapes, JSON-LD, data attributes, images, links of sitemaps.

Pages are read by patterns, without a parser: what is found is what stands in the markup as written; ``page_tree`` has pages as trees. Each
function makes one row per finding with its place in the page, and none for a null or empty page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, split_name_value
from .page_tree import BLOCKS
from .script_json import json_nodes

_TAG = r"""(?s)<!--.*?-->|</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_ATTRIBUTES = r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)"""
#: Labels that name boilerplate, and values that say nothing.
IGNORED_NAMES = r"(?i)^(?:class|style|id|href|src|alt|title|role|target|rel|onclick)$"
IGNORED_VALUES = r"(?i)^(?:true|false|null|undefined|\[\]|\{\})$"
#: Words of labels, shapes of values, and words of keys that make a pair worth keeping.
USEFUL_LABEL = (
    r"(?i)(?:weight|mass|dimension|height|width|depth|length|material|voltage|current|protection|ip\s*rating|nema|certificate|approval|standard|color|colour|finish|temperature|type\s*code|model|gtin|ean"
    r"|tariff|country|origin|mounting|connection|frequency|phase|poles|datasheet|manual|image|cad)"
)
USEFUL_VALUE = r"(?i)(?:\d+(?:[.,]\d+)?\s*(?:kg|g|lb|lbs|mm|cm|m|in|inch|v|vac|vdc|a|ma|ka|hz|w|kw|degc|c|°c)|\b(?:IP|IK)\s*\d{2}|\bNEMA\b|\b(?:UL|CE|CSA|RoHS|REACH|WEEE|UKCA|IEC|EN)\b)"
PRODUCT_KEYS = r"(?i)(?:product|sku|catalog|article|part|mpn|mlfb|technical|spec|attribute|characteristic|classification|document|download|resource|asset|image|media|datasheet|manual)"
#: What shows that a page has no product: an error or a challenge, or a list of search results.
BLOCKED = r"(?i)access denied|just a moment|attention required|page not found|\b404\b|forbidden|captcha"
SEARCH_PAGE = r"(?i)\b(search results?|suche|suchergebnisse|results for)\b"


def tag_text(html: Column) -> Column:
    """Markup without tags, cleaned."""
    return clean_text(F.regexp_replace(html, _TAG, " "))


def attribute_of(head: Column, name: str) -> Column:
    """The value of an attribute in a tag's head, in either quoting or none; empty where it is missing."""
    found = F.regexp_extract(head, rf"""(?is)(?:^|\s){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.when(found.rlike("^[\"']"), F.substr(found, F.lit(2), F.length(found) - 2)).otherwise(found)


def elements(html: Column, tag: str, closed: bool = True) -> Column:
    """Structs (head, body) of a tag's elements in order; without nesting, an element ends at its first closing tag."""
    pattern = rf"(?is)<{tag}(?=[\s/>]){_ATTRIBUTES}>" + (rf"(.*?)(?:</{tag}\s*>|\z)" if closed else "()")
    return F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("head"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("body"))


def is_useful(name: Column, value: Column) -> Column:
    """A pair with a telling label or value, neither boilerplate nor too long."""
    sound = (name != "") & (value != "") & (F.length(value) <= 800) & (F.length(name) <= 160) & ~name.rlike(IGNORED_NAMES) & ~value.rlike(IGNORED_VALUES)
    return sound & (name.rlike(USEFUL_LABEL) | value.rlike(USEFUL_VALUE) | name.rlike(PRODUCT_KEYS))


def _pairs(pages: DataFrame, source: str, found: Column) -> DataFrame:
    """Rows page_id, source, ord, name, value from an array of structs (name, value); useless pairs go."""
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "pair"))
    return rows.select("page_id", F.lit(source).alias("source"), "ord", clean_text(F.col("pair.name")).alias("name"), clean_text(F.col("pair.value")).alias("value")).filter(is_useful(F.col("name"), F.col("value")))


def table_rows(pages: DataFrame) -> DataFrame:
    """Table rows of two cells or more: the first is the label, the others, joined by bars, the value."""
    def cells(row: Column) -> Column:
        pattern = rf"(?is)<t[hd](?=[\s/>]){_ATTRIBUTES}>(.*?)(?=<t[hd][\s/>]|</t[hdr]\s*>|\z)"
        return F.filter(F.transform(F.regexp_extract_all(row["body"], F.lit(pattern), F.lit(2)), tag_text), lambda c: c != "")

    made = F.filter(F.transform(elements(F.col("html"), "tr"), cells), lambda c: F.size(c) >= 2)
    return _pairs(pages, "table", F.transform(made, lambda c: F.struct(c[0].alias("name"), F.array_join(F.slice(c, 2, F.size(c)), " | ").alias("value"))))


def definition_lists(pages: DataFrame) -> DataFrame:
    """Terms with the definition that follows them at once."""
    pattern = rf"(?is)<dt(?=[\s/>]){_ATTRIBUTES}>(.*?)</dt\s*>\s*<dd(?=[\s/>]){_ATTRIBUTES}>(.*?)(?:</dd\s*>|(?=<d[td][\s/>])|\z)"
    names, values = (F.regexp_extract_all("html", F.lit(pattern), F.lit(k)) for k in (2, 4))
    return _pairs(pages, "definition", F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x: F.struct(tag_text(x["n"]).alias("name"), tag_text(x["v"]).alias("value"))))


def text_pairs(pages: DataFrame) -> DataFrame:
    """``label: value`` lines of paragraphs, list items and blocks of 5 to 300 characters, each up to the first block within it, so a nested block counts once."""
    blocks = "|".join(sorted(BLOCKS))
    opened = rf"(?is)<(?:li|p|div)(?=[\s/>]){_ATTRIBUTES}>((?:[^<]++|<(?!/?(?:{blocks})[\s/>]))*+)"
    texts = F.transform(F.regexp_extract_all("html", F.lit(opened), F.lit(2)), tag_text)
    found = F.transform(F.filter(texts, lambda t: F.length(t).between(5, 300)), split_name_value)
    return _pairs(pages, "text", F.filter(found, lambda x: x.isNotNull()))


def data_attributes(pages: DataFrame) -> DataFrame:
    """data- and aria- attributes of all tags with their values, in order."""
    heads = F.concat_ws(" ", F.transform(elements(F.col("html"), "[a-z][a-z0-9-]*", closed=False), lambda e: e["head"]))
    pattern = r"""(?is)(?:^|\s)((?:data|aria)[-_][a-z0-9_-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    names, values = (F.regexp_extract_all(heads, F.lit(pattern), F.lit(k)) for k in (1, 2))
    bare = F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x: F.struct(F.lower(x["n"]).alias("name"), F.when(x["v"].rlike("^[\"']"), F.substr(x["v"], F.lit(2), F.length(x["v"]) - 2)).otherwise(x["v"]).alias("value")))
    return _pairs(pages, "data", bare)


def hidden_pairs(pages: DataFrame) -> DataFrame:
    """``label: value`` in templates, noscript blocks and elements marked hidden."""
    hidden = F.filter(elements(F.col("html"), "(?:div|span|section|p)"), lambda e: e["head"].rlike(r"(?i)(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*.?true|display:\s*none|visibility:\s*hidden"))
    blocks = F.concat(elements(F.col("html"), "template"), elements(F.col("html"), "noscript"), hidden)
    found = F.transform(F.transform(blocks, lambda e: tag_text(e["body"])), split_name_value)
    return _pairs(pages, "hidden", F.filter(found, lambda x: x.isNotNull()))


def mined_pairs(pages: DataFrame) -> DataFrame:
    """All label and value shapes of a page as one relation: page_id, source, ord, name, value."""
    out = table_rows(pages)
    for more in (definition_lists, text_pairs, data_attributes, hidden_pairs):
        out = out.unionByName(more(pages))
    return out


def json_blocks(pages: DataFrame, kind: str = r"application/ld\+json") -> DataFrame:
    """page_id, ord, json: scripts of a type, as written."""
    scripts = F.filter(elements(F.col("html"), "script"), lambda e: attribute_of(e["head"], "type").rlike(f"(?i){kind}"))
    return pages.select("page_id", F.posexplode(F.transform(scripts, lambda e: e["body"])).alias("ord", "json"))


def json_entries(blocks: DataFrame) -> DataFrame:
    """page_id, ord, entry: the objects of JSON-LD blocks (one, a list, or a graph), each as JSON text; what isn't JSON has none."""
    listed = F.coalesce(F.from_json(F.get_json_object("json", "$.@graph"), "array<string>"), F.when(F.col("json").rlike(r"^\s*\["), F.from_json("json", "array<string>")), F.array("json"))
    rows = blocks.select("page_id", F.posexplode(listed).alias("ord", "entry"))
    return rows.filter(F.get_json_object("entry", "$.@type").isNotNull())


def json_products(pages: DataFrame) -> DataFrame:
    """Products of JSON-LD: page_id, ord, sku, name, brand (its name where it is an object)."""
    entries = json_entries(json_blocks(pages)).filter(F.get_json_object("entry", "$.@type").rlike(r'^(Product|\[.*"Product".*\])$'))
    brand = F.coalesce(F.get_json_object("entry", "$.brand.name"), F.get_json_object("entry", "$.brand"))
    return entries.select("page_id", "ord", F.get_json_object("entry", "$.sku").alias("sku"), clean_text(F.get_json_object("entry", "$.name")).alias("name"), clean_text(brand).alias("brand"))


def breadcrumb_leaves(pages: DataFrame) -> DataFrame:
    """page_id, url, name of each breadcrumb list's deepest item: the greatest position, of equal ones the last."""
    entries = json_entries(json_blocks(pages)).filter("get_json_object(entry, '$.@type') = 'BreadcrumbList'")
    rows = entries.select("page_id", "ord", F.posexplode(F.from_json(F.get_json_object("entry", "$.itemListElement"), "array<string>")).alias("at", "x"))
    place = F.coalesce(F.get_json_object("x", "$.position").try_cast("int"), F.col("at"))
    url = F.coalesce(F.get_json_object("x", "$.item.@id"), F.get_json_object("x", "$.item.url"), F.get_json_object("x", "$.item"), F.get_json_object("x", "$.url"))
    name = F.coalesce(F.get_json_object("x", "$.item.name"), F.get_json_object("x", "$.name"))
    return rows.groupBy("page_id", "ord").agg(F.max_by(F.struct(url.alias("url"), name.alias("name")), F.struct(place, "at")).alias("leaf")).select("page_id", "leaf.url", "leaf.name")


def flatten_json(blocks: DataFrame) -> DataFrame:
    """page_id, path, value of every scalar in JSON blocks (page_id, ord, json), at any depth: objects by their keys, lists by their places; nulls go."""
    return json_nodes(blocks).filter("text is not null").select("page_id", F.col("place").alias("path"), F.col("text").alias("value"))


def srcset_urls(srcset: Column) -> Column:
    return F.filter(F.transform(F.split(srcset, ","), lambda p: F.regexp_extract(F.trim(p), r"^(\S*)", 1)), lambda u: u != "")


def page_images(pages: DataFrame) -> DataFrame:
    """page_id, ord, url: images of img and source tags, first src and its lazy spellings, then the srcset; each url once per page, first place."""
    def of(e: Column) -> Column:
        names = ("src", "data-src", "data-original", "data-lazy-src", "data-zoom-image", "poster")
        return F.concat(F.array(*[attribute_of(e["head"], n) for n in names]), srcset_urls(attribute_of(e["head"], "srcset")), srcset_urls(attribute_of(e["head"], "data-srcset")))

    urls = F.flatten(F.transform(elements(F.col("html"), "(?:img|source)", closed=False), of))
    likely = F.filter(urls, lambda u: u.rlike(r"(?i)\.(?:png|jpe?g|webp|gif|avif|svg)(?:[?#]|$)|(?:image|media|asset|product-photo|productimage)"))
    return pages.select("page_id", F.posexplode(F.array_distinct(likely)).alias("ord", "url"))


def sitemap_locs(sitemaps: DataFrame) -> DataFrame:
    """page_id, ord, url of the locations in sitemap texts; only http urls."""
    found = F.transform(F.regexp_extract_all("html", F.lit(r"(?i)<loc>\s*([^<]+)\s*</loc>"), F.lit(1)), lambda u: clean_text(u))
    return sitemaps.select("page_id", F.posexplode(F.filter(found, lambda u: u.rlike("(?i)^https?://"))).alias("ord", "url"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """page_id, url named by the sitemap lines of robots texts."""
    return robots.select("page_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?im)^sitemap:[ \t]*(\S.*)$"), F.lit(1)), lambda u: F.trim(u)))).alias("url"))


def page_state(pages: DataFrame) -> DataFrame:
    """page_id, state: blocked (an error or challenge page by its title or first heading), search (a list of results) or page."""
    title = tag_text(F.concat_ws(" ", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)))
    return pages.select("page_id", F.when(title.rlike(BLOCKED), "blocked").when(title.rlike(SEARCH_PAGE), "search").otherwise("page").alias("state"))
