"""Finding product pages: candidate scores, identity in urls, templates learned from urls, localised urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import encode_component, fill_template, has_placeholder, key_variants, path_has_key, text_names_key
from ..functions.text import compact_key, let
from ..functions.urls import STRONG_PARAMS, canonical_candidate_key, params_of, path_of, same_normalized_url

#: Points by where a candidate comes from, and by what its url shows.
STAGES = {"learned-endpoint": 74, "direct-template": 70, "localized-template": 70, "search-result": 58, "sitemap": 52}
OTHER_STAGE = 40
SIGNS = [(r"(?i)\b(product|products|sku|catalog|details?|partnumber|skupage)\b|/p/", 15), (r"(?i)[?&](?:q|query|search|term)=", -12), (r"(?i)\.(?:pdf|zip|dwg|dxf|stp|step|png|jpe?g|webp)(?:[?#]|$)", -45)]


def candidate_score(url: Column, key: Column, stage: Column, allowed: Column) -> Column:
    """0 to 100: the stage's points, the key in url and path, product words, an allowed host, less for searches and files."""
    score = F.coalesce(F.create_map(*[F.lit(x) for p in STAGES.items() for x in p])[stage], F.lit(OTHER_STAGE))
    score = score + F.when(text_names_key(url, key), 30).otherwise(0) + F.when(path_has_key(path_of(url), key), 35).otherwise(0) + F.when(allowed, 10).otherwise(0)
    for pattern, points in SIGNS:
        score = score + F.when(url.rlike(pattern), points).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def best_candidates(candidates: DataFrame, most: int = 8) -> DataFrame:
    """item, rank, url, score of an item's best candidates (item, url, score, ord), each url once; ties go to the earlier."""
    once = candidates.groupBy("item", canonical_candidate_key(F.col("url")).alias("candidate_key")).agg(F.min_by(F.struct("url", "score", "ord"), F.struct(-F.col("score"), "ord")).alias("c")).select("item", "c.*")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "ord")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("item", "rank", "url", "score")


def url_shows_identity(url: Column, key: Column) -> Column:
    """A segment of the path, or a parameter that names a product, is the key in compact form."""
    wanted = compact_key(key)
    named = F.exists(params_of(url), lambda p: F.lower(F.regexp_replace(p["key"], "(?i)[^a-z0-9]", "")).isin(*STRONG_PARAMS) & (compact_key(F.coalesce(F.try_url_decode(p["value"]), p["value"])) == wanted))
    return F.coalesce((wanted != "") & (path_has_key(path_of(url), key) | named), F.lit(False))


def learned_template(url: Column, key: Column) -> Column:
    """The url with the spelling of the key that it holds, the longest of at least 3 characters, replaced by its placeholder; null without one."""
    v = key_variants(key)
    forms = [(encode_component(key), "{part}"), (key, "{part}"), (v["after_colon"], "{partAfterColon}"), (v["compact"], "{partCompact}"), (v["snake"], "{partSnake}"), (v["dash"], "{partDash}")]
    listed = F.array(*[F.struct((-F.length(f)).alias("back"), F.lit(i).alias("i"), f.alias("form"), F.lit(p).alias("placeholder")) for i, (f, p) in enumerate(forms)])

    def replaced(x: Column) -> Column:
        at = F.call_function("locate", F.lower(x["form"]), F.lower(url))
        return F.when(x.isNotNull(), F.concat(F.substring(url, F.lit(1), at - 1), x["placeholder"], F.substring(url, at + F.length(x["form"]), F.length(url))))

    held = F.filter(listed, lambda x: (F.length(x["form"]) >= 3) & F.contains(F.lower(url), F.lower(x["form"])))
    return let(F.array_min(held), replaced)


def localized_urls(key: Column, templates: dict[str, str]) -> Column:
    """A map from en and de to the filled templates; de is left out where it is the same page as en."""
    known = {loc: F.when(has_placeholder(F.lit(t)), fill_template(t, key)) for loc, t in templates.items() if loc in ("en", "de")}

    def listed(urls: dict[str, Column]) -> Column:
        return F.map_from_entries(F.filter(F.array(*[F.when(u.isNotNull(), F.struct(F.lit(loc).alias("key"), u.alias("value"))) for loc, u in sorted(urls.items())]), lambda e: e.isNotNull()))

    if len(known) < 2:
        return listed(known)
    # both are filled once, however often the comparison reads them
    return let(F.struct(*[u.alias(loc) for loc, u in known.items()]), lambda u: listed({"en": u["en"], "de": F.when(~same_normalized_url(u["de"], u["en"]), u["de"])}))
