"""Attributes of items: first-wins and best-replaces removal of repeats, field candidates, their resolution, conflicts and health.

An attribute relation has item, ord, name, value and may have group, source_url, source_type, parser, stage, confidence.
``ord`` is the order that first-wins rules go by. Null fields count as empty texts, null confidences as none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quantities import is_plausible, parse_quantities
from ..functions.text import clean_text, let
from ..functions.urls import canonical_url_key

#: Fields, their labels, what an attribute's label must match, and the kinds of quantity that a numeric one needs.
FIELDS = [
    ("weight", "Weight", r"\b(weight|mass|gewicht|peso)\b", ["mass"]),
    ("dimensions", "Dimensions", r"\b(dimensions?|size|abmessungen?|dimenzije|height|width|depth|length|overall|h\s*x\s*w\s*x\s*d|hxwxd)\b", ["length"]),
    ("material", "Material", r"\b(materials?|werkstoff|materijal|mat[eé]riau|materiale|housing|enclosure|body)\b", None),
    ("wallThickness", "Wall thickness", r"\b(thickness|gauge)\b", ["length"]),
    ("finish", "Finish", r"\b(finish(?:ing)?|coating|paint)\b|\bpowder\s+coat|\bsurface\s+treatment\b", None),
    ("color", "Color", r"\b(colou?r|farbe|couleur|colore|RAL)\b", None),
    ("voltage", "Voltage", r"\b(voltage|volts?|VAC|VDC|spannung|napon|input power|power input)\b", ["voltage"]),
    ("current", "Current", r"\b(current|amps?|amperage|amperes?|strom|struja|switching capacity)\b", ["current"]),
    ("protection", "Protection rating", r"\bIP\s*\d*|\bNEMA\b|\bIK\s*\d*|\b(protection|schutzart|enclosure type|environmental rating)\b", None),
    ("certificates", "Certificates", r"\b(approval|conformity|compliance|certificates?|certifications?|standards?|marking|UL|CE|UKCA|RoHS|REACH|WEEE|declarations?|approved|listed)\b", None),
    ("operatingTemperature", "Operating temperature", r"\b((operating|operational|ambient|working|service|surrounding)\s+temperature|temperature range|umgebungstemperatur|betriebstemperatur)\b", ["temperature"]),
    ("typeCode", "Type code", r"\b(type\s*code|model\s*code|extended product type|type designation|MLFB)\b", None),
]
#: Rungs of the ladder of sources (parser or stage, source type, points, name), first hit counts.
CANDIDATE_LADDER = [
    (r"(?i)customer-document", r"(?i)customer", None, None, 1000, "customer document priority"), (None, None, "official", r"(?i)pdf|document|datasheet|manual", 900, "official parsed document priority"),
    (None, None, "official", None, 860, "official source priority"), (None, None, "official-fallback", r"(?i)browser-network|api|json", 790, "official network/API priority"),
    (None, None, "official-fallback", None, 730, "official fallback priority"), (None, None, "generated", None, 630, "generated normalizer priority"), (None, None, "cache", None, 520, "cache priority"),
    (None, None, "distributor", None, 300, "distributor fallback priority"),
]
#: Points of a source where conflicting values are weighed (parsed documents by their parser alone).
CONFLICT_LADDER = [
    (r"(?i)customer-document", r"(?i)customer", None, None, 1000, "customer-provided document priority"), (None, None, "official", r"(?i)pdf|document|datasheet|manual", 880, "official parsed document priority"),
    (None, None, "official", None, 850, "official product source priority"), (None, None, "official-fallback", None, 720, "official fallback source priority"),
    (None, None, "generated", r"(?i)pdf|document|datasheet|manual", 690, "parsed document priority"), (None, None, "generated", None, 620, "generated/normalized value priority"),
    (None, None, "cache", None, 520, "cached source priority"), (None, None, "distributor", None, 300, "distributor fallback priority"),
]
#: Rows, and bytes of a row's texts, up to which a relation of distinct texts or rules is broadcast.
FEW_ROWS, SHORT_TEXT = 20_000, 1_000
_OPTIONAL = {"group": "string", "source_url": "string", "source_type": "string", "parser": "string", "stage": "string", "confidence": "double"}


def _whole(attributes: DataFrame) -> DataFrame:
    return attributes.withColumns({c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in attributes.columns})


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def broadcast_if_few(rows: DataFrame, most: int = FEW_ROWS, longest: int = SHORT_TEXT) -> DataFrame:
    """The rows, marked for a broadcast where they are ``most`` at most and each of their texts has ``longest`` bytes at most; else as they are, for a join.

    Looking takes a job over the rows, of which no more than ``most`` + 1 come to the driver, long ones as null. Without it both sides of a
    join are dealt out by its key, and few keys are few tasks. The rows are gathered by an aggregate: a plain take runs one part, then four, and so
    on, which is slow where making the rows is dear and few are left.
    """
    if rows.isStreaming:
        return rows
    texts = [c for c, kind in rows.dtypes if kind == "string"]
    short = F.lit(True) if not texts else F.coalesce(sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in texts), F.lit(0)) <= longest, F.lit(True))
    seen = rows.select(F.struct(F.when(short, F.struct(*rows.columns)).alias("r")).alias("x")).limit(most + 1).agg(F.collect_list("x")).first()[0]
    if len(seen) > most or any(x.r is None for x in seen):
        return rows
    return F.broadcast(rows.sparkSession.createDataFrame([x.r for x in seen], rows.schema))


def with_read(rows: DataFrame, text: str, read: Callable[[Column], Column], name: str, ahead: bool = True) -> DataFrame:
    """The rows with what ``read`` makes of a text column, computed once for each distinct text and joined back; null texts have null.

    Worth it where reading costs more than a join and texts repeat, as values of attributes do. Few short texts are found by a job ``ahead`` and
    then broadcast, so that the rows stay where they are.
    """
    distinct = rows.filter(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct()
    known = broadcast_if_few(distinct) if ahead else distinct
    # exploding an array of one keeps the result from being computed anew for each of its fields
    made = known.select("_text", F.explode(F.array(read(F.col("_text")))).alias(name))
    return rows.join(made if known is distinct else F.broadcast(made), F.col(text) == F.col("_text"), "left").drop("_text")


def comparable(value: Column) -> Column:
    return F.lower(clean_text(value))


def first_of(rows: DataFrame, keys: list[Column], order: list[str | Column], within: list[str]) -> DataFrame:
    """The first row of each key within a group, by row numbers after one exchange by group.

    Each row travels once, with the columns that are used later, and is sorted once; groups by ``within`` that follow need no exchange.
    """
    first = F.row_number().over(Window.partitionBy(*within, *keys).orderBy(*order))
    return rows.repartition(*within).withColumn("_first", first).filter("_first = 1").drop("_first")


def dedupe_attributes(attributes: DataFrame, with_source_url: bool = False) -> DataFrame:
    """The first attribute of each group, name and value (and url), without regard to case; rows without name or value go."""
    rows = _whole(attributes).filter((_text("name") != "") & (_text("value") != ""))
    parts = [_text("group"), _text("name"), _text("value"), _text("source_url") if with_source_url else F.lit("")]
    return first_of(rows, [F.lower(F.concat_ws("|", *parts))], ["ord"], ["item"]).select(*attributes.columns)


def dedupe_sources(sources: DataFrame) -> DataFrame:
    """The first source of each parser and url, without regard to case; sources without url go."""
    return first_of(sources.filter(_text("url") != ""), [F.lower(F.concat_ws("|", _text("parser"), _text("url")))], ["ord"], ["item"])


def dedupe_evidence(evidence: DataFrame) -> DataFrame:
    """The first record of each kind, name, value, url, source url, parser and stage; records without name, value and url go."""
    rows = evidence.filter((_text("name") != "") | (_text("value") != "") | (_text("url") != ""))
    return first_of(rows, [F.lower(F.concat_ws("|", *map(_text, ("kind", "name", "value", "url", "source_url", "parser", "stage"))))], ["ord"], ["item"])


def document_quality(kind: Column, label: Column, url: Column, source_type: Column, confidence: Column, held: Column) -> Column:
    """Points of a document row: its type, what it is called, where it comes from, whether it is held, its confidence."""
    text, bare = F.lower(F.concat_ws(" ", kind, label, url)), F.trim(F.coalesce(label, F.lit("")))
    named = bare.rlike(r"(?i)\b(?:data\s*sheet|datasheet|technical|manual|instruction|installation|certificate|declaration|conformity|pdf|cad|drawing)\b")
    generic = (bare == "") | (~named & (bare.rlike(r"(?i)^(?:files?|downloads?|documents?|resources?|media|dam|api|view|open)$") | bare.rlike(r"(?i)^[A-Z0-9_-]{5,80}$")))
    score = F.lit(0)
    for name, points in (("datasheet", 130), ("manual", 80), ("certificate", 70), ("cad", 60), ("image", 50)):
        score = score + F.when(kind == name, points).otherwise(0)
    for test, points in (
        (text.rlike(r"\b(?:data\s*sheet|datasheet|technical\s+data|spec(?:ification)?\s*sheet|pdf)\b"), 20), (text.rlike(r"\b(?:manual|instruction|installation)\b"), 15),
        (F.coalesce(label, F.lit("")).rlike(r"\s") & (F.length(label) > 18), 12), (bare.rlike(r"(?i)^[A-Z0-9_-]+\.(?:pdf|zip|dwg|dxf|stp|step)$"), -25), (generic, -60),
        (source_type == "official", 10), (source_type == "official-fallback", 6), (held, 10),
    ):
        score = score + F.when(test, points).otherwise(0)
    return (score + F.coalesce(F.floor(confidence * 10 + 0.5), F.lit(0))).cast("int")


def dedupe_documents(documents: DataFrame) -> DataFrame:
    """One document for each item and canonical url: the best, at the place (``ord``) where the url was first seen; ties keep the earlier.

    ``documents``: item, ord, type, label, url, source_type, confidence, held. Rows without url go.
    """
    quality = document_quality(*(F.col(c) for c in ("type", "label", "url", "source_type", "confidence", "held")))
    rows = documents.filter(_text("url") != "").select("*", canonical_url_key(F.col("url")).alias("url_key"), quality.alias("quality"))
    best = F.min_by(F.struct(*rows.columns), F.struct(-F.col("quality"), "ord")).alias("row")
    grouped = rows.groupBy("item", "url_key").agg(F.min("ord").alias("first_seen"), F.count(F.lit(1)).alias("copies"), best)
    return grouped.select("item", "url_key", "first_seen", "copies", "row.ord", "row.type", "row.label", "row.url", "row.quality")


def _ladder(rungs: list[tuple], with_stage: bool) -> tuple[Column, Column]:
    parser, stage = _text("parser"), _text("stage")
    said = F.concat(parser, F.lit(" "), stage) if with_stage else parser
    points, name = F.when(F.lit(False), 0), F.when(F.lit(False), "")
    for by_parser, by_stage, kind, words, n, reason in rungs:
        test = (parser.rlike(by_parser) | stage.rlike(by_stage)) if by_parser else F.coalesce(F.col("source_type") == kind, F.lit(False))
        test = test & said.rlike(words) if words else test
        points, name = points.when(test, n), name.when(test, reason)
    bonus = F.coalesce(F.floor(F.col("confidence") * 20 + 0.5), F.lit(0))
    return (points.otherwise(100) + bonus).cast("int"), name.otherwise("lowest-priority source")


def _field_matches(label: Column) -> Column:
    listed = [F.when(label.rlike(f"(?i){pattern}"), F.struct(F.lit(key).alias("field"), F.lit(name).alias("label"), F.array(*map(F.lit, kinds or [])).cast("array<string>").alias("kinds"))) for key, name, pattern, kinds in FIELDS]
    return F.filter(F.array(*listed), lambda x: x.isNotNull())


def field_candidates(attributes: DataFrame) -> DataFrame:
    """Attributes as candidates for the fields that their labels name, with the points of their source; repeats go.

    A numeric field takes only values with a plausible quantity of its kind, and loose page evidence is no candidate.
    item, field, label, value, source_url, source_type, parser, stage, confidence, priority, reason, ord.
    """
    rows = _whole(attributes).filter(F.lower(F.trim(_text("group"))) != "page evidence").withColumn("_label", F.concat(_text("group"), F.lit(" "), _text("name")))
    rows = with_read(rows, "_label", lambda label: let(clean_text(label), _field_matches), "hits").filter(F.size("hits") > 0)

    def of(value: Column) -> Column:
        kinds = F.transform(F.filter(parse_quantities(value), is_plausible), lambda q: q["kind"])
        return F.struct(clean_text(value).alias("clean"), F.array_distinct(kinds).alias("kinds"))

    rows = with_read(rows, "value", of, "read").withColumn("hit", F.explode("hits")).filter("read.clean <> ''")
    priority, reason = _ladder(CANDIDATE_LADDER, True)
    made = rows.filter((F.size("hit.kinds") == 0) | F.arrays_overlap("hit.kinds", "read.kinds")).select(
        "item", F.col("hit.field").alias("field"), F.col("hit.label").alias("label"), F.col("read.clean").alias("value"), "source_url", "source_type", "parser", "stage", "confidence",
        priority.alias("priority"), reason.alias("reason"), "ord",
    )
    # values are clean already, so case alone is left to compare
    key = F.lower(F.concat_ws("|", F.col("value"), _text("source_url"), _text("parser")))
    # an item's fields stay together, for what is asked of the whole item; of repeats at one place the best source stays, whatever the order of the rows
    best = [F.desc("priority"), F.desc_nulls_last("confidence"), "value", "source_url", "parser", "source_type", "stage"]
    return first_of(made, [F.col("field"), key], ["ord", *best], ["item"])


def field_resolutions(candidates: DataFrame) -> DataFrame:
    """For each item and field the candidate with most points, then confidence, then earliest; and how many values differ from it."""
    order = F.struct(-F.col("priority"), -F.coalesce(F.col("confidence"), F.lit(0.0)), "ord")
    best = F.min_by(F.struct("label", "value", "source_url", "parser", "confidence", "reason"), order).alias("best")
    grouped = candidates.groupBy("item", "field").agg(best, F.count(F.lit(1)).alias("candidates"), (F.count_distinct(comparable(F.col("value"))) - 1).alias("conflicts"))
    said = F.concat(
        F.lit("Selected "), "best.reason", F.when(F.col("conflicts") > 0, F.concat(F.lit("; retained "), F.col("conflicts").cast("string"), F.lit(" conflicting value(s) for review."))).otherwise("."),
    )
    return grouped.select("item", "field", "best.label", F.col("best.value").alias("selected"), "best.source_url", "best.parser", "best.confidence", "candidates", "conflicts", said.alias("reason"))


def field_conflicts(candidates: DataFrame) -> DataFrame:
    """The values of every field that has several: display value, confidence, points, whether selected, and rank (selected, points, earliest)."""
    priority, reason = _ladder(CONFLICT_LADDER, False)
    fallback = F.when(F.col("source_type") == "official", 0.85).when(F.col("source_type") == "distributor", 0.5).otherwise(0.7)
    rows = candidates.withColumns({"points": priority, "why": reason, "key": comparable(F.col("value")), "sure": F.coalesce(F.col("confidence"), fallback)})
    values = rows.groupBy("item", "field", "key").agg(
        F.min(F.struct("ord", "value"))["value"].alias("value"), F.max("sure").alias("confidence"), F.max("points").alias("priority"), F.min(F.struct(-F.col("points"), "ord", "why"))["why"].alias("reason"),
        F.sort_array(F.collect_set("parser")).alias("parsers"), F.min("ord").alias("first_seen"), F.min(F.struct(-F.col("points"), "ord", "key")).alias("best"),
    )
    # of values with equal points at one place only the smallest is selected
    each, order = Window.partitionBy("item", "field"), Window.partitionBy("item", "field").orderBy(F.desc("selected"), F.desc("priority"), "first_seen", "key")
    marked = values.withColumn("n", F.count(F.lit(1)).over(each)).withColumn("selected", F.col("best") == F.min("best").over(each)).filter("n > 1")
    return marked.withColumn("rank", F.row_number().over(order)).select("item", "field", "rank", "value", "confidence", "priority", "reason", F.array_join("parsers", ",").alias("parsers"), "selected")


def field_health(items: DataFrame, candidates: DataFrame, least: float = 0.6) -> DataFrame:
    """found, low-confidence, conflicting or missing for every item and field; ``items`` has item.

    A field without candidates is missing. One whose values differ is conflicting, one whose surest source is below ``least`` is low-confidence.
    """
    fields = F.explode(F.array(*[F.lit(f[0]) for f in FIELDS])).alias("field")
    grouped = candidates.groupBy("item", "field").agg(
        F.count_distinct(comparable(F.col("value"))).alias("n_values"), F.max("confidence").alias("confidence"), F.min_by("value", F.struct(-F.col("priority"), "ord")).alias("value")
    )
    status = F.when(F.col("n_values").isNull(), "missing").when(F.col("n_values") > 1, "conflicting").when(F.coalesce(F.col("confidence"), F.lit(0.0)) < least, "low-confidence").otherwise("found")
    return items.select("item").distinct().select("item", fields).join(grouped, ["item", "field"], "left").select("item", "field", status.alias("status"), "value", "confidence")


def field_health_summary(health: DataFrame) -> DataFrame:
    """Numbers of each status for an item."""
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(n) for s, n in (("found", "found"), ("missing", "missing"), ("low-confidence", "low_confidence"), ("conflicting", "conflicting"))]
    return health.groupBy("item").agg(*counts)


def fill_missing(normalized: DataFrame, resolutions: DataFrame, fields: list[str]) -> DataFrame:
    """Wide fields of each item, where empty filled from the resolutions; values that are there stay."""
    wide = resolutions.filter(F.col("field").isin(*fields)).groupBy("item").pivot("field", fields).agg(F.first("selected"))
    renamed = wide.select(F.col("item"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = normalized.join(renamed, "item", "left")
    return joined.select("item", *[F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_{f}")).alias(f) for f in fields])


#: The category of an attribute by what its group and name contain, first hit counts.
CATEGORIES = [
    ("Classification", r"eclass|etim|unspsc|classification"), ("Compliance", r"approval|conform|cert|standard|rohs|reach|weee|ul\b|csa\b|ce\b|ukca|compliance"),
    ("Electrical", r"voltage|current|power|frequency|interface|output|input|switching|io-link|port|supply"),
    ("Mechanical", r"dimension|height|width|depth|length|weight|material|housing|mount|connection|cable|thread|temperature|ip rating|protection"),
    ("Commercial", r"status|availability|replacement|alternative|price|tariff|country of origin|commercial|lifecycle|ean|gtin|upc"),
    ("Identity", r"sku|mpn|catalog|part number|product id|alternate|product label|product variant|type|series|range|family|description"),
]


def category(group: Column, name: Column) -> Column:
    label, out = F.lower(F.concat_ws(" ", F.coalesce(group, F.lit("")), name)), F.when(F.lit(False), "")
    for kind, pattern in CATEGORIES:
        out = out.when(label.rlike(pattern), kind)
    return out.otherwise("Other")
