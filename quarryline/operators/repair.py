"""Filling an item's missing fields from evidence that it already has, then from its base items, until nothing changes; whether a retry is worth it.

Evidence is an attribute relation (item, ord, name, value and the optional columns of :mod:`attributes`). Fields are those of ``attributes.FIELDS``.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantities import is_plausible_celsius, temperature_range
from ..functions.text import clean_text, compact_key, let
from ..functions.urls import host_of, origin_of
from .attributes import FIELDS, _text, _whole, broadcast_if_few
from .normalize import ELECTRICAL, WEIGHTS, colour_text, material_text, short_number

#: Points of evidence by its source, for documents, and for words of its label.
SOURCES, OTHER_SOURCE, DOCUMENT_POINTS = {"official": 100, "official-fallback": 85, "generated": 75}, 45, 25
LABEL_POINTS = [
    ("weight", r"\b(?:net weight|unit weight|product weight|mass)\b", 35), ("weight", r"\b(?:package|packing|packaging|shipping|gross)\b", -15),
    ("dimensions", r"\b(?:package|packing|packaging)\b", -60), ("material", r"\b(?:housing|enclosure|body|base material)\b", 30),
]
#: Confidence of evidence that has none, the most that a repair has, that of an image; fields that are read from any attribute; type codes' greatest length.
UNKNOWN, MOST_CONFIDENCE, IMAGE_CONFIDENCE, ANYWHERE, LONGEST_CODE = 0.72, 0.78, 0.62, ("material", "certificates"), 120
#: Words of urls that are no product images, and of those that may be one on the maker's own host.
NO_IMAGE, SOME_IMAGE = "logo|icon|sprite|placeholder|loading", "product|image|gallery|zoom|media|assets|cdn"
#: Marks that count as certificates wherever they stand, with their spelling where case doesn't matter; materials that count in any text.
CERTIFICATES = [
    ("cULus", None), ("cUL", None), ("UL", None), ("CSA", None), ("CE", None), ("UKCA", None), ("RoHS", "RoHS"), ("REACH", "REACH"), ("WEEE", "WEEE"), (r"IEC\s+\d+(?:[.-]\d+)*", None), (r"(?i:NEMA\s+(?:Type\s*)?\d[0-9A-Z, ]*)", None),
]
PLAIN_MATERIALS = (
    "stainless steel, carbon steel, mild steel, galvannealed steel, galvanized steel, steel, aluminum, aluminium, polycarbonate, polyester, fiberglass, fibreglass, plastic, pvc, pur, brass, copper, zinc, cast iron, polyamide, polypropylene, polyethylene, rubber, epdm, nylon"
).split(", ")
_N = r"\d+(?:[.,]\d+)?"
_RANGE = rf"{_N}(?:\s*(?:\.{{2,3}}|-|to)\s*{_N})?"
_PATTERNS = {key: pattern for key, _, pattern, _ in FIELDS}
_IMAGE = r"(?i)((?:https?://|/)[^\s\"'<>]+\.(?:png|jpe?g|webp)(?:\?[^\s\"'<>]*)?)"
_IMAGE_END = r"(?i)\.(?:png|jpe?g|webp)"


def _spelled(spellings: list[str]) -> str:
    return "|".join(sorted(spellings, key=len, reverse=True))


def _first(pattern: str) -> Callable[[Column, Column], Column]:
    return lambda value, label: F.nullif(F.regexp_extract(value, f"(?i)({pattern})", 1), F.lit(""))


def _dimensions(value: Column, label: Column) -> Column:
    """Height and width by their letters, else a product of two or three lengths; nothing of a package, and no area."""
    product = rf"(?i)\b({_N}\s*[x*]\s*{_N}(?:\s*[x*]\s*{_N})?\s*(?:mm|cm|inches|inch|in|m|\"))"
    lettered = rf"(?i)\b((?:H|Height)\s*[:=]?\s*{_N}.{{0,80}}?\b(?:W|Width)\s*[:=]?\s*{_N})"
    found = F.coalesce(*[F.nullif(F.regexp_extract(value, p, 1), F.lit("")) for p in (lettered, product + r"(?!\w)")])
    return F.when(~label.rlike("(?i)package|packing|packaging") & ~value.rlike(product + r"\s*[²2]"), found)


def _certificates(value: Column, label: Column) -> Column:
    """The marks that a text names, each once, in the order of CERTIFICATES."""
    def of(mark: str, name: str | None) -> Column:
        found = F.regexp_extract_all(value, F.lit(rf"\b({'(?i:' + mark + ')' if name else mark})(?!\w)"), F.lit(1))
        return F.transform(found, lambda t: F.lit(name) if name else F.trim(t))

    return F.nullif(F.array_join(F.array_distinct(F.concat(*[of(*c) for c in CERTIFICATES])), "; "), F.lit(""))


def _material(value: Column, label: Column) -> Column:
    """The material that a labelled value names in any language, else one of the plain names as it is written."""
    plain = F.regexp_replace(F.nullif(F.regexp_extract(value, rf"(?i)\b({'|'.join(PLAIN_MATERIALS)})\b", 1), F.lit("")), "(?i)^aluminium$", "aluminum")
    return F.coalesce(F.when(label.rlike(rf"(?i){_PATTERNS['material']}"), material_text(value)), plain)


def _protection(value: Column, label: Column) -> Column:
    """The ratings without spaces, each once."""
    found = F.regexp_extract_all(value, F.lit(r"(?i)\b((?:IP|IK)\s*\d{2}[A-Z]?|(?:NEMA\s*)?(?:Type\s+)?\d+[A-Z]?)\b"), F.lit(1))
    rated = F.filter(found, lambda t: t.rlike("(?i)^(?:IP|IK|NEMA|Type)"))
    number = lambda t: F.regexp_extract(t, "(?i)([0-9]+[A-Z]?)$", 1)
    nema = lambda t: F.concat(F.lit("NEMA "), F.when(t.rlike("(?i)type"), "Type ").otherwise(""), number(t))
    one = lambda t: F.when(t.rlike("(?i)^NEMA"), nema(t)).when(t.rlike("(?i)^Type"), F.concat(F.lit("Type"), number(t))).otherwise(F.regexp_replace(t, " ", ""))
    return F.nullif(F.array_join(F.array_distinct(F.transform(rated, one)), "; "), F.lit(""))


def _temperature(value: Column, label: Column) -> Column:
    """Both ends of a plausible range of operation, as ``low..high °C``."""
    def written(r: Column) -> Column:
        low, high = short_number(r["min"]), short_number(r["max"])
        sound = F.coalesce(is_plausible_celsius(r["min"]), F.lit(True)) & F.coalesce(is_plausible_celsius(r["max"]), F.lit(True))
        ends = F.when(low.isNotNull() & high.isNotNull(), F.concat(low, F.lit(".."), high)).when(low.isNotNull(), F.concat(F.lit(">= "), low)).otherwise(F.concat(F.lit("<= "), high))
        return F.when(sound, F.concat(ends, F.lit(" °C")))

    text = F.concat(label, F.lit(": "), value)
    return F.when(~text.rlike(r"(?i)\b(?:storage|transport|colou?r\s+temp)\b"), let(temperature_range(text), written))


#: How a field's value is read from a clean value and its label.
READERS: dict[str, Callable[[Column, Column], Column]] = {
    "weight": _first(rf"\b{_N}\s*(?:{_spelled([x for spelled, *_ in WEIGHTS.values() for x in spelled])})\b"),
    "dimensions": _dimensions,
    "material": _material,
    "certificates": _certificates,
    "voltage": _first(rf"\b{_RANGE}\s*(?:{_spelled(ELECTRICAL['kV'] + ELECTRICAL['V'])})\s*(?:AC/DC|AC|DC)?(?:\s*\d+/?\d*\s*Hz)?\b"),
    "current": _first(rf"(?:[<>]=?\s*)?\b{_RANGE}\s*(?:{_spelled(ELECTRICAL['mA'] + ELECTRICAL['A'])})\b"),
    "color": lambda value, label: colour_text(value),
    "protection": _protection,
    "operatingTemperature": _temperature,
    "typeCode": lambda value, label: F.when((value != "") & (F.length(value) <= LONGEST_CODE), value),
}


def _readings(label: Column, value: Column) -> Column:
    """An array of (field, name, value): what a label and value say of each field, in the order of FIELDS."""
    def of(key: str, name: str, pattern: str) -> Column:
        said = F.concat(label, F.lit(" "), value).rlike(f"(?i){pattern}")
        text = F.when(said, value).otherwise(F.concat(label, F.lit(": "), value)) if key in ANYWHERE else F.when(said, value)
        return F.struct(F.lit(key).alias("field"), F.lit(name).alias("name"), F.trim(F.regexp_replace(READERS[key](text, label), r"\s+", " ")).alias("value"))

    return F.filter(F.array(*[of(key, name, pattern) for key, name, pattern, _ in FIELDS if key in READERS]), lambda r: F.coalesce(r["value"] != "", F.lit(False)))


def _clean(text: Column) -> Column:
    """:func:`clean_text` of a column; what has only ASCII, no entity and no run of spaces is clean but for its ends."""
    return F.when(~text.rlike("[^ -~]|&|  "), F.trim(text)).otherwise(clean_text(text))


def _says(label: Column, value: Column) -> Column:
    """Whether :func:`_readings` of a clean label and value can find anything: one pattern of all labels, plain materials and marks, each of which begins a word with a letter.

    It may be true of a text that is then read in vain, but is never false of one that says something.
    """
    words = [p for key, _, p, _ in FIELDS if key in READERS] + PLAIN_MATERIALS + [mark for mark, _ in CERTIFICATES]
    return F.concat(label, F.lit(" "), value).rlike(rf"(?i)\b(?={'|'.join(_beginnings(words))})(?:{'|'.join(words)})")


def _beginnings(patterns: list[str]) -> list[str]:
    """The first two letters, or the one before anything else, of all alternatives: most words are none of them, and a look at these is cheap."""
    parts = [re.sub(r"^\?i?:", "", part) for p in patterns for part in re.split(r"[|()]", p.replace(r"\b", ""))]
    return sorted({m[0].lower() for part in parts if (m := re.match(r"[A-Za-z](?:[A-Za-z](?![?*{]))?", part))})


def _source_points() -> Column:
    source = F.coalesce(F.create_map(*[F.lit(x) for p in SOURCES.items() for x in p])[F.col("source_type")], F.lit(OTHER_SOURCE))
    place = F.lower(F.concat_ws(" ", "parser", "stage", "group"))
    of_document = F.contains(place, F.lit("pdf")) | F.contains(place, F.lit("document"))
    return source + F.when(of_document, DOCUMENT_POINTS).otherwise(0) + F.coalesce(F.floor(F.col("confidence") * 10 + 0.5), F.lit(0))


def _label_points(field: Column, label: Column) -> Column:
    out = F.lit(0)
    for key, pattern, points in LABEL_POINTS:
        out = out + F.when((field == key) & F.lower(label).rlike(pattern), points).otherwise(0)
    return out


def _with_said(evidence: DataFrame, of_pair: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of the evidence with what ``of_pair`` makes of their label and value, once for each distinct pair (_label, _value, c: both clean) that names something; rows without item go."""
    rows = _whole(evidence).filter(F.col("item").isNotNull()).withColumns({"_label": F.trim(F.concat(_text("group"), F.lit(" "), _text("name"))), "_value": _text("value")})
    # exploding an array of one keeps the clean texts from being made anew for each use
    cleaned = lambda pairs: pairs.select("_label", "_value", F.explode(F.array(F.struct(_clean(F.col("_label")).alias("l"), _clean(F.col("_value")).alias("v")))).alias("c"))
    pairs = cleaned(rows.select("_label", "_value").distinct()).filter(_says(F.col("c.l"), F.col("c.v"))).select("_label", "_value")
    known = broadcast_if_few(pairs)
    read = of_pair(cleaned(known))
    return rows.join(read if known is pairs else F.broadcast(read), ["_label", "_value"])


def evidence_values(evidence: DataFrame) -> DataFrame:
    """item, field, label, value, source_url, confidence, points, ord: of each item and field the reading with most points, then the earliest (of one place the smallest value, then source).

    A field is read where its label or value names it; materials and certificates are read from any attribute. Distinct pairs of label and
    value are read once, and only those that name something: others, such as texts that differ in each row, end at one pattern. Null labels and
    values count as empty, rows without item go; attributes that say nothing leave no row.
    """
    of_pair = lambda pairs: pairs.select("_label", "_value", F.explode(_readings(F.col("c.l"), F.col("c.v"))).alias("r")).withColumn("_more", _label_points(F.col("r.field"), F.col("_label")))
    each = _with_said(evidence, of_pair).withColumn("points", (_source_points() + F.col("_more")).cast("int"))
    sure = F.least(F.coalesce("confidence", F.lit(UNKNOWN)), F.lit(MOST_CONFIDENCE))
    best = F.min_by(F.struct(F.col("r.name").alias("label"), F.col("r.value").alias("value"), "source_url", sure.alias("confidence"), "points", "ord"), F.struct(-F.col("points"), "ord", "r.value", "source_url")).alias("best")
    return each.groupBy("item", F.col("r.field").alias("field")).agg(best).select("item", "field", "best.*")


def image_values(evidence: DataFrame, items: DataFrame) -> DataFrame:
    """Like :func:`evidence_values` for the field ``image``: the first url of an image in an attribute that can be the item's.

    ``items``: item, key, hosts (array of the maker's hosts; null or empty where unknown). The url holds the item's key, or lies on the maker's
    host under a telling word; where hosts are known it must lie on one of them or below. Relative urls are completed from the source's.
    """
    said = F.concat_ws(" ", "name", "value", "source_url")
    # rows that name no image, and images that can't be the product's, go before anything meets
    rows = _whole(evidence).filter(said.rlike(_IMAGE_END)).select("item", "ord", "source_url", F.posexplode(F.regexp_extract_all(said, F.lit(_IMAGE), F.lit(1))).alias("place", "raw")).filter(~F.lower("raw").rlike(NO_IMAGE))
    raw = F.col("raw")
    whole = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(raw.startswith("/"), F.concat(F.nullif(origin_of(F.col("source_url")), F.lit("")), raw)).otherwise(raw)
    # exploding an array of one keeps a url and its host from being made anew for each use
    urls = rows.select("item", "ord", "source_url", "place", F.explode(F.array(whole)).alias("url")).filter("url is not null")
    urls = urls.select("item", "ord", "source_url", "place", "url", F.explode(F.array(host_of(F.col("url")))).alias("host"))
    each = urls.join(items.select("item", "key", F.coalesce("hosts", F.array().cast("array<string>")).alias("hosts")), "item")
    host, bare = F.col("host"), compact_key(F.col("key"))
    own = F.exists("hosts", lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))
    known = F.size("hosts") > 0
    keyed = (bare != "") & F.contains(compact_key(F.col("url")), bare)
    fits = ~F.lower("url").rlike(NO_IMAGE) & ((keyed & (own | ~known)) | (own & F.lower("url").rlike(SOME_IMAGE)))
    best = F.min_by(F.struct(F.lit("Product image").alias("label"), F.col("url").alias("value"), "source_url", F.lit(IMAGE_CONFIDENCE).alias("confidence"), F.lit(0).alias("points"), "ord"), F.struct("ord", "place")).alias("best")
    return each.filter(fits).groupBy("item", F.lit("image").alias("field")).agg(best).select("item", "field", "best.*")


def _kept(rows: DataFrame) -> DataFrame:
    """The rows, written to the folder of checkpoints that the cluster shares, so that a round's plan doesn't hold those before it."""
    spark: SparkSession = rows.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return rows.checkpoint()


#: What is known of a field; an item's records travel together, as an array.
_RECORD = ["field", "label", "value", "source_url", "confidence", "points", "from_item"]
#: Fields that evidence can have: an item's wanted ones of these are bits of a number until they meet what is known.
_READ = [*READERS, "image"]


def _wanted_fields(missing: DataFrame) -> DataFrame:
    """item, _wanted: arrays of fields, one array for those in _READ and one for each other."""
    place = F.create_map(*[F.lit(x) for n, key in enumerate(_READ) for x in (key, 1 << n)])[F.col("field")]
    rows = missing.select("item", "field").dropna().withColumn("_bit", place)
    bits = rows.filter("_bit is not null").groupBy("item").agg(F.bit_or("_bit").alias("_bits"))
    of_bits = F.filter(F.array(*[F.when(F.col("_bits").bitwiseAND(1 << n) != 0, key) for n, key in enumerate(_READ)]), lambda f: f.isNotNull())
    return bits.select("item", of_bits.alias("_wanted")).unionByName(rows.filter("_bit is null").select("item", F.array("field").alias("_wanted")))


def _known_and_wanted(missing: DataFrame, values: DataFrame, held: DataFrame | None) -> DataFrame:
    """item, known (a record for each field that it has), wanted (array of fields), after one exchange by item. What an item holds counts more than what its evidence says."""
    record = F.struct(*[F.col("item").alias(c) if c == "from_item" else F.col(c) for c in _RECORD])
    rows = values.select("item", record.alias("_said")).unionByName(_wanted_fields(missing), allowMissingColumns=True)
    if held is None:
        rows = rows.withColumn("_held", F.lit(None).cast("struct<field:string,value:string>"))
    else:
        rows = rows.unionByName(held.filter((F.col("value") != "") & F.col("item").isNotNull() & F.col("field").isNotNull()).select("item", F.struct("field", "value").alias("_held")), allowMissingColumns=True)
    packed = rows.groupBy("item").agg(F.collect_list("_said").alias("_said"), F.array_distinct(F.flatten(F.collect_set("_wanted"))).alias("wanted"), F.sort_array(F.collect_set("_held")).alias("_held"))
    # in order a field's first value is the smallest
    smallest = let(F.col("_held"), lambda all_: F.filter(all_, lambda h, i: (i == 0) | (F.get(all_, i - 1)["field"] != h["field"])))
    of_held = {"field": "field", "label": "field", "value": "value"}
    fixed = {"source_url": F.lit(None).cast("string"), "confidence": F.lit(MOST_CONFIDENCE), "points": F.lit(1000), "from_item": F.col("item")}
    own = F.transform(smallest, lambda h: F.struct(*[(h[of_held[c]] if c in of_held else fixed[c]).alias(c) for c in _RECORD]))
    taken = F.col("_held.field")
    # evidence has a field of an item once
    return packed.select("item", F.concat(F.filter("_said", lambda r: ~F.array_contains(taken, r["field"])), own).alias("known"), "wanted")


def repair_from_evidence(missing: DataFrame, evidence: DataFrame, items: DataFrame | None = None, bases: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """item, field, label, value, source_url, confidence, from_item, round: what fills the ``missing`` (item, field) fields.

    Round 0 takes the best of an item's own evidence. In each further round a field still missing takes what one of the item's base items
    (``bases``: item, base) came to have in the round before, or holds already (``held``: item, field, value), until a round fills nothing:
    a value comes from the nearest base that has it; of several equally near the one with most points, then the smallest item it comes from, then
    the smallest value. Cycles of bases end, as a filled field isn't filled again. ``items`` (item, and where known key, hosts, conflict) adds images
    and leaves out items whose identity is in conflict: these are neither repaired nor a source for others. Rows may repeat; null items and fields meet nothing.

    Rounds go over one row for an item or base, with all its fields, not over one for each field.
    """
    values = evidence_values(evidence)
    if items is not None and {"key", "hosts"} <= set(items.columns):
        values = values.unionByName(image_values(evidence, items))
    whole = _known_and_wanted(missing, values, held if bases is not None else None)
    if items is not None and "conflict" in items.columns:
        whole = whole.join(items.filter("conflict").select("item").distinct(), "item", "left_anti")
    of_fields = lambda fields: F.inline(F.filter("known", lambda k: F.array_contains(F.col(fields), k["field"])))
    columns = ["item", "field", "label", "value", "source_url", "confidence", "from_item"]
    if bases is None:
        return whole.select("item", of_fields("wanted")).select(*columns, F.lit(0).alias("round"))
    whole = _kept(whole)
    filled = whole.select("item", of_fields("wanted")).withColumn("round", F.lit(0))
    links = bases.select("item", F.col("base").alias("_base")).dropna().distinct()
    links = links.join(links.groupBy("item").agg((F.count(F.lit(1)) == 1).alias("_single")), "item")
    # without a base there is nothing to wait for
    still = _kept(whole.select("item", F.array_except("wanted", "known.field").alias("still")).filter(F.size("still") > 0).join(links, "item"))
    news, at = whole.select("item", "known"), 0
    while not still.isEmpty():
        at += 1
        had = news.filter(F.size("known") > 0).withColumnRenamed("item", "_base")
        offered = lambda asking: asking.join(had, "_base").select("item", F.filter("known", lambda k: F.array_contains(F.col("still"), k["field"])).alias("known")).filter(F.size("known") > 0)  # noqa: B023, E731
        # an item with a single base takes what that has; of several bases the best is found for each field
        best = F.min_by(F.struct(*_RECORD), F.struct(-F.col("points"), "from_item", "value")).alias("best")
        several = offered(still.filter("not _single")).select("item", F.inline("known")).groupBy("item", "field").agg(best)
        news = _kept(offered(still.filter("_single")).unionByName(several.groupBy("item").agg(F.collect_list("best").alias("known"))))
        if news.isEmpty():
            break
        filled = filled.unionByName(news.select("item", F.inline("known")).withColumn("round", F.lit(at)))
        met = still.join(news.select("item", F.col("known.field").alias("_got")), "item", "left")
        left = F.array_except("still", F.coalesce("_got", F.array().cast("array<string>")))
        still = _kept(met.select("item", left.alias("still"), "_base", "_single").filter(F.size("still") > 0))
    return filled.select(*columns, "round")


#: Fields at most that are the bits of one number; with more names among the missing ones, fields go with their values.
MOST_BITS = 63


def _fields_of_bits(missing: DataFrame) -> list[str] | None:
    """The fields that can be wanted, by the bit that each is: those of _READ, then others by name; null where they are more than a number's bits. Looking takes a job over the names."""
    others = missing.select("field").filter(F.col("field").isNotNull() & ~F.col("field").isin(*_READ)).distinct().limit(MOST_BITS - len(_READ) + 1).collect()
    return [*_READ, *sorted(r["field"] for r in others)] if len(_READ) + len(others) <= MOST_BITS else None


def repaired_fields(missing: DataFrame, evidence: DataFrame, items: DataFrame | None = None, bases: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """item, field, round of what :func:`repair_from_evidence` fills, without the values that fill it.

    Whether a field is filled, and in which round, doesn't hang on values or points. An item's fields are bits of a number here, in all that is
    exchanged and kept: texts end at what their distinct pairs say, and records of values, which take most of the disk, aren't made.
    """
    fields = _fields_of_bits(missing)
    if fields is None:
        return repair_from_evidence(missing, evidence, items, bases, held).select("item", "field", "round")
    bit_of = F.create_map(*[x for n, key in enumerate(fields) for x in (F.lit(key), F.lit(1 << n).cast("long"))])
    none = F.lit(0).cast("long")
    of_pair = lambda pairs: pairs.select("_label", "_value", F.aggregate(_readings(F.col("c.l"), F.col("c.v")), none, lambda bits, r: bits.bitwiseOR(bit_of[r["field"]])).alias("_known"))
    rows = _with_said(evidence, of_pair).select("item", "_known").unionByName(missing.select("item", bit_of[F.col("field")].alias("_wanted")), allowMissingColumns=True)
    if items is not None and {"key", "hosts"} <= set(items.columns):
        rows = rows.unionByName(image_values(evidence, items).select("item", bit_of[F.lit("image")].alias("_known")), allowMissingColumns=True)
    if held is not None and bases is not None:
        rows = rows.unionByName(held.filter(F.col("value") != "").select("item", bit_of[F.col("field")].alias("_known")), allowMissingColumns=True)
    conflict = F.col("item").isNull()
    if items is not None and "conflict" in items.columns:
        rows = rows.unionByName(items.filter("conflict").select("item", F.lit(True).alias("_conflict")), allowMissingColumns=True)
        conflict = F.coalesce(F.bool_or("_conflict"), F.lit(False))
    bits = [F.coalesce(F.bit_or(f"_{c}"), none).alias(c) for c in ("known", "wanted")]
    whole = rows.filter("item is not null").groupBy("item").agg(*bits, conflict.alias("_out")).filter("not _out").select("item", "known", "wanted")
    of_bits = F.filter(F.array(*[F.when(F.col("known").bitwiseAND(1 << n) != 0, key) for n, key in enumerate(fields)]), lambda f: f.isNotNull())
    named = lambda got, at: got.select("item", F.explode(of_bits).alias("field"), F.lit(at).alias("round"))
    own = F.col("known").bitwiseAND(F.col("wanted")).alias("known")
    if bases is None:
        return named(whole.select("item", own), 0)
    whole = _kept(whole)
    filled = named(whole.select("item", own), 0)
    # dealt out by item once, for the removal of repeats and for the join
    links = bases.select("item", F.col("base").alias("_base")).dropna().repartition("item").distinct()
    still = _kept(whole.select("item", F.col("wanted").bitwiseAND(F.bitwise_not("known")).alias("still")).filter("still <> 0").join(links, "item"))
    news, at = whole.select("item", "known"), 0
    while not still.isEmpty():
        at += 1
        had = news.filter("known <> 0").withColumnRenamed("item", "_base")
        offered = still.join(had, "_base").select("item", F.col("still").bitwiseAND(F.col("known")).alias("known")).filter("known <> 0")
        news = _kept(offered.groupBy("item").agg(F.bit_or("known").alias("known")))
        if news.isEmpty():
            break
        filled = filled.unionByName(named(news, at))
        met = still.join(news, "item", "left").withColumn("still", F.col("still").bitwiseAND(F.bitwise_not(F.coalesce("known", none))))
        still = _kept(met.select("item", "still", "_base").filter("still <> 0"))
    return filled


#: Fields for which no page is fetched again, and the one that is never retried.
FINAL_ONLY, NEVER = ("image", "typeCode"), "certificates"


def retry_decisions(audit: DataFrame, items: DataFrame, exhausted: DataFrame) -> DataFrame:
    """item, retry, reason, fields, untried: whether fetching an item's pages once more can fill what it still lacks.

    ``audit``: item, field, requirement, missing; ``exhausted`` (item, field): fields known not to be published; ``items``: item, force,
    skip_preferred, passed (booleans, null as false), possible and tried (arrays of stages, null as empty). Fields are in order of text, stages in that of
    ``possible``. Reasons: nothing-missing, final-only, exhausted, preferred-only, passed, untried-stages, all-tried, no-stage. A forced item is tried for every
    field; else images and type codes alone are no cause, but for a required image that is all that lacks.
    """
    open_ = audit.filter(F.coalesce("missing", F.lit(False)) & (F.col("requirement") != "not-applicable") & (F.col("field") != NEVER))
    known = exhausted.select("item", "field").distinct().withColumn("_gone", F.lit(True))
    lacking = open_.join(known, ["item", "field"], "left").groupBy("item").agg(F.sort_array(F.collect_set(F.struct("field", "requirement", F.coalesce("_gone", F.lit(False)).alias("gone")))).alias("all"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    stages = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    none = F.array().cast("array<struct<field:string,requirement:string,gone:boolean>>")
    rows = items.join(lacking, "item", "left").select("item", flag("force").alias("force"), flag("skip_preferred").alias("skip"), flag("passed").alias("passed"), stages("possible").alias("possible"), stages("tried").alias("tried"), F.coalesce("all", none).alias("all"))
    fetched = F.filter("all", lambda f: ~f["field"].isin(*FINAL_ONLY))
    image_alone = (F.size("all") == 1) & F.exists("all", lambda f: (f["field"] == "image") & (f["requirement"] == "required"))
    rows = rows.withColumn("worth", F.when(F.col("force") | image_alone, F.col("all")).otherwise(fetched))
    rows = rows.withColumn("left", F.when(F.col("force"), F.col("worth")).otherwise(F.filter("worth", lambda f: ~f["gone"])))
    preferred = F.forall("left", lambda f: f["requirement"] == "preferred") & ~F.col("force")
    untried = F.array_except("possible", "tried")
    reason = (
        F.when(F.size("all") == 0, "nothing-missing").when(F.size("worth") == 0, "final-only").when(F.size("left") == 0, "exhausted").when(preferred & F.col("skip"), "preferred-only").when(preferred & F.col("passed"), "passed")
        .when(F.size(untried) > 0, "untried-stages").when(F.size("possible") > 0, "all-tried").otherwise("no-stage")
    )
    kept = F.when(F.col("reason") == "final-only", F.col("all")).when(F.col("reason") == "exhausted", F.col("worth")).otherwise(F.col("left"))
    said = rows.withColumns({"reason": reason, "untried": untried}).withColumn("retry", F.col("reason") == "untried-stages")
    return said.select("item", "retry", "reason", F.array_join(F.transform(kept, lambda f: f["field"]), ",").alias("fields"), F.when(F.col("retry"), F.array_join("untried", ",")).otherwise("").alias("untried"))
