"""Device types from several channels, profiles of types, and completeness of an item's fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of a channel, points for each further channel that agrees, and points of a text's source.
WEIGHTS = {"text": 1.0, "family": 1.2, "url": 1.0, "eclass": 1.25, "etim": 1.1, "unspsc": 0.95}
AGREEMENT = 250
SOURCES = {"official": 90, "official-fallback": 70, "cache": 30, "distributor": -40}
#: Confidence by score.
CONFIDENCE = [(1500, 0.98), (1420, 0.94), (1320, 0.88), (1200, 0.78)]


def type_signals(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """item, channel, type, score: for each channel of an item and type the best rule that matches one of its texts.

    ``texts``: item, channel, text, priority, source_type; ``rules``: channel, pattern, type, points (a table that is collected
    behind a check of its number). In the text channel a text's priority and its source's points are added; in the others the rule's points count.
    """
    listed = rules.limit(2001).collect()
    if len(listed) > 2000:
        raise ValueError("more than 2000 rules")
    hits = F.array(*[F.when((F.col("channel") == r["channel"]) & F.col("text").rlike(f"(?i){r['pattern']}"), F.struct(F.lit(r["type"]).alias("type"), F.lit(float(r["points"])).alias("points"))) for r in listed])
    hits = F.filter(hits, lambda h: h.isNotNull()) if listed else F.array().cast("array<struct<type:string,points:double>>")
    source = F.coalesce(F.create_map(*[F.lit(x) for p in SOURCES.items() for x in p])[F.col("source_type")], F.lit(0))
    added = F.when(F.col("channel") == "text", F.coalesce("priority", F.lit(0)) + source).otherwise(0)
    weight = F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p])[F.col("channel")]
    rows = texts.select("item", "channel", added.alias("added"), weight.alias("weight"), F.explode(hits).alias("hit"))
    return rows.groupBy("item", "channel", F.col("hit.type").alias("type")).agg(F.max((F.col("hit.points") + F.col("added")) * F.col("weight")).alias("score"))


def classify_devices(signals: DataFrame) -> DataFrame:
    """item, type, score, margin, channels, confidence of the type with most points over all channels; ties go to the type first in order of text.

    Agreement of several channels adds points and confidence; a narrow win takes some away.
    """
    types = signals.groupBy("item", "type").agg((F.sum("score") + AGREEMENT * (F.count(F.lit(1)) - 1)).alias("score"), F.count(F.lit(1)).alias("channels"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("back"), "type", "channels")))
    top = types.groupBy("item").agg(ranked.alias("r"))  # one entry for each type that an item's rules name
    best, second = F.col("r")[0], F.get("r", F.lit(1))
    score = -best["back"]
    margin = F.when(second.isNull(), score).otherwise(score + second["back"])
    sure = F.when(F.lit(False), 0.0)
    for least, value in CONFIDENCE:
        sure = sure.when(score >= least, value)
    sure = sure.otherwise(0.68)
    sure = F.when(best["channels"] >= 2, F.least(F.lit(0.99), sure + 0.05)).otherwise(sure)
    sure = F.when(second.isNotNull() & (margin < 200), F.greatest(F.lit(0.5), sure - 0.12)).otherwise(sure)
    return top.select("item", best["type"].alias("type"), score.alias("score"), margin.alias("margin"), best["channels"].alias("channels"), F.round(sure, 2).alias("confidence"))


def with_profiles(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """Items (item, type) with their type's sheets and fields from ``profiles`` (type, sheets, critical, electrical); nulls for an unknown type."""
    return items.join(profiles, "type", "left")


def field_requirements(items: DataFrame, fields: list[str]) -> DataFrame:
    """item, field, requirement: voltage and current are required where the type's electrical fields name them, else not applicable; critical fields are required, others preferred.

    ``items``: item, critical and electrical (arrays of field names, null as none).
    """
    none = F.array().cast("array<string>")
    rows = items.select("item", F.coalesce("critical", none).alias("critical"), F.coalesce("electrical", none).alias("electrical"), F.explode(F.array(*map(F.lit, fields))).alias("field"))
    electric = F.col("field").isin("voltage", "current")
    need = F.when(electric, F.when(F.array_contains(F.col("electrical"), F.col("field")), "required").otherwise("not-applicable")).when(F.array_contains(F.col("critical"), F.col("field")), "required").otherwise("preferred")
    return rows.select("item", "field", need.alias("requirement"))


def completeness(requirements: DataFrame, before: DataFrame, after: DataFrame, repaired: DataFrame, retried: Column | None = None) -> DataFrame:
    """item, field, requirement, status of the final audit: not-applicable, present, found-after-repair, found-after-retry, not-published, retry-skipped or missing.

    ``before`` and ``after`` (item, field, value) hold what was there at either time (null and empty values count as missing), ``repaired`` (item, field) what a
    repair filled. ``retried`` is a column of ``requirements``: true where a retry ran, false where it was skipped, null where there was none.
    """
    filled = F.coalesce("value", F.lit("")) != ""
    marks = [rows.select("item", "field", F.lit(1 << n).alias("_seen")) for n, rows in enumerate((before.filter(filled), after.filter(filled), repaired))]
    # what is known of a field meets in one group, as bits of one number, and then its requirement, instead of three joins
    seen = marks[0].unionByName(marks[1]).unionByName(marks[2]).groupBy("item", "field").agg(F.bit_or("_seen").alias("_seen"))
    joined = requirements.withColumn("_retried", F.lit(None).cast("boolean") if retried is None else retried).join(seen, ["item", "field"], "left")
    b, a, r = (F.coalesce(F.col("_seen").bitwiseAND(1 << n) != 0, F.lit(False)) for n in range(3))
    status = (
        F.when(F.col("requirement") == "not-applicable", "not-applicable").when(b & a, "present").when(~b & a, F.when(r, "found-after-repair").otherwise("found-after-retry"))
        .when(F.col("_retried"), "not-published").when(~F.col("_retried"), "retry-skipped").otherwise("missing")
    )
    return joined.select("item", "field", "requirement", status.alias("status"))
