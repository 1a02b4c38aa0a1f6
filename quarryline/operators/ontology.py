"""Labels and what they mean: rules with the longest match, aliases exact and similar, labels without a meaning.

Rules and aliases are tables that a user supplies. Rules are collected to the driver behind a check of their number and become
one column expression, evaluated once for each distinct label; aliases meet labels in joins on spellings and letter pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantities import parse_quantities
from .attributes import with_read

#: A rule table of more rows isn't turned into an expression.
MOST_RULES = 5_000
#: Least similarity of an alias of the same source, of the global ones and of other sources'; words that don't count.
THRESHOLDS = {"manufacturer": 0.86, "global": 0.84, "cross": 0.92}
STOP_WORDS = ["a", "an", "and", "at", "by", "for", "in", "of", "on", "per", "the", "to", "with"]
#: A small table of properties to begin with: key, order, kind of quantity, patterns, excluding pattern.
PROPERTIES = [
    ("controlVoltage", 0, "voltage", ["control(?:\\s+circuit)?\\s+voltage", "coil\\s+voltage", "steuerspannung"], None), ("ratedVoltage", 1, "voltage", ["(?:rated|nominal|supply|operating)\\s+voltage", "nennspannung"], "insulation|impulse"),
    ("ratedCurrent", 2, "current", ["(?:rated|nominal|operational)\\s+current", "nennstrom"], "residual|leakage"), ("weight", 3, "mass", ["\\b(?:net |gross )?weight\\b", "gewicht"], None),
    ("width", 4, "length", ["\\bwidth\\b", "breite"], None), ("operatingTemperature", 5, "temperature", ["(?:operating|ambient)\\s+temperature", "temperature"], "colou?r\\s*temp|storage"),
    ("material", 6, None, ["(?:housing\\s+)?material\\b", "werkstoff"], "packag"), ("protection", 7, None, ["degree\\s+of\\s+protection", "\\bprotection\\b", "schutzart"], "overload"),
    ("certificates", 8, None, ["approvals?\\b", "certificates?\\b"], None), ("colour", 9, None, ["colou?r\\b", "farbe"], "temp"),
]
PROPERTY_SCHEMA = "key string, rank int, kind string, patterns array<string>, excluded string"


def property_of(label: Column, rules: DataFrame) -> Column:
    """The rule (key, kind) whose pattern covers most of the label; of equal ones the one of lower rank; null where none does.

    A rule whose excluding pattern matches doesn't count. Patterns match without regard to case.
    """
    listed = rules.orderBy("rank", "key").limit(MOST_RULES + 1).collect()
    if len(listed) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")

    def scored(r) -> Column:
        matched = F.greatest(F.lit(0), *[F.length(F.regexp_extract(label, f"(?i)({p})", 1)) for p in r["patterns"]])
        open_ = F.lit(True) if r["excluded"] is None else ~label.rlike(f"(?i){r['excluded']}")
        return F.when((matched > 0) & open_, F.struct(matched.alias("n"), F.lit(-r["rank"]).alias("back"), F.lit(r["key"]).alias("key"), F.lit(r["kind"]).alias("kind")))

    if not listed:
        return F.lit(None).cast("struct<n:int,back:int,key:string,kind:string>")
    return F.array_max(F.filter(F.array(*[scored(r) for r in listed]), lambda x: x.isNotNull()))


def understand(attributes: DataFrame, rules: DataFrame) -> DataFrame:
    """Attributes with the property that their label means and the quantities of its kind in their value (all, where it has no kind).

    item, ord, name, property, quantities. Distinct labels are matched once and joined back; an attribute without meaning has a null property.
    """
    labels = attributes.select("name").distinct()
    meanings = labels.select(F.col("name").alias("_name"), property_of(F.col("name"), rules).alias("meaning"))
    joined = with_read(attributes.join(meanings, attributes["name"].eqNullSafe(meanings["_name"]), "left"), "value", parse_quantities, "_parsed")
    kept = F.filter(F.coalesce("_parsed", parse_quantities(F.lit(None).cast("string"))), lambda q: F.col("meaning.kind").isNull() | (q["kind"] == F.col("meaning.kind")))
    return joined.select("item", "ord", "name", F.col("meaning.key").alias("property"), kept.alias("quantities"))


def plain_label(label: Column) -> Column:
    """Lower-case words of letters and digits; a capital inside a word begins a new one."""
    out = F.regexp_replace(F.replace(F.replace(F.coalesce(label, F.lit("")), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")), "([a-z])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(out), "[^a-z0-9]+", " "))


def _tokens(plain: Column) -> Column:
    return F.filter(F.split(plain, " "), lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def _pairs(compact: Column) -> Column:
    """Letter pairs with the number of the occurrence, so that sets of them intersect like bags."""
    pairs = F.when(F.length(compact) > 1, F.transform(F.sequence(F.lit(1), F.length(compact) - 1), lambda i: F.substring(compact, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.transform(pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, 1, i), lambda x: x == p)).cast("string")))


def similarity(left: Column, right: Column) -> Column:
    """Likeness of two plain labels, 0 to 1: shared words and letter pairs, containment, equal words in any order."""
    a, b = F.replace(left, F.lit(" "), F.lit("")), F.replace(right, F.lit(" "), F.lit(""))
    x, y = F.array_distinct(_tokens(left)), F.array_distinct(_tokens(right))
    words = F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))
    dice = F.when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2.0 * F.size(F.array_intersect(_pairs(a), _pairs(b))) / (F.length(a) + F.length(b) - 2))
    base = F.greatest(words * 0.62 + dice * 0.38, dice)
    shorter, longer = F.when(F.length(left) < F.length(right), left).otherwise(right), F.when(F.length(left) < F.length(right), right).otherwise(left)
    inside = F.when((F.length(shorter) >= 8) & F.contains(longer, shorter), 0.92 - F.least(F.lit(0.12), (F.length(longer) - F.length(shorter)) / 160)).otherwise(0.0)
    reordered = F.when((words == 1) & (F.size(_tokens(left)) >= 2) & (F.size(_tokens(right)) >= 2), 0.95).otherwise(0.0)
    return F.when((left == "") | (right == ""), 0.0).when((left == right) | (a == b), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(base, inside, reordered)))


def similar_aliases(labels: DataFrame, aliases: DataFrame, least: float = 0.0) -> DataFrame:
    """(label, alias, key, score) of labels and aliases that share a letter pair or are equal, from ``least`` on.

    Labels with no letter pair in common have a score of zero or are one letter long; the join on pairs and on whole spellings meets all others.
    """
    def keyed(rows: DataFrame, name: str) -> DataFrame:
        plain = plain_label(F.col(name))
        compact = F.replace(plain, F.lit(" "), F.lit(""))
        return rows.select("*", plain.alias(f"plain_{name}"), F.explode(F.array_distinct(F.concat(F.array(compact), F.transform(_pairs(compact), lambda p: F.substring(p, 1, 2))))).alias("pair"))

    left = keyed(labels.select("label").filter("label is not null").distinct(), "label")
    met = left.join(keyed(aliases.select("alias", "key"), "alias"), "pair").select("label", "plain_label", "alias", "plain_alias", "key").distinct()
    return met.withColumn("score", similarity(F.col("plain_label"), F.col("plain_alias"))).filter((F.col("score") >= least) & (F.col("score") > 0)).select("label", "alias", "key", "score")


def suggest_aliases(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """The most similar alias of each label, with its score to three places; ties go to the alias that is first in order of text."""
    best = F.min_by(F.struct("alias", "key", "score"), F.struct(-F.col("score"), "alias", "key")).alias("best")
    return similar_aliases(labels, aliases).groupBy("label").agg(best).select("label", "best.alias", "best.key", F.round("best.score", 3).alias("score"))


def unmapped_labels(attributes: DataFrame, rules: DataFrame, aliases: DataFrame, longest: int = 60) -> DataFrame:
    """Labels of short values with a quantity that neither a rule nor an alias (exact, or similar enough) maps: label, n, items."""
    spoken = with_read(attributes.filter(F.length(F.trim("value")) <= longest), "value", parse_quantities, "_parsed").filter(F.size("_parsed") > 0)
    counted = spoken.groupBy(F.trim("name").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item").alias("items")).filter("label <> ''")
    # exploded, as the rules would else be tried on every row before the grouping
    unknown = counted.select(F.explode(F.array("label")).alias("label"), "n", "items").filter(property_of(F.col("label"), rules).isNull())
    named = similar_aliases(unknown, aliases, THRESHOLDS["global"]).select("label").distinct()
    return unknown.join(named, "label", "left_anti")
