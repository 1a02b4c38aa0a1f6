"""Facts of items, ranked and indexed, and the cells of columns resolved from them by rules that are rows.

A fact relation has item, key, value, source_kind, source_url, source_type, rule, confidence, ord (and what else a user keeps). Its index is
a table of facts with their comparable values and ranks, bucketed by item, so that lookups by item and key neither shuffle nor sort it; words
of keys and values are an inverted index beside it. Rules are relations too: they meet facts in joins, and labels through one automaton.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_text, compact_key
from ..functions.units import max_in_unit
from .attributes import broadcast_if_few, first_of, with_read
from .ontology import plain_label
from .spec_miner import LABEL_SCHEMA, label_spans

#: Points of a fact's kind, and of where it comes from (ten for each).
KIND_POINTS = {"attribute": 40, "normalized": 34, "document": 32, "repair": 28}
SOURCE_POINTS = {"official": 4, "official-fallback": 3, "generated": 2, "cache": 1, "distributor": -2}
OTHER_KIND = 20
#: What a yes or no is written as.
YES, NO = r"(?i)^(?:yes|true|ja|oui|si|available|included|with)\b", r"(?i)^(?:no|none|false|nein|non|without|not)\b"
RULE_SCHEMA = "column string, priority int, source string, name string, reads string, unit string"


def _points(of: Column, table: dict[str, int], other: int) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[of], F.lit(other))


def fact_rank(kind: Column, source_type: Column, confidence: Column) -> Column:
    """Points of a fact: its kind, its source, its confidence (a null one counts as none)."""
    return (_points(kind, KIND_POINTS, OTHER_KIND) + 10 * _points(source_type, SOURCE_POINTS, 0)).cast("double") + F.coalesce(confidence, F.lit(0.0))


def fact_index(facts: DataFrame) -> DataFrame:
    """The facts with ``comparable`` (letters and digits of the value) and ``rank``; of repeats the first (``ord``) stays, facts without item, key or value go.

    Repeats agree in item, key, comparable value, kind, url and rule. A value without letters or digits is compared as it is written.
    """
    rows = with_read(facts.filter("item is not null and key is not null"), "value", clean_text, "clean").filter("clean <> ''").withColumn("value", F.col("clean")).drop("clean")
    bare = compact_key(F.col("value"))
    compared = F.when(bare == "", F.col("value")).otherwise(bare)
    keys = [compared, *[F.coalesce(F.col(c), F.lit("")) for c in ("source_kind", "source_url", "rule")]]
    # what is made of other columns is made after the exchange
    return first_of(rows, keys, ["ord"], ["item", "key"]).withColumns({"comparable": compared, "rank": fact_rank(F.col("source_kind"), F.col("source_type"), F.col("confidence"))})


def store_index(index: DataFrame, name: str, buckets: int = 64) -> DataFrame:
    """The index as a table of the warehouse, bucketed and sorted by item and key, and read again."""
    index.write.mode("overwrite").bucketBy(buckets, "item", "key").sortBy("item", "key").saveAsTable(name)
    return index.sparkSession.table(name)


def best_facts(index: DataFrame) -> DataFrame:
    """The best fact of each item and key: the greatest rank, of equal ones the first (``ord``)."""
    place = F.row_number().over(Window.partitionBy("item", "key").orderBy(-F.col("rank"), "ord"))
    return index.withColumn("_place", place).filter("_place = 1").drop("_place")


def facts_with_value(index: DataFrame, values: DataFrame) -> DataFrame:
    """asked, and the item's facts whose comparable value equals, contains or lies in that of ``values`` (item, asked), best first by ``rank``.

    The two meet by item, in which both are few; a value without letters or digits finds nothing.
    """
    wanted = values.select("item", "asked", compact_key(F.col("asked")).alias("_asked")).filter("_asked <> ''").distinct()
    return index.join(wanted, "item").filter(F.contains("comparable", F.col("_asked")) | F.contains(F.col("_asked"), F.col("comparable"))).drop("_asked")


def fact_words(index: DataFrame) -> DataFrame:
    """The inverted index: word, item, key, ord, fact, rank of the words of keys and values, each once for a fact; a key's capitals begin words.

    ``fact`` is a hash of what tells an index's facts apart, as ``ord`` may repeat.
    """
    own = F.xxhash64("item", "key", "comparable", *[F.coalesce(F.col(c), F.lit("")) for c in ("source_kind", "source_url", "rule")])
    words = F.array_distinct(F.split(F.concat_ws(" ", plain_label(F.col("key")), plain_label(F.col("value"))), " "))
    return index.select(F.explode(F.filter(words, lambda w: w != "")).alias("word"), "item", "key", "ord", own.alias("fact"), "rank")


def search_facts(words: DataFrame, questions: DataFrame) -> DataFrame:
    """question, item, key, ord, fact, hits, rank: facts that hold all the words of ``questions`` (question, text), through the inverted index."""
    words_of = F.array_distinct(F.filter(F.split(plain_label(F.col("text")), " "), lambda w: w != ""))
    asked = questions.select("question", F.explode(words_of).alias("word")).distinct()
    needed = asked.groupBy("question").agg(F.collect_set("word").alias("needed"))
    # a question is looked up by its word that fewest questions have
    shared = asked.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(shared, "word").groupBy("question").agg(F.min_by("word", F.struct("n", "word")).alias("word")).join(needed, "question")
    rarest, wanted = broadcast_if_few(rarest.select("question", "word", "needed")), broadcast_if_few(asked.select("word").distinct())
    held = words.join(wanted, "word", "left_semi").groupBy("item", "key", "ord", "fact").agg(F.collect_set("word").alias("held"), F.max("rank").alias("rank"))
    met = held.withColumn("word", F.explode("held")).join(rarest, "word").filter(F.size(F.array_except("needed", "held")) == 0)
    return met.select("question", "item", "key", "ord", "fact", F.size("needed").cast("long").alias("hits"), "rank")


def _label_rules(attributes: DataFrame, rules: DataFrame) -> DataFrame:
    """label, and the rules whose phrase is the label's most telling part; labels are matched once each."""
    spark: SparkSession = attributes.sparkSession
    phrases = rules.filter("source = 'label'").select(plain_label(F.col("name")).alias("phrase")).filter("phrase <> ''").distinct()
    table = phrases.select(F.col("phrase").alias("key"), F.lit(None).cast("string").alias("kind"), "phrase", F.lit(False).alias("exact"), F.lit(None).cast("string").alias("not_before"), F.lit(None).cast("string").alias("not_after"))
    labels = attributes.select(F.col("name").alias("doc_id")).filter("doc_id is not null").distinct()
    spans = label_spans(labels.withColumn("text", plain_label(F.col("doc_id"))), spark.createDataFrame(table.collect(), LABEL_SCHEMA) if table.isEmpty() else table)
    listed = rules.filter("source = 'label'").withColumn("phrase", plain_label(F.col("name")))
    return spans.select(F.col("doc_id").alias("label"), F.col("key").alias("phrase")).distinct().join(listed, "phrase")


def _read(value: Column, reads: Column, unit: Column, units: list[str]) -> Column:
    """A value as a column wants it: as text, as its first number, as yes or no, or as the greatest number in a unit."""
    clean = clean_text(value)
    number = F.nullif(F.regexp_extract(clean, r"(-?\d+(?:\.\d+)?)", 1), F.lit(""))
    in_unit = F.coalesce(*[F.when(unit == u, max_in_unit(value, u)) for u in units], F.lit(None).cast("double"))
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", in_unit), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(reads == "number", number).when(reads == "yes_no", F.when(clean.rlike(YES), "yes").when(clean.rlike(NO), "no")).when(reads == "unit", F.when(in_unit.isNotNull(), shown)).otherwise(F.nullif(clean, F.lit("")))


def resolve_columns(attributes: DataFrame, index: DataFrame, rules: DataFrame) -> DataFrame:
    """item, column, value, priority, rule, source_kind, source_url, confidence: the cell that the first rule with a value gives.

    ``rules`` (column, priority, source, name, reads, unit) are rows: of the source ``fact`` they name a key of the index, of ``label`` words
    of an attribute's label. ``reads`` is text, number, yes_no or unit. Of one priority the better fact counts, then the surer and earlier
    attribute. Cells keep where they come from. Rules without a column, and values that don't read, give nothing.
    """
    rules = broadcast_if_few(rules.filter("column is not null"))
    by_fact = rules.filter("source = 'fact'").join(best_facts(index).withColumnRenamed("key", "name"), "name")
    by_fact = by_fact.select("item", "column", "priority", "reads", "unit", F.concat(F.lit("fact "), "name").alias("rule"), "value", "source_kind", "source_url", "confidence", "rank", "ord")
    labelled = broadcast_if_few(_label_rules(attributes, rules))
    rows = attributes.select("item", "ord", F.col("name").alias("label"), "value", "source_url", "confidence", "source_type").join(labelled, "label")
    rank = fact_rank(F.lit("attribute"), F.col("source_type"), F.col("confidence"))
    by_label = rows.select("item", "column", "priority", "reads", "unit", F.concat(F.lit("label "), "name").alias("rule"), "value", F.lit("attribute").alias("source_kind"), "source_url", "confidence", rank.alias("rank"), "ord")
    candidates = by_fact.unionByName(by_label)
    units = sorted(r[0] for r in rules.filter("reads = 'unit' and unit is not null").select("unit").distinct().collect())  # units of measure, a bounded set
    distinct = candidates.filter("value is not null").select(F.col("value").alias("_value"), F.col("reads").alias("_reads"), F.col("unit").alias("_unit")).distinct()
    read = distinct.select("_value", "_reads", "_unit", F.explode(F.filter(F.array(_read(F.col("_value"), F.col("_reads"), F.col("_unit"), units)), lambda x: x.isNotNull())).alias("shown"))
    same = (F.col("value") == F.col("_value")) & F.col("reads").eqNullSafe(F.col("_reads")) & F.col("unit").eqNullSafe(F.col("_unit"))
    found = candidates.join(read, same).select("item", "column", F.col("shown").alias("value"), "priority", "rule", "source_kind", "source_url", "confidence", "rank", "ord")
    best = first_of(found, [F.col("column")], ["priority", -F.col("rank"), "ord", "rule"], ["item"])
    return best.select("item", "column", "value", "priority", "rule", "source_kind", "source_url", "confidence")
