"""Extractors that are learned: the places at which a host's pages gave accepted values, and what stands there on its other pages.

A text's place is its trail (tags and classes from the root) and the text before it, its label. Pages of one host share a layout, so a
place that holds a field's accepted value on most pages where it occurs holds the field on the others too. Learning and extracting are
joins and counts; a host's pages never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_text
from .page_tree import page_nodes

#: Texts that are longer are no values or labels.
LONGEST = 300


def placed_texts(pages: DataFrame) -> DataFrame:
    """page_id, host, node, trail, label, value: the texts of (page_id, host, html), each with its trail and the text before it; empty ones go."""
    kept = page_nodes(pages).filter("tag = '#text' and length(text) <= 2000").select("page_id", "node", "trail", "text")
    cleaned = kept.select("page_id", "node", "trail", F.explode(F.filter(F.array(clean_text(F.col("text"))), lambda t: (t != "") & (F.length(t) <= LONGEST))).alias("value"))
    before = F.lag("value").over(Window.partitionBy("page_id").orderBy("node"))
    labelled = cleaned.withColumn("label", F.coalesce(F.lower(before), F.lit("")))
    # the planner takes pages for as small as their files, so it would hand all of them to every task; the same holds below
    return labelled.join(pages.select("page_id", "host").distinct().hint("merge"), "page_id").select("page_id", "host", "node", "trail", "label", "value")


def learned_extractors(texts: DataFrame, accepted: DataFrame, least_pages: int = 2, least_share: float = 0.8) -> DataFrame:
    """host, field, trail, label, n_pages, share: the best place for each field of a host, from ``accepted`` (page_id, field, value).

    ``share`` is the part of the pages with an accepted value on which the place has it. Of equal shares the place on more pages counts, then
    the smaller label and trail. Places on fewer than ``least_pages`` pages, or with a smaller share than ``least_share``, teach nothing.
    """
    taught = accepted.select("page_id", "field", F.lower(clean_text(F.col("value"))).alias("wanted")).filter("page_id is not null and field is not null and wanted <> ''").distinct()
    met = texts.join(taught.hint("merge"), "page_id").withColumn("right", F.lower("value") == F.col("wanted"))
    by_page = met.groupBy("host", "field", "trail", "label", "page_id").agg(F.max("right").alias("right"))
    places = by_page.groupBy("host", "field", "trail", "label").agg(F.count(F.when(F.col("right"), 1)).alias("n_pages"), F.count(F.lit(1)).alias("n_seen"))
    sound = places.withColumn("share", F.col("n_pages") / F.col("n_seen")).filter((F.col("n_pages") >= least_pages) & (F.col("share") >= least_share))
    best = F.min_by(F.struct("trail", "label", "n_pages", "share"), F.struct(-F.col("share"), -F.col("n_pages"), "label", "trail")).alias("b")
    return sound.groupBy("host", "field").agg(best).select("host", "field", "b.*")


def extracted(texts: DataFrame, extractors: DataFrame) -> DataFrame:
    """page_id, field, value: what stands at the learned places of a page's host; of several such texts the first."""
    found = texts.join(extractors.select("host", "field", "trail", "label"), ["host", "trail", "label"])
    return found.groupBy("page_id", "field").agg(F.min_by("value", "node").alias("value"))


def extractor_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """field, n, found, right: on pages with a known value, how many gave a value and how many gave that one."""
    known = truth.select("page_id", "field", F.lower(clean_text(F.col("value"))).alias("wanted")).distinct()
    met = known.join(found.hint("merge"), ["page_id", "field"], "left")
    return met.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("found"), F.count(F.when(F.lower("value") == F.col("wanted"), 1)).alias("right"))
