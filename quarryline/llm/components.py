"""Connected components of a table of links, by smallest-label spreading with jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node that has a link; the label is the smallest node of its component.

    ``links`` has columns a and b. In each round a node takes the smallest label among its own and its neighbours',
    then its label's label; both are joins and grouped minima, so a hub's links are pre-aggregated, and the number
    of rounds grows with the logarithm of the longest path. Labels are cut from their lineage each round.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = spread.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        new = cut(jumped.select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        changed = new.filter("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
