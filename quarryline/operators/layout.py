"""Texts with a place: rows and columns of positioned items, contexts of a key within the lines of a document.

Items and lines are ordered by windows within their page or document; nearest headers are found by looking left and right in that
order, never by pairing all items with all headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lines kept before and after a line that names the key, and what a foreign key looks like (with a digit in it).
BEFORE, AFTER = 6, 30
FOREIGN = r"(?i)\b[A-Z0-9]{2,}(?:[-:/.][A-Z0-9]+)+\b|\b[A-Z]{2,}[0-9]{3,}\b"


def cluster(items: DataFrame, within: list[str], coordinate: str, tolerance: float, name: str, descending: bool = False) -> DataFrame:
    """Items with ``name``, the number of their cluster along a coordinate: neighbours no more than ``tolerance`` apart are one."""
    order = Window.partitionBy(*within).orderBy(F.desc(coordinate) if descending else F.col(coordinate))
    gap = F.abs(F.col(coordinate) - F.lag(coordinate).over(order)) > tolerance
    ranked = items.withColumn("_gap", F.coalesce(gap.cast("int"), F.lit(0)))
    return ranked.withColumn(name, F.sum("_gap").over(order).cast("int")).drop("_gap")


def nearest(items: DataFrame, anchors: DataFrame, within: list[str], farthest: float) -> DataFrame:
    """Items (``x``) with ``anchor``, the name of the anchor (``x``, ``anchor``) nearest to them, null beyond ``farthest``; of equal ones the left.

    Anchors and items are merged in order of x; each item looks at the last anchor before it and the first behind it.
    """
    marks = anchors.select(*within, F.col("x").alias("_x"), F.col("anchor").alias("_anchor"), F.lit(0).alias("_kind"))
    names = [c for c in items.columns]
    both = items.withColumns({"_x": F.col("x"), "_anchor": F.lit(None).cast(anchors.schema["anchor"].dataType), "_kind": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy(*within).orderBy("_x", "_kind", "_anchor")
    place = F.when(F.col("_kind") == 0, F.struct("_x", "_anchor"))
    seen = both.withColumn("_left", F.last(place, True).over(order)).withColumn("_right", F.first(place, True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    left, right = F.col("_x") - F.col("_left._x"), F.col("_right._x") - F.col("_x")
    by_left = right.isNull() | (left <= right)
    gap = F.when(by_left, left).otherwise(right)
    return seen.filter("_kind = 1").select(*names, F.when(gap <= farthest, F.when(by_left, F.col("_left._anchor")).otherwise(F.col("_right._anchor"))).alias("anchor"))


def carried_headers(pages: DataFrame) -> DataFrame:
    """doc, page, header: a page's own header, or the last one of an earlier page of the document."""
    order = Window.partitionBy("doc").orderBy("page")
    return pages.select("doc", "page", F.last("header", True).over(order).alias("header"))


def table_cells(items: DataFrame, headers: DataFrame, tolerance: float = 3.0, farthest: float = 40.0) -> DataFrame:
    """Cells of positioned tables: doc, page, row, column (its header), value (the row's items of a column, left to right, joined).

    ``items``: doc, page, text, x, y; ``headers``: doc, page, text, x. Rows are clusters of y, from the top (greatest y) on. Items near no header have a null column.
    """
    rows = cluster(items, ["doc", "page"], "y", tolerance, "row", descending=True)
    placed = nearest(rows, headers.select("doc", "page", "x", F.col("text").alias("anchor")), ["doc", "page"], farthest)
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "text"))), lambda t: t["text"]), " ")
    return placed.groupBy("doc", "page", "row", F.col("anchor").alias("column")).agg(texts.alias("value"))


def names_foreign_key(line: Column) -> Column:
    """The line has a key-shaped token of four letters and digits or more, one of them a digit."""
    tokens = F.regexp_extract_all(line, F.lit(f"({FOREIGN})"), F.lit(1))
    compact = F.transform(tokens, lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]+", ""))
    return F.exists(compact, lambda c: (F.length(c) >= 4) & c.rlike(r"\d"))


def tight_contexts(documents: DataFrame, own: Column, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """doc_id, line, text of the lines that belong to a key: those that name it (``own``, over ``text`` as a line) and their neighbours.

    The window reaches ``before`` lines up and ``after`` lines down and stops at any line that names another key. A document
    without a line of its own has no rows; rows that repeat a doc_id are taken as one document each, by their text.
    """
    lines = documents.select("doc_id", F.xxhash64("text").alias("_t"), F.posexplode(F.split("text", r"\r?\n")).alias("line", "text"))
    lines = lines.withColumns({"own": F.coalesce(own, F.lit(False))}).withColumn("foreign", ~F.col("own") & names_foreign_key(F.col("text")))
    order = Window.partitionBy("doc_id", "_t").orderBy("line")
    back, on = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    place = F.col("line")
    seen = lines.withColumns({
        "own_above": F.max(F.when(F.col("own"), place)).over(back), "foreign_above": F.max(F.when(F.col("foreign"), place)).over(back),
        "own_below": F.min(F.when(F.col("own"), place)).over(on), "foreign_below": F.min(F.when(F.col("foreign"), place)).over(on),
    })
    after_own = (place - F.col("own_above") <= after) & (F.coalesce("foreign_above", F.lit(-1)) < F.col("own_above"))
    before_own = (F.col("own_below") - place <= before) & (F.col("own_below") < F.coalesce("foreign_below", F.lit(2**31 - 1)))
    return seen.filter(F.coalesce(after_own, F.lit(False)) | F.coalesce(before_own, F.lit(False))).select("doc_id", "line", "text")


def character_windows(documents: DataFrame, needle: str, before: int = 2000, after: int = 2500) -> DataFrame:
    """doc_id, begin, end of merged stretches from ``before`` characters ahead of an occurrence to ``after`` behind its start, without regard to case.

    An occurrence inside the stretch of the one before adds none of its own. Places are counted from 0; ends stay within the text.
    """
    parts = F.split(F.lower("text"), F.lit(r"\Q" + needle.lower() + r"\E"), -1)
    step = len(needle)
    starts = F.aggregate(
        F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda s, p: F.struct((s["at"] + F.length(p) + step).alias("at"), F.concat(s["found"], F.array(s["at"] + F.length(p))).alias("found")),
    )["found"]
    kept = F.aggregate(starts, F.array().cast("array<int>"), lambda s, p: F.when((F.size(s) == 0) | (p > F.try_element_at(s, F.lit(-1)) + after), F.concat(s, F.array(p))).otherwise(s))
    rows = documents.filter(F.contains(F.lower("text"), F.lit(needle.lower()))).select("doc_id", F.length("text").alias("n"), F.explode(kept).alias("at"))
    return rows.select("doc_id", F.greatest(F.lit(0), F.col("at") - before).alias("begin"), F.least("n", F.col("at") + after).alias("end"))
