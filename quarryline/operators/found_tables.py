"""Tables found on pages of positioned texts: columns from the gaps in x, headers from what stands above the first key, cells over several lines.

``items`` has doc, page, text, x, x_end, y (greater is higher). Rows are clusters of y. Rows that are at least half as full as the fullest row of
their page show where columns are: the union of their items' stretches in x, split at gaps. Items of other rows, such as titles over several
columns, get every column that they touch. All steps are windows and groups within a page; null coordinates and blank texts go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.delimited import looks_like_key
from .layout import cluster

_PAGE = ["doc", "page"]


def placed_items(items: DataFrame, line: float = 3.0) -> DataFrame:
    """doc, page, text, x, x_end, y, row, full: usable items with their row from the top and whether it is one of the page's full rows."""
    rows = items.select(*_PAGE, F.trim("text").alias("text"), "x", F.greatest("x", "x_end").alias("x_end"), "y").filter("text <> '' and x is not null and y is not null")
    rows = cluster(rows, _PAGE, "y", line, "row", descending=True)
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*_PAGE, "row")))
    return counted.withColumn("full", F.col("_n") * 2 >= F.max("_n").over(Window.partitionBy(*_PAGE))).drop("_n")


def found_columns(placed: DataFrame, gap: float = 8.0) -> DataFrame:
    """doc, page, column, left, right: the columns of a page from left to right, where full rows leave no gap of more than ``gap``."""
    order = Window.partitionBy(*_PAGE).orderBy("x", "x_end")
    reached = F.max("x_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.filter("full").withColumn("_new", F.coalesce((F.col("x") > reached + gap).cast("int"), F.lit(0)))
    numbered = starts.withColumn("column", F.sum("_new").over(order).cast("int"))
    return numbered.groupBy(*_PAGE, "column").agg(F.min("x").alias("left"), F.max("x_end").alias("right"))


def _with_columns(placed: DataFrame, gap: float) -> DataFrame:
    """The items with ``columns``, the (column, left, right) of their page as in :func:`found_columns`: what full rows reach before a gap is the end of a column."""
    order = Window.partitionBy(*_PAGE).orderBy("x", "x_end")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = F.when(F.col("full"), F.col("x_end"))
    seen = placed.withColumn("_reached", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    starts = F.col("full") & F.coalesce(F.col("x") > F.col("_reached") + gap, F.col("_reached").isNull())
    met = seen.withColumns({"_lefts": F.collect_list(F.when(starts, F.col("x"))).over(whole), "_rights": F.collect_list(F.when(starts, F.col("_reached"))).over(whole), "_last": F.max(end).over(whole)})
    columns = F.transform("_lefts", lambda left, i: F.struct(i.cast("int").alias("column"), left.alias("left"), F.coalesce(F.get("_rights", i), F.col("_last")).alias("right")))
    return met.withColumn("columns", columns).drop("_reached", "_lefts", "_rights", "_last")


def table_grid(items: DataFrame, line: float = 3.0, gap: float = 8.0) -> DataFrame:
    """doc, page, row, column, text: what stands in each row and column, items from left to right; an item over several columns stands in each."""
    placed = _with_columns(placed_items(items, line), gap)
    touched = F.filter("columns", lambda c: (F.col("x") <= c["right"]) & (F.col("x_end") >= c["left"]))
    met = placed.select(*_PAGE, "row", "x", "y", "text", F.explode(touched).alias("c"))
    texts = F.sort_array(F.collect_list(F.struct("x", "y", "text")))
    return met.groupBy(*_PAGE, "row", "c.column").agg(F.array_join(F.transform(texts, lambda p: p["text"]), " ").alias("text"))


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(parts), lambda p: p["text"]), " ")


def key_rows(grid: DataFrame) -> DataFrame:
    """doc, page, record, key, column, header, value of tables whose first column names keys.

    A row with a key begins a record; rows without one continue it, so cells over several lines are joined. What stands above the first key of
    a page, line by line, is a column's header; a page without a key has no table. Without a header of its own a page has that of the
    document's last page before it, so tables go on over pages.
    """
    keyed = grid.withColumn("_key", F.when((F.col("column") == 0) & looks_like_key(F.col("text")), F.col("row")))
    order = Window.partitionBy(*_PAGE).orderBy("row").rangeBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("record", F.max("_key").over(order))
    # the key is what its own row says; continued lines of the first column belong to its value alone; cells without a record are headers
    said = F.max(F.when(F.col("_key").isNotNull(), F.col("text"))).alias("_said")
    cells = placed.groupBy(*_PAGE, "record", "column").agg(_joined(F.collect_list(F.struct("row", "text"))).alias("value"), said)
    within = Window.partitionBy(*_PAGE).orderBy("record", "column").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.withColumn("_tabled", F.max("record").over(within).isNotNull()).filter("_tabled").drop("_tabled")
    # in this order a page's headers come before its records, and a record's key before its other cells
    on = Window.partitionBy("doc").orderBy("page", "record", "column").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("record").isNull()
    marked = cells.withColumns({"key": F.last("_said", True).over(on), "_from": F.last(F.when(head, F.col("page")), True).over(on)})
    above = Window.partitionBy("doc", "column").orderBy("page", "record").rowsBetween(Window.unboundedPreceding, 0)
    rows = marked.withColumn("_head", F.last(F.when(head, F.struct("page", "value")), True).over(above)).filter("record is not null and column > 0")
    header = F.when(F.col("_head.page") == F.col("_from"), F.col("_head.value"))
    return rows.select(*_PAGE, "record", "key", "column", header.alias("header"), "value")


def key_columns(grid: DataFrame) -> DataFrame:
    """doc, page, key, label, value of tables whose header row names keys and whose first column names properties.

    The first row with two keys or more beyond the first column is the header; rows below it with a text in the first column begin a property,
    those without one continue it. A key that names two columns of a page is ambiguous and gives nothing.
    """
    heads = grid.filter((F.col("column") > 0) & looks_like_key(F.col("text")))
    first = heads.groupBy(*_PAGE, "row").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").groupBy(*_PAGE).agg(F.min("row").alias("head"))
    keys = heads.join(first, _PAGE).filter("row = head").select(*_PAGE, "head", "column", F.col("text").alias("key"))
    single = keys.groupBy(*_PAGE, F.upper("key").alias("_k")).agg(F.min("column").alias("column"), F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).filter("n = 1").select(*_PAGE, "column", "key")
    body = grid.join(first, _PAGE).filter("row > head").withColumn("_label", F.when(F.col("column") == 0, F.col("row")))
    placed = body.withColumn("record", F.max("_label").over(Window.partitionBy(*_PAGE).orderBy("row").rangeBetween(Window.unboundedPreceding, 0))).filter("record is not null")
    cells = placed.groupBy(*_PAGE, "record", "column").agg(_joined(F.collect_list(F.struct("row", "text"))).alias("value"))
    labels = cells.filter("column = 0").select(*_PAGE, "record", F.col("value").alias("label"))
    return cells.join(single, [*_PAGE, "column"]).join(labels, [*_PAGE, "record"]).select(*_PAGE, "key", "label", "value")
