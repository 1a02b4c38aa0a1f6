"""What pages offer besides text: tables of lists in scripts, urls in JSON with what stands beside them, and forms with their fields.

All work on node relations: ``json_nodes`` of ``script_json`` and ``page_nodes`` of ``page_tree``; a page is never read twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_text, compact_key

#: Names of tables of products in scripts, words of their headers, keys and shapes of urls of products.
TABLE_NAMES = ["ProductDetail_ProductVariantsTable_Metric", "ProductDetail_ProductVariantsTable_Imperial", "ProductDetail_ProductVariantsTable", "productItemsTableDataMetric", "productItemsTableDataImperial", "productItemsTableData"]
TABLE_HEADERS = r"(?i)catalog|item|part|sku|model|voltage|material|height|width|depth|length"
URL_KEYS = r"(?i)^(?:url|href|link|productUrl|product_url|detailUrl|detail_url|pdpUrl|pdp_url|itemUrl|item_url|path|route)$"
NO_URL = r"(?i)^(?:javascript|mailto|tel|data):|^[?#]|\s"
PRODUCT_PATH = r"(?i)^https?://|^/|\b(?:product|products|catalog|detail|details|pdp|sku|item|partnumber|skupage)\b|[?&](?:id|item|sku|part|product|record)="
_BLOCK = ["page_id", "ord"]


def embedded_tables(nodes: DataFrame) -> DataFrame:
    """page_id, ord, table, row, column, header, value: lists of lists in JSON whose first row names what products have; the first row isn't a row.

    Rows and columns are counted from 0; a cell beyond the headers has a null header, an empty one has no row. A list with one row is no table.
    """
    # a list in a list is a row, what lies in it are cells; a list in a row is both
    row = F.when((F.col("kind") == "list") & (F.col("lists") > 0), F.struct(F.col("parent").alias("table"), F.col("node").alias("list"), F.lit(None).cast("int").alias("node"), F.lit(None).cast("string").alias("raw")))
    cell = F.when(F.col("lists") > 1, F.struct(F.col("top").alias("table"), F.col("parent").alias("list"), F.col("node").alias("node"), F.col("value").alias("raw")))
    placed = nodes.filter("page_id is not null and ord is not null and lists > 0").repartition("page_id").select(*_BLOCK, F.explode(F.array_compact(F.array(row, cell))).alias("r")).select(*_BLOCK, "r.*")
    texts = placed.select(*_BLOCK, "table", "list", "node", F.explode(F.array(F.when(F.col("node").isNotNull(), clean_text(F.col("raw"))))).alias("text"))
    numbered = texts.withColumn("column", F.row_number().over(Window.partitionBy(*_BLOCK, "table", "list").orderBy(F.col("node").asc_nulls_first())) - 2).withColumn("row", F.dense_rank().over(Window.partitionBy(*_BLOCK, "table").orderBy("list")) - 1)
    head, of_table = F.when((F.col("row") == 0) & F.col("node").isNotNull(), F.col("text")), Window.partitionBy(*_BLOCK, "table")
    told = numbered.withColumn("_n", F.count(F.when(head != "", 1)).over(of_table)).withColumn("_told", F.max(head.rlike(TABLE_HEADERS)).over(of_table)).filter("node is not null and _n >= 2 and _told")
    headed = told.withColumn("header", F.max(head).over(Window.partitionBy(*_BLOCK, "table", "column")))
    return headed.filter("row > 0 and text <> ''").select(*_BLOCK, "table", "row", "column", "header", F.col("text").alias("value"))


def rows_of_items(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """The cells of the rows that name a page's item, for ``keys`` (page_id, item): some cell, in compact form, is the item's key."""
    wanted = keys.select("page_id", compact_key(F.col("item")).alias("_key")).filter("_key <> ''").groupBy("page_id").agg(F.collect_set("_key").alias("_keys"))
    named = tables.join(wanted.hint("merge"), "page_id").withColumn("_named", F.max(F.array_contains("_keys", compact_key(F.col("value")))).over(Window.partitionBy(*_BLOCK, "table", "row")))
    return named.filter("_named").select(*tables.columns)


def structured_urls(nodes: DataFrame) -> DataFrame:
    """page_id, ord, node, key, url, context: urls of products under telling keys of JSON objects, with the object's other texts in order."""
    url = F.regexp_replace(F.trim(F.replace("text", F.lit("&amp;"), F.lit("&"))), r"\\/", "/")
    is_url = F.coalesce(F.col("key"), F.lit("")).rlike(URL_KEYS)
    read = nodes.filter("text is not null and page_id is not null and ord is not null").select(*_BLOCK, "parent", "node", "key", "text", is_url.alias("is_url"), F.explode(F.array(F.when((F.col("kind") == "string") & is_url, url))).alias("url"))
    found = F.when(~F.col("url").rlike(NO_URL) & F.col("url").rlike(PRODUCT_PATH), F.struct("node", "key", "url"))
    objects = read.groupBy(*_BLOCK, "parent").agg(F.collect_list(found).alias("urls"), F.array_sort(F.collect_list(F.when(~F.col("is_url"), F.struct("node", "text")))).alias("parts"))
    # a text without an object around it has no key, so it is no url
    said = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    with_context = objects.filter(F.size("urls") > 0).select(*_BLOCK, "urls", clean_text(said).alias("context"))
    return with_context.select(*_BLOCK, F.explode("urls").alias("u"), "context").select(*_BLOCK, "u.node", "u.key", "u.url", "context")


def page_forms(nodes: DataFrame) -> DataFrame:
    """page_id, node, action, method, fields: the forms of pages as trees; fields are structs (name, kind, value) in order, unnamed ones go.

    A field belongs to the nearest form around it. The method is get where none, or an unknown one, is named.
    """
    attribute = lambda name: F.try_element_at("attributes", F.lit(name))
    is_form, name = F.col("tag") == "form", attribute("name")
    kind = F.lower(F.coalesce(F.when(F.col("tag") == "input", attribute("type")), F.when(F.col("tag") == "input", "text"), "tag"))
    # a form and its fields meet under the form's node
    of = F.when(is_form, F.col("node")).otherwise(F.col("form"))
    told = nodes.filter(is_form | F.col("tag").isin("input", "select", "textarea", "button") & F.col("form").isNotNull() & (name != "")).select(
        "page_id", of.alias("of"), F.when(is_form, F.struct(F.coalesce(attribute("action"), F.lit("")).alias("action"), F.lower(F.coalesce(attribute("method"), F.lit("get"))).alias("method"))).alias("head"),
        F.when(~is_form, F.struct("node", name.alias("name"), kind.alias("kind"), attribute("value").alias("value"))).alias("field"),
    )
    grouped = told.groupBy("page_id", F.col("of").alias("node")).agg(F.first("head", ignorenulls=True).alias("head"), F.array_sort(F.collect_list("field")).alias("listed"))
    shown = F.transform("listed", lambda f: F.struct(f["name"], f["kind"], f["value"]))
    return grouped.select("page_id", "node", "head.action", F.when(F.col("head.method") == "post", "post").otherwise("get").alias("method"), shown.alias("fields"))
