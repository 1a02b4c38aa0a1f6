"""Product relations laid over the given tables, so that operators on attributes run on whole tables.

The rules are stated here once as columns; the queries' SQL states them again on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of a part at most, on average: the sorts of pages of as many lines take about 670 MB of a task.
ROWS_OF_PART = 250_000


def spread(rows: DataFrame, key: str, most: int = ROWS_OF_PART) -> DataFrame:
    """The rows in as many parts as the session shuffles into: a narrow table is a file of few splits, and what is written over it is wide.

    Larger tables get more parts, of ``most`` rows on average, so that what a task sorts doesn't grow with the table. Counting a table's rows reads only its files' footers.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, -(-rows.count() // most)), key)


LABELS = ["Rated voltage", "Rated current", "Net weight", "Width", "Operating temperature", "Housing material", "Degree of protection", "Approvals", "Colour", "Frobnication index"]


def spec_attributes(lineitem: DataFrame) -> DataFrame:
    """Line items as a part's attributes: item, ord, name, value, source_url, source_type, parser, stage, confidence."""
    q = F.col("l_quantity").cast("int").cast("string")
    k = ((F.col("l_suppkey") + F.col("l_linenumber")) % 10).cast("int")
    values = [
        F.concat(q, F.lit(" V DC ±"), (F.round(F.col("l_tax") * 100).cast("int") + 1).cast("string"), F.lit("%")), F.concat(q, F.lit(" A at 40 °C")), F.concat(q, F.lit(" kg")), F.concat(q, F.lit(" mm")),
        F.concat(F.lit("-"), q, F.lit(" to "), (q.cast("int") + 20).cast("string"), F.lit(" °C")), F.element_at(F.array(F.lit("Steel"), F.lit("Aluminium"), F.lit("Plastic")), q.cast("int") % 3 + 1),
        F.concat(F.lit("IP"), (F.lit(20) + q.cast("int")).cast("string")), F.lit("UL, CE"), F.concat(F.lit("RAL "), (F.lit(7000) + q.cast("int")).cast("string")), F.concat(q, F.lit(" W")),
    ]
    parser = F.when(F.col("l_linenumber") == 1, "customer-document").when(F.col("l_linenumber") == 2, "pdf-table").when(F.col("l_linenumber") == 3, "browser-network").otherwise("generic")
    kind = F.when(F.col("l_returnflag") == "A", "official").when(F.col("l_returnflag") == "N", "official-fallback").otherwise("distributor")
    written = values[-1]
    for n, value in reversed(list(enumerate(values[:-1]))):
        written = F.when(k == n, value).otherwise(written)
    # exploded, so that filters and joins on a value don't write it anew for each use
    return lineitem.select(
        F.col("l_partkey").alias("item"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.element_at(F.array(*map(F.lit, LABELS)), k + 1).alias("name"),
        F.explode(F.array(written)).alias("value"), F.concat(F.lit("https://s"), (F.col("l_suppkey") % 5).cast("string"), F.lit(".example/"), F.col("l_partkey").cast("string")).alias("source_url"),
        kind.alias("source_type"), parser.alias("parser"), F.lit("scan").alias("stage"), F.round(1 - F.col("l_discount"), 2).alias("confidence"),
    )


def spec_page(part: DataFrame) -> DataFrame:
    """A page (page_id, html) for each part, with a table, a definition list, JSON-LD, data attributes, images and hidden text."""
    name, size, price = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    key = F.col("p_partkey").cast("string")
    html = F.concat(
        F.lit('<html lang="en"><head><title>'), name, F.lit("</title><link rel='canonical' href='https://shop.example/p/"), key,
        F.lit('\'><script type="application/ld+json">{"@context":"x","@graph":[{"@type":"Product","sku":"'), key, F.lit('","name":"'), name, F.lit('","brand":{"name":"'), F.col("p_brand"),
        F.lit('"}},{"@type":"BreadcrumbList","itemListElement":[{"position":1,"item":{"@id":"/c","name":"All"}},{"position":2,"item":{"@id":"/p/'), key,
        F.lit('","name":"Leaf"}}]}]}</script></head><body><table class="specs"><tr><th>Width</th><td>'), size, F.lit(" mm</td></tr><tr><TD>Part price</TD><td>"), price,
        F.lit("</td><td>EUR</td></tr><tr><td>alone</td></tr></table><dl><dt>Brand &amp; model</dt> <dd>"), F.col("p_brand"), F.lit("</dd><dt>Product type</dt><dd><b>"), F.col("p_type"),
        F.lit('</b></dd></dl><div data-part-number="'), key, F.lit('" data-weight=\''), size, F.lit(' kg\' hidden>Weight: '), size,
        F.lit(' kg</div><img src="/i/'), key, F.lit('.jpg" srcset="/i/'), key, F.lit('-1.webp 1x, /i/'), key, F.lit('-2.webp 2x"><a href="/files/'), key, F.lit('.pdf">Datasheet</a><p>Voltage: '), size, F.lit(" V</p></body></html>"),
    )
    return spread(part, "p_partkey").select(F.col("p_partkey").alias("page_id"), html.alias("html"))


def nested_table_page(part: DataFrame) -> DataFrame:
    """A page for each part with a table in a table's cell, left-out end tags, a paragraph inside a block, and markup in a script's string."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    html = F.concat(
        F.lit("<body><script>var t='</p><table>';</script><div>Kind: <b>"), F.col("p_type"), F.lit("</b><p>Voltage: "), size, F.lit(" V<p>Weight: "), size, F.lit(" kg<ul><li>One<li>Two: "), key,
        F.lit("</ul>tail</div><table><tr><th>Outer<td>A "), F.col("p_brand"), F.lit("<table><tr><td>Inner<td>"), key, F.lit("</table> B<tr><td>Last</td><td>x &amp; y<br>z</table></body>"),
    )
    return spread(part, "p_partkey").select(F.col("p_partkey").alias("page_id"), html.alias("html"))


def state_page(part: DataFrame) -> DataFrame:
    """A page for each part whose scripts hold its data: brackets in strings, JSON in a string, another part's record, and a block that is cut off."""
    size, key, other = F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), (F.col("p_partkey") + 1).cast("string")
    record = lambda k: F.concat(F.lit('{"sku":"P-'), k, F.lit('","specifications":{"netWeight":"'), size, F.lit(' kg","wallThickness":{"value":'), size, F.lit(',"unit":"mm"},"url":"/x","sizes":["a","b","a"]},"features":[{"label":"For part","value":"'), k, F.lit('"},{"name":"Range","minValue":1,"maxValue":"'), size, F.lit('","unit":"V"}]}'))
    html = F.concat(
        F.lit('<script>var a = "}"; window.__INITIAL_STATE__ = {"note":"} ] \\" {","deep":[[[{"product":{"list":['), record(key), F.lit(","), record(other),
        F.lit(']}}]]],"config":"{\\"attributes\\":{\\"mainColour\\":\\"'), F.col("p_brand"), F.lit('\\"}}"};</script><script>dataLayer.push({"cut":[1,{"a":"'), key, F.lit('"}]</script>'),
    )
    return spread(part, "p_partkey").select(F.col("p_partkey").alias("page_id"), html.alias("html"), F.concat(F.lit("p_"), key).alias("item"))


def spec_prose(lineitem: DataFrame) -> DataFrame:
    """Line items as prose (doc_id, text) that names specifications, some within others' labels, some ruled out, some without a quantity."""
    q = F.col("l_quantity").cast("int").cast("string")
    tail = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Short-circuit breaking capacity Icu: "), q, F.lit(" kA."))).otherwise("The tightening torque is not given.")
    text = F.concat(
        F.lit("Its Rated control circuit\nvoltage is "), q, F.lit(" V DC, the insulation voltage: "), q, F.lit("0 V; leakage current of "), q, F.lit(" mA at 40 °C while the net weight (packed) amounts to about "), q,
        F.lit(" kg. The coil resistance, control voltage "), q, F.lit(" V. Operating temperature -"), q, F.lit(" to 60 °C. "), tail,
    )
    return lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), text.alias("text"))


def offer_page(part: DataFrame) -> DataFrame:
    """A page for each part with a table of lists and urls in a script, and two forms, one inside a block."""
    size, key, other = F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), (F.col("p_partkey") + 1).cast("string")
    html = F.concat(
        F.lit('<script>var x = {"productItemsTableData": [["Part","Width","Note"],["P-'), key, F.lit('",'), size, F.lit(',"a, b"],["P-'), other, F.lit('","x","",5]]};'),
        F.lit('window.productData = {"list":[{"name":"'), F.col("p_name"), F.lit('","sku":"P-'), key, F.lit('","url":"/p/'), key, F.lit('?a=1&amp;b=2"},{"href":"javascript:go()","name":"no"},{"link":"item-'), other, F.lit('.html","name":"next"}],"path":"x y"};</script>'),
        F.lit("<form action='/find'><input name=q value='"), key, F.lit("'><input type=HIDDEN name=lang value=en><input type=submit></form><div><form method=POST action='/cart'><select name=qty><option>1</select><textarea name=note></textarea></form></div>"),
    )
    return spread(part, "p_partkey").select(F.col("p_partkey").alias("page_id"), html.alias("html"), F.concat(F.lit("p "), key).alias("item"))
