"""Pages as trees and JSON in scripts: single cases, invariants on random input, and plain versions beside them."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.operators import markup
from quarryline.operators.page_data import embedded_tables, page_forms, rows_of_items, structured_urls
from quarryline.operators.page_tree import block_texts, inside, page_nodes, read_nodes, tree_cells, tree_rows
from quarryline.operators.script_json import assigned_blocks, balanced_end, json_nodes, only_item, product_pairs, read_json, script_blocks


def pages(spark, *htmls):
    return spark.createDataFrame([(i, h, "extra") for i, h in enumerate(htmls)], "page_id long, html string, node string")


# ---------------------------------------------------------------- trees


def outline(html):
    """tag(children) of a page, texts in quotes."""
    nodes = read_nodes(html)

    def of(n):
        if n["tag"] == "#text":
            return repr(n["text"])
        inner = [of(c) for c in nodes if c["parent"] == n["node"]]
        return n["tag"] + (f"({','.join(inner)})" if inner else "")

    return ",".join(of(n) for n in nodes if n["parent"] is None)


@pytest.mark.parametrize("html, want", [
    ("<p>a<p>b", "p('a'),p('b')"), ("<div><p>a</div>b", "div(p('a')),'b'"), ("<ul><li>1<ul><li>2</ul><li>3</ul>", "ul(li('1',ul(li('2'))),li('3'))"),
    ("<table><tr><td>1<td>2<tr><th>3</table>", "table(tr(td('1'),td('2')),tr(th('3')))"), ("<table><tr><td><table><tr><td>in</table>out</table>", "table(tr(td(table(tr(td('in'))),'out')))"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "dl(dt('a'),dd('b'),dt('c'))"), ("<p>a<b>c<div>d</div>", "p('a',b('c')),div('d')"), ("a<br>b<img src=x>c", "'a',br,'b',img,'c'"), ("<script>if (a<b) '</p>'</script>x", "script(\"if (a<b) '</p>'\"),'x'"),
    ("<a title=\"x>y\" b='<p>'>t</a>", "a('t')"), ("</div><!-- <p> -->x<!doctype html>", "'x'"), ("<div", "'<div'"), ("<div><span>x", "div(span('x'))"), ("a < b", "'a < b'"), ("<td>x</div>y", "td('x','y')"), ("<p/>x", "p('x')"), ("<svg><path/>x</svg>", "svg(path,'x')"), ("", ""),
    ("<table><thead><tr><td>h<tbody><tr><td>b</table>", "table(thead(tr(td('h'))),tbody(tr(td('b'))))"), ("<!-- open", ""), ("<style>p{}", "style('p{}')"),
])
def test_outline(html, want):
    assert outline(html) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "x", "<br>", "<script>", "</script>", "<!--", "-->", "<"]), max_size=25))
def test_numbers_are_a_tree(parts):
    html = "".join(parts)
    nodes = read_nodes(html)
    above = []
    for i, n in enumerate(nodes):
        assert n["node"] == i and n["begin"] <= n["end"] <= len(html) and i <= n["last"] < len(nodes)
        while above and above[-1]["last"] < i:
            above.pop()
        assert n["parent"] == (above[-1]["node"] if above else None) and n["depth"] == len(above)
        for name, tags in (("cell", ("td",)), ("row", ("tr",)), ("grid", ("table",)), ("block", ("p", "div", "table", "tr", "td", "li", "ul"))):
            assert n[name] == next((a["node"] for a in reversed(above) if a["tag"] in tags), None)
        above.append(n)


def test_deep_page():
    nodes = read_nodes("<b>" * 5000 + "x")
    assert len(nodes) == 5001 and nodes[-1]["depth"] == 5000 and nodes[0]["last"] == 5000


def test_relations_of_trees(spark):
    nodes = page_nodes(pages(spark, "<div id=a Data-X='1'>one <b>two</b><p>three</p> four</div>", None, "", "<table><tr><th>A<td>b<table><tr><td>in</table>c</table>"))
    assert sorted((r.page_id, r.tag, r.text) for r in block_texts(nodes).collect()) == [(0, "div", "one two four"), (0, "p", "three"), (3, "td", "bc"), (3, "td", "in"), (3, "th", "A")]
    assert sorted((r.page_id, r.cells) for r in tree_rows(nodes).collect()) == [(3, ["A", "bc"]), (3, ["in"])]
    assert nodes.filter("tag = 'div'").first().attributes == {"id": "a", "data-x": "1"}
    assert inside(nodes.filter("tag = 'div'"), nodes.filter("tag <> '#text'")).select("tag").orderBy("tag").collect() == [("b",), ("p",)]
    assert tree_cells(nodes.filter("false")).count() == 0 and page_nodes(pages(spark)).count() == 0


def test_pairs_of_nested_blocks_once(spark):
    got = markup.text_pairs(pages(spark, "<div><p>Voltage: 5 V</p></div><ul><li>Weight: 2 kg<li><div>Width: 3 mm</div></ul>", None))
    assert sorted((r.name, r.value) for r in got.collect()) == [("Voltage", "5 V"), ("Weight", "2 kg"), ("Width", "3 mm")]


# ---------------------------------------------------------------- JSON


def plain_end(text, start):
    opening, closing = text[start], {"{": "}", "[": "]"}[text[start]]
    depth, quoted, skip = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == opening) - (c == closing)
            if depth == 0:
                return i + 1
    return None


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='{}[]"\\a', max_size=30))
def test_balanced_end(text):
    for start, c in enumerate(text):
        if c in "{[":
            assert balanced_end(text, start) == plain_end(text, start)


def test_assigned_blocks(spark):
    text = 'x = {"a": "}"}; window.productData = {"a": "}\\"{", "b": [1]} ; dataLayer.push([{"c": "]"}]); utag_data = {"cut": ['
    found = assigned_blocks(text, ["productData", "window.productData", "dataLayer.push", "utag_data"])
    assert [(m, text[b:e] if e else None) for m, b, e in found] == [("window.productData", '{"a": "}\\"{", "b": [1]}'), ("dataLayer.push", '[{"c": "]"}]'), ("utag_data", None)]
    rows = script_blocks(pages(spark, text, None, "window.productData"), ["window.productData", "utag_data"]).orderBy("begin").collect()
    assert [(r.page_id, r.marker, r.complete, r.block is None) for r in rows] == [(0, "window.productData", True, False), (0, "utag_data", False, True)]


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=3), v, max_size=3), max_leaves=12)


def built(nodes):
    """The value that the nodes of a JSON text stand for."""
    made = {}
    for n in reversed(nodes):
        inner = [c for c in nodes if c["parent"] == n["node"]]
        if n["kind"] == "object":
            made[n["node"]] = {c["key"]: made[c["node"]] for c in inner}
        elif n["kind"] == "list":
            made[n["node"]] = [made[c["node"]] for c in inner]
        else:
            made[n["node"]] = n["text"] if n["kind"] == "string" else None if n["kind"] == "null" else json.loads(n["text"])
        assert n["last"] == max([n["node"], *[c["last"] for c in inner]])
    return made[0]


@settings(max_examples=300, deadline=None)
@given(JSON, st.booleans())
def test_json_nodes_stand_for_the_value(value, spaced):
    text = json.dumps(value, indent=2 if spaced else None, ensure_ascii=spaced)
    inner = json.dumps(value)
    assert built(read_json(text)) == json.loads(text) or '"[' in text or '"{' in text
    if inner[0] in "[{":
        assert built(read_json(json.dumps({"k": [inner]}))) == {"k": [json.loads(inner)]}


@pytest.mark.parametrize("text", ["", "{", "[1,]", "{,}", '{"a" 1}', '{"a":1,}', "[1 2]", "1 2", "[}", "tru", "'a'", "{a:1}", "[1]]", "01", '"a\nb"', "[,1]", '{"a":}', "undefined"])
def test_what_is_no_json_has_no_nodes(text):
    assert read_json(text) == []


def test_depth_has_no_bound(spark):
    deep = "[" * 20000 + '{"label":"Voltage","value":"5 V"}' + "]" * 20000
    nodes = read_json("[" * 20000 + "1" + "]" * 20000)
    assert len(nodes) == 20001 and nodes[0]["last"] == 20000 and nodes[-1]["depth"] == 20000
    blocks = spark.createDataFrame([(1, 0, deep)], "page_id long, ord int, json string")
    assert [(r.name, r.value) for r in product_pairs(json_nodes(blocks)).collect()] == [("Voltage", "5 V")]


def found_pairs(spark, value, item=None):
    nodes = json_nodes(spark.createDataFrame([(1, 0, json.dumps(value) if not isinstance(value, str) else value, "x")], "page_id long, ord int, json string, node string"))
    if item is not None:
        nodes = only_item(nodes, spark.createDataFrame([(1, item)], "page_id long, item string"))
    return sorted((r.shape, r.name, r.value) for r in product_pairs(nodes).collect())


@pytest.mark.parametrize("value, want", [
    ({"features": [{"name": "Width", "value": 5, "unit": "mm"}, {"label": "Height", "displayValue": "6 mm", "unit": "mm"}]}, [("pair", "Height", "6 mm"), ("pair", "Width", "5 mm")]),
    ([{"title": "Range", "min": 1, "max": 2, "uom": "V"}, {"title": "Least", "minimum": "3"}, {"title": "Most", "maxValue": 4}], [("pair", "Least", ">= 3"), ("pair", "Most", "<= 4"), ("pair", "Range", "1...2 V")]),
    ({"key": "Size", "value": {"formatted": "9", "unit": "kg"}}, [("pair", "Size", "9 kg")]), ({"key": "Kinds", "values": ["a", {"label": "b"}, "a", None]}, [("pair", "Kinds", "a; b")]),
    ({"x": {"specs": {"ratedVoltage": "5 V", "_no": 1, "id": 7, "thing": {"value": 2, "unit": "A"}, "list": [1, 2], "none": None, "deep": {"more": {"technicalData": {"net_weight": "3 kg"}}}}}}, [("map", "List", "1; 2"), ("map", "Net weight", "3 kg"), ("map", "Rated Voltage", "5 V"), ("map", "Thing", "2 A")]),
    ({"languages": {"specs": {"a": "b"}}, "specs": {"name": "N", "value": "v"}}, [("pair", "N", "v")]), ({"a": "{\"attributes\": {\"colour\": \"red &amp; blue\"}}"}, [("map", "Colour", "red & blue")]),
    ([{"name": "A", "value": "x"}, {"name": "a", "value": "X"}], [("pair", "A", "x")]), ("not json", []), ({}, []), ({"name": "", "value": "x"}, []),
])
def test_product_pairs(spark, value, want):
    assert found_pairs(spark, value) == want


def test_only_the_item_of_a_list(spark):
    record = lambda k: {"sku": k, "specs": {"for": k}}
    value = {"list": [record("AB-1"), record("AB-2"), "other", {"specs": {"for": "none"}}], "alone": [record("ZZ-9")], "specs": {"site": "s"}}
    keep = [("map", "For", "ZZ-9"), ("map", "Site", "s")]
    assert found_pairs(spark, value, "ab 1") == sorted([("map", "For", "AB-1"), *keep])
    everything = sorted([("map", "For", "AB-1"), ("map", "For", "AB-2"), ("map", "For", "none"), *keep])
    assert found_pairs(spark, value, "other") == everything and found_pairs(spark, value, "") == everything


def test_null_and_empty_blocks(spark):
    assert json_nodes(spark.createDataFrame([(1, 0, None), (2, 0, ""), (3, 0, "[]")], "page_id long, ord int, json string")).select("page_id", "kind").collect() == [(3, "list")]


# ---------------------------------------------------------------- tables, urls and forms


def nodes_of(spark, value):
    return json_nodes(spark.createDataFrame([(1, 0, json.dumps(value))], "page_id long, ord int, json string"))


@pytest.mark.parametrize("value, want", [
    ([["Part", "Width"], ["A", "1"], ["B"], [], ["C", "", "3"]], [(1, 0, "Part", "A"), (1, 1, "Width", "1"), (2, 0, "Part", "B"), (4, 0, "Part", "C"), (4, 2, None, "3")]), ([["Part", "Width"]], []), ([["x", "y"], ["1", "2"]], []), ([["Part"], ["1"]], []),
    ({"deep": [{"t": [["Item no", {"label": "Height"}], ["A", {"value": 5, "unit": "mm"}]]}]}, [(1, 0, "Item no", "A"), (1, 1, "Height", "5 mm")]), ([["Part", "Width"], "no row", ["A", ["1", "2"]]], [(1, 0, "Part", "A"), (1, 1, "Width", "1; 2")]), ([], []),
])
def test_tables_of_lists(spark, value, want):
    got = embedded_tables(nodes_of(spark, value)).select("row", "column", "header", "value").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_rows_of_an_item(spark):
    tables = embedded_tables(nodes_of(spark, [["Part", "Width"], ["A-1", "1"], ["A-12", "2"], ["a 1", "3"]]))
    keys = spark.createDataFrame([(1, "A1"), (1, ""), (1, None), (2, "A12")], "page_id long, item string")
    assert sorted(r["value"] for r in rows_of_items(tables, keys).collect()) == ["1", "3", "A-1", "a 1"]


def test_urls_beside_texts(spark):
    value = [{"url": "/a", "name": "n", "deep": {"pdpUrl": "https:\\/\\/x.example/b", "t": 1}}, {"href": "mailto:x", "link": "#y", "path": "no product here", "route": "sku-1"}, {"Url": None, "URL": "/c"}, "/d"]
    assert sorted((r.key, r.url, r.context) for r in structured_urls(nodes_of(spark, value)).collect()) == [("URL", "/c", ""), ("pdpUrl", "https://x.example/b", "1"), ("route", "sku-1", ""), ("url", "/a", "n")]


def test_forms(spark):
    html = "<form method=PUT><input name=a><div><form action=/in><input name=b type=radio value=1></form></div><select name=c></select><input name=''></form><form></form>"
    got = page_forms(page_nodes(pages(spark, html, None))).orderBy("node").collect()
    assert [(r.action, r.method, [tuple(f) for f in r.fields]) for r in got] == [("", "get", [("a", "text", None), ("c", "select", None)]), ("/in", "get", [("b", "radio", "1")]), ("", "get", [])]


# ---------------------------------------------------------------- growth


def big_pages(spark, page, n=40):
    from quarryline.sources import analogues

    rows = [(k, f"part {k}", "Brand#1", "SMALL STEEL", k % 50, 1.0) for k in range(n)]
    return getattr(analogues, page)(spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1))


@pytest.mark.parametrize("page", ["spec_page", "nested_table_page", "state_page", "offer_page"])
def test_pages_written_over_one_split_are_spread(spark, page):
    assert big_pages(spark, page).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_page_goes_to_every_task_and_none_is_read_twice(spark):
    nodes, offers = page_nodes(big_pages(spark, "nested_table_page")), big_pages(spark, "offer_page")
    blocks = script_blocks(offers, ["productItemsTableData", "window.productData"]).filter("complete").selectExpr("page_id", "begin AS ord", "block AS json")
    tables, keys = embedded_tables(json_nodes(blocks)), offers.select("page_id", "item")
    made = [block_texts(nodes), tree_rows(nodes), tables, rows_of_items(tables, keys), structured_urls(json_nodes(blocks)), page_forms(page_nodes(offers)), product_pairs(only_item(json_nodes(blocks), keys))]
    for frame in made:
        assert "BroadcastHashJoin" not in plan_of(frame) and "BroadcastNestedLoopJoin" not in plan_of(frame)
        assert plan_of(frame).count("MapInArrow") <= 2
    assert "BroadcastHashJoin" not in plan_of(inside(nodes, nodes))


def test_json_nodes_of_many_pages_keep_their_page(spark):
    blocks = spark.createDataFrame([(k, k % 2, json.dumps(list(range(k % 7)) + ["\ud800"])) for k in range(9000)], "page_id long, ord int, json string").coalesce(1)
    got = {(r.page_id, r.ord, r.n) for r in json_nodes(blocks).groupBy("page_id", "ord").count().withColumnRenamed("count", "n").collect()}
    assert got == {(k, k % 2, k % 7 + 2) for k in range(9000)}


def test_records_in_lists_of_lists_and_several_blocks(spark):
    text = json.dumps([[{"sku": "A1", "specs": {"for": "A1"}}, {"sku": "B2", "specs": {"for": "B2"}, "list": [{"sku": "C3", "specs": {"in": "B2"}}, {"sku": "A1", "specs": {"in": "B2 too"}}]}]])
    blocks = spark.createDataFrame([(1, 0, text), (1, 1, text), (2, 0, text), (3, 0, text)], "page_id long, ord int, json string")
    nodes = only_item(json_nodes(blocks), spark.createDataFrame([(1, "a1"), (2, "zz"), (2, "b2")], "page_id long, item string"))
    got = sorted((r.page_id, r.ord, r.value) for r in product_pairs(nodes).collect())
    everything = ["A1", "B2", "B2", "B2 too"]
    assert got == [(1, 0, "A1"), (1, 1, "A1"), (2, 0, "B2"), (2, 0, "B2"), (2, 0, "B2 too"), *[(3, 0, v) for v in everything]]
