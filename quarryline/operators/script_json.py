"""Data in scripts: balanced JSON after assignments, JSON as a relation of nodes of any depth, and names with values at any depth.

A scanner that knows strings and escapes finds where an assigned block ends, which no pattern can count. ``json_nodes`` opens JSON texts
token by token, without recursion, so depth has no bound; what follows (values, pairs, maps of specifications, the record of one item
among others) is joins and groups over node numbers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_text, compact_key

#: What stands before embedded state in scripts.
MARKERS = [
    "window.__NUXT__", "window.__INITIAL_STATE__", "window.__APOLLO_STATE__", "window.__PRELOADED_STATE__", "window.__PRODUCT_DATA__", "window.productData", "window.product", "window.digitalData",
    "digitalData", "utag_data", "dataLayer.push", "gtag(", "gtag (", "productData", "__NEXT_DATA__", "__ASTRO_DATA__",
]
#: Keys of names, values, units and ends, in the order in which they are tried.
NAME_KEYS = ["characteristicName", "attributeName", "propertyName", "specName", "attributeLabel", "propertyLabel", "specLabel", "label", "name", "title", "key", "displayName"]
VALUE_KEYS = ["value", "labelText", "displayValue", "valueText", "formattedValue", "formatted", "text", "specValue", "propertyValue", "rawValue", "selectedValue"]
HOLDER_KEYS = ["selected", "option", "value", "displayValue", "formattedValue", "data"]
LIST_KEYS = ["values", "valueList", "displayValues", "options", "items", "characteristicValues"]
INNER_KEYS = ["value", "formatted", "displayValue", "labelText", "label", "name", "text"]
UNIT_KEYS = ["unit", "unitText", "unitOfMeasure", "uom", "unitCode", "symbol"]
MIN_KEYS, MAX_KEYS = ["minValue", "minimumValue", "min", "minimum"], ["maxValue", "maximumValue", "max", "maximum"]
IDENTITY_KEYS = ["sku", "mpn", "catalogNumber", "catalogNo", "catalog", "partNumber", "partNo", "productId", "productID", "articleNumber", "articleNo", "itemNumber", "itemNo", "orderNumber", "model", "modelCode"]
#: Keys whose object is a map of specifications, keys that such a map doesn't mean, and paths of a site's own state.
SPEC_MAPS = r"(?i)^(?:specs?|specifications?|technicalSpecifications?|technicalData|attributes?|properties|characteristics?|parameters?|productAttributes?|productDetails?)$"
NO_SPECS = r"(?i)^(?:_.*|id|uuid|url|href|links?|images?|documents?|downloads?|resources?)$"
SYSTEM = r"(?i)(?:^| / )(?:languages?|ajaxPageState|region_manager|back_to_top|ckeditorAccordion|permissionsHash|theme_token|pluralDelimiter)(?: / |$)"

_OPENING = re.compile(r"[{\[]")
_STRUCTURE = re.compile(r'["\\{}\[\]]')


def balanced_end(text: str, start: int) -> int | None:
    """Where the bracket at ``start`` is closed (the place after it); None where the text ends before.

    Brackets in double-quoted strings don't count, nor what follows a backslash; only brackets of the opening kind are counted.
    """
    opening = text[start]
    closing, depth, quoted, at = ("}" if opening == "{" else "]"), 0, False, start
    while found := _STRUCTURE.search(text, at):
        sign, at = found[0], found.end()
        if sign == "\\":
            at += 1
        elif sign == '"':
            quoted = not quoted
        elif not quoted and sign == opening:
            depth += 1
        elif not quoted and sign == closing:
            depth -= 1
            if depth == 0:
                return at
    return None


@cache
def _any_of(markers: tuple[str, ...]) -> re.Pattern:
    """Any of the markers, longer ones first."""
    return re.compile("|".join(map(re.escape, sorted(markers, key=len, reverse=True))))


def assigned_blocks(text: str, markers: list[str]) -> list[tuple[str, int, int | None]]:
    """(marker, begin, end) of the block after each place of a marker, each begin once under its longest marker; end None where it is cut off."""
    found: dict[int, tuple[str, int | None]] = {}
    for place in _any_of(tuple(markers)).finditer(text):
        opening = _OPENING.search(text, place.end())
        if opening and opening.start() not in found:
            found[opening.start()] = (place[0], balanced_end(text, opening.start()))
    return [(marker, begin, end) for begin, (marker, end) in found.items()]


#: Characters of blocks that a task sends at once; a longer block makes a batch of its own.
_CHARACTERS = 1 << 20


def script_blocks(pages: DataFrame, markers: list[str] = MARKERS) -> DataFrame:
    """page_id, marker, begin, end, complete, block: brackets assigned in a page (page_id, html), with their place in it.

    A block that the page cuts off has no end, is not complete and has no text. Places before scripts and in attributes count too, as a
    page may be a script itself. A null page has none.
    """
    kind = dict(pages.dtypes)["page_id"]

    names = ["page_id", "marker", "begin", "end", "complete", "block"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type, rows, size = batch.schema.field("page_id").type, [], 0

            def packed() -> pa.RecordBatch:
                types = (id_type, pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

            for page_id, text in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                for marker, begin, end in assigned_blocks(text or "", markers):
                    rows.append((page_id, marker, begin, end, end is not None, text[begin:end] if end else None))
                    size += (end or begin) - begin
                    if size >= _CHARACTERS:
                        yield packed()
                        rows, size = [], 0
            if rows:
                yield packed()

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, marker string, begin int, end int, complete boolean, block string")


_JSON = re.compile(r'\s*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null)(?=[\s,\]}]|\Z))')


#: A string that may hold JSON itself.
_INNER = re.compile(r"\s*[{\[]")


def _unquoted(string: str) -> str:
    """What a string of JSON says; only one with a backslash needs decoding."""
    return json.loads(string, strict=False) if "\\" in string else string[1:-1]


def read_json(text: str) -> list[dict]:
    """The nodes of a JSON text in document order; none where it isn't JSON. Strings that hold JSON objects or lists are opened in their place."""
    nodes: list[dict] = []
    stack: list[tuple[int, bool]] = []  # open nodes, and whether each is an object
    counts: list[int] = []  # the members so far of each open node
    key, expects, at = None, "value", 0

    def add(kind: str, value: str | None) -> int:
        number, parent, path, place = len(nodes), None, "", ""
        if stack:
            parent, named = stack[-1]
            path, place, step = nodes[parent]["path"], nodes[parent]["place"], key if named else str(counts[-1])
            counts[-1] += 1
            place = f"{place} / {step}" if place else step
            path = path if not named else f"{path} / {step}" if path else step
        nodes.append({"node": number, "parent": parent, "depth": len(stack), "last": number, "key": key, "path": path, "place": place, "kind": kind, "text": value})
        return number

    def opened(value: str) -> bool:
        """Puts the nodes of a string that holds JSON below this place."""
        if not _INNER.match(value):
            return False
        inner = read_json(value)
        if not inner:
            return False
        base = len(nodes)
        root = add(inner[0]["kind"], None)
        nodes[root]["last"] = base + inner[0]["last"]
        for n in inner[1:]:
            under = {c: f"{nodes[root][c]} / {n[c]}" if nodes[root][c] and n[c] else nodes[root][c] or n[c] for c in ("path", "place")}
            nodes.append({**n, "node": n["node"] + base, "parent": n["parent"] + base, "last": n["last"] + base, "depth": n["depth"] + len(stack), **under})
        return True

    text = text.rstrip(" \t\n\r")
    while at < len(text):
        m = _JSON.match(text, at)
        if not m:
            return []
        at = m.end()
        mark, string, scalar = m.groups()
        if mark in ("{", "[") and expects in ("value", "first"):
            stack.append((add("object" if mark == "{" else "list", None), mark == "{"))
            counts.append(0)
            key, expects = None, "open" if mark == "{" else "first"
        elif mark in ("}", "]") and stack and stack[-1][1] == (mark == "}") and expects in ("more", "open" if mark == "}" else "first"):
            nodes[stack.pop()[0]]["last"] = len(nodes) - 1
            counts.pop()
            expects = "more"
        elif mark == "," and expects == "more" and stack:
            key, expects = None, "key" if stack[-1][1] else "value"
        elif mark == ":" and expects == "colon":
            expects = "value"
        elif string and expects in ("key", "open"):
            key, expects = _unquoted(string), "colon"
        elif (string or scalar) and expects in ("value", "first"):
            value = _unquoted(string) if string else scalar
            if not (string and opened(value)):
                add("string" if string else "null" if scalar == "null" else "boolean" if scalar in ("true", "false") else "number", None if scalar == "null" else value)
            expects = "more"
        else:
            return []
        if not stack and at < len(text):
            return []
    return nodes if nodes and not stack and expects == "more" else []


def _ends(low: str | None, high: str | None) -> str | None:
    return f"{low}...{high}" if low is not None and high is not None else f">= {low}" if low is not None else f"<= {high}" if high is not None else None


def _with_unit(value: str, unit: str | None) -> str:
    """The value with its unit, unless it ends with it already."""
    return f"{value} {unit}" if unit and not value.lower().endswith(unit.lower()) else value


def add_values(nodes: list[dict]) -> None:
    """Gives each node its shape and, from the leaves up, its value: a scalar's text, an object's value or ends with their unit, a list's values once each, joined by ``; ``."""
    below: dict[int, list[dict]] = {}
    for n in reversed(nodes):
        inner = below.pop(n["node"], [])[::-1]
        n["shape"], n["value"] = ("scalar" if n["kind"] not in ("object", "list") else n["kind"]), n["text"]
        if n["kind"] == "list":
            said = list(dict.fromkeys(" ".join(c["value"].split()) for c in inner if c["value"] is not None and c["kind"] != "list"))
            n["value"] = "; ".join(filter(None, said)) or None
        elif n["kind"] == "object":
            told = {}
            for c in inner:
                if c["text"] is not None:
                    told.setdefault(c["key"], c["text"])
            first = lambda keys: next((told[k] for k in keys if k in told), None)
            value = _ends(first(MIN_KEYS), first(MAX_KEYS)) or first(INNER_KEYS)
            n["value"] = None if value is None else _with_unit(value, first(UNIT_KEYS))
        if n["parent"] is not None:
            below.setdefault(n["parent"], []).append(n)
    for n in nodes:
        n["lists"] = 0
        if n["parent"] is not None:
            above = nodes[n["parent"]]
            n["parent_key"], n["parent_path"], n["top"] = above["key"], above["path"], above["parent"]
            if above["kind"] == "list":
                n["lists"] = above["lists"] + 1


_TYPES = {"node": pa.int32(), "parent": pa.int32(), "depth": pa.int32(), "last": pa.int32(), **dict.fromkeys(("key", "path", "place", "kind", "text", "shape", "value", "parent_key", "parent_path"), pa.string()), "top": pa.int32(), "lists": pa.int32()}


def json_nodes(blocks: DataFrame) -> DataFrame:
    """JSON texts (page_id, ord, json) as rows of their nodes; texts that aren't JSON have none.

    page_id, ord, node, parent, depth, last, key, path, place, kind, text (of scalars), shape (scalar, object or list), value (of small records and
    lists too), the parent's key and path, top (the parent's parent) and lists (how many lists directly enclose the node, one in another). A path has the keys from the root, a place also the numbers of lists' members. A key that repeats in one object
    keeps all its values.
    """
    types = dict(blocks.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type, ord_type, ids, places, some = batch.schema.field("page_id").type, batch.schema.field("ord").type, [], [], []

            def packed(to: int) -> pa.RecordBatch:
                made = [pa.array([v if v is None or v.isascii() else _whole(v) for v in (n.get(c) for n in some[:to])] if t == pa.string() else [n.get(c) for n in some[:to]], t) for c, t in _TYPES.items()]
                return pa.RecordBatch.from_arrays([pa.array(ids[:to], id_type), pa.array(places[:to], ord_type), *made], names=["page_id", "ord", *_TYPES])

            for page_id, place, text in zip(batch.column("page_id").to_pylist(), batch.column("ord").to_pylist(), batch.column("json").to_pylist()):
                nodes = read_json(text or "")
                add_values(nodes)
                some += nodes
                ids += [page_id] * len(nodes)
                places += [place] * len(nodes)
                while len(some) >= _NODES:
                    yield packed(_NODES)
                    ids, places, some = ids[_NODES:], places[_NODES:], some[_NODES:]
            if some:
                yield packed(len(some))

    columns = ", ".join(f"{c} {'int' if t == pa.int32() else 'string'}" for c, t in _TYPES.items())
    return blocks.select("page_id", "ord", "json").mapInArrow(run, f"page_id {types['page_id']}, ord {types['ord']}, {columns}")


#: Nodes of an Arrow batch that a task sends at once.
_NODES = 20_000


def _whole(value: str) -> str:
    """A text with a lone surrogate as the replacement character, as no column can hold one."""
    return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


_BLOCK = ["page_id", "ord"]


def _earliest(keys: list[str], shape: str) -> Column:
    """Of a group's nodes of one shape, the one under the earliest of the keys, as a struct with its value."""
    place = F.array_position(F.array(*map(F.lit, keys)), F.col("key"))
    return F.min(F.when((place > 0) & (F.col("shape") == shape) & F.col("value").isNotNull(), F.struct(place, F.col("node"), F.col("value"))))


def _first(keys: list[str], shape: str) -> Column:
    """Of a group's nodes of one shape, the value under the earliest of the keys."""
    return _earliest(keys, shape)["value"]


def _words(key: Column) -> Column:
    """A key as a label: words apart, the first letter large."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-\s]+", " "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, F.lit(2), F.length(spaced)))


def product_pairs(nodes: DataFrame) -> DataFrame:
    """page_id, ord, node, shape (pair or map), name, value of JSON nodes, at any depth.

    An object that names a property and gives its value, in whichever of the known shapes, is a pair; one under a key such as
    ``specifications`` that is no pair is a map, whose entries count. A pair of equal name and value counts once in a block, at its first
    place. A site's own state and null, empty or unknown shapes give nothing.
    """
    entries = F.collect_list(F.when(F.col("parent_key").rlike(SPEC_MAPS) & F.col("key").isNotNull() & ~F.col("key").rlike(NO_SPECS) & F.col("value").isNotNull(), F.struct("node", F.col("key").alias("name"), "value")))
    told = nodes.filter(F.col("parent").isNotNull() & ~F.coalesce("parent_path", F.lit("")).rlike(SYSTEM)).repartition("page_id").groupBy(*_BLOCK, "parent").agg(
        _first(NAME_KEYS, "scalar").alias("name"), _first(MIN_KEYS, "scalar").alias("low"), _first(MAX_KEYS, "scalar").alias("high"), _first(VALUE_KEYS, "scalar").alias("plain"), _first(HOLDER_KEYS, "object").alias("held"),
        _first(LIST_KEYS, "list").alias("listed"), _first(UNIT_KEYS, "scalar").alias("unit"), entries.alias("entries"),
    )
    low, high = F.col("low"), F.col("high")
    ends = F.when(low.isNotNull() & high.isNotNull(), F.concat(low, F.lit("..."), high)).when(low.isNotNull(), F.concat(F.lit(">= "), low)).when(high.isNotNull(), F.concat(F.lit("<= "), high))
    value, unit = F.coalesce(ends, "plain", "held", "listed"), F.coalesce("unit", F.lit(""))
    valued = F.when((unit == "") | F.lower(value).endswith(F.lower(unit)), value).otherwise(F.concat(value, F.lit(" "), unit))
    is_pair = (F.coalesce("name", F.lit("")) != "") & (F.coalesce(value, F.lit("")) != "")
    pair = F.array(F.struct(F.col("parent").alias("node"), F.lit("pair").alias("shape"), F.col("name").alias("name"), valued.alias("value")))
    listed = F.transform("entries", lambda e: F.struct(e["node"].alias("node"), F.lit("map").alias("shape"), _words(e["name"]).alias("name"), e["value"].alias("value")))
    rows = told.select(*_BLOCK, F.explode(F.when(is_pair, pair).otherwise(listed)).alias("r")).select(*_BLOCK, "r.node", "r.shape", clean_text(F.col("r.name")).alias("name"), clean_text(F.col("r.value")).alias("value"))
    first = F.min(F.struct("node", "shape", "name", "value")).alias("r")
    return rows.filter("name <> '' and value <> ''").groupBy(*_BLOCK, F.lower("name").alias("_n"), F.lower("value").alias("_v")).agg(first).select(*_BLOCK, "r.node", "r.shape", "r.name", "r.value")


def only_item(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """The nodes without other products' records, for ``keys`` (page_id, item).

    Where a list has two records or more that name a product, and at least one of these names the page's item, the list's other members go
    with all below them. Keys compare in compact form, without regard to case.
    """
    compact = lambda c: F.lower(compact_key(c))
    items = keys.groupBy("page_id").agg(F.collect_set(compact(F.col("item"))).alias("_items")).hint("merge")
    # a list's members, and the others with their parent: a member's own texts stand with it, as an object's members are no list's
    is_member = F.col("lists") > 0
    placed = nodes.repartition("page_id").withColumn("_of", F.when(is_member, F.col("node")).otherwise(F.col("parent")))
    told = placed.withColumn("_identity", _earliest(IDENTITY_KEYS, "scalar").over(Window.partitionBy(*_BLOCK, "_of"))["value"])
    named = told.join(items, "page_id", "left").withColumn("_record", is_member & (F.col("kind") == "object") & F.col("_identity").isNotNull() & F.col("_items").isNotNull())
    identity = F.when(F.col("_record"), compact(F.col("_identity")))
    matched = named.withColumn("_matched", F.coalesce(F.exists("_items", lambda i: F.contains(identity, i) & (i != "")), F.lit(False)))
    of_list = Window.partitionBy(*_BLOCK, "parent")
    scoped = (F.count(F.when(F.col("_record"), 1)).over(of_list) >= 2) & F.max("_matched").over(of_list)
    gone = matched.withColumn("_to", F.when(is_member & ~F.col("_matched") & scoped, F.col("last")))
    # spans of nodes lie in one another or apart, so the farthest end begun so far tells whether a node lies in one
    reached = gone.withColumn("_reached", F.max("_to").over(Window.partitionBy(*_BLOCK).orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return reached.filter("_reached is null or _reached < node").select(*nodes.columns)
