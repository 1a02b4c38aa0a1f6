"""Pages as trees: one row for each element and text, numbered in document order, so containment is a range and text is counted once.

``page_nodes`` reads a page's tags once with a stack. Node numbers rise in document order; ``last`` is a node's last descendant, so b lies
in a exactly if a.node < b.node <= a.last. ``block``, ``cell``, ``row``, ``grid`` and ``form`` are the nearest enclosing block, table cell, table row,
table and form. What follows is joins and groups over these numbers.

Elements whose end tag may be left out (p, li, dt, dd, tr, td, ...) end where the next one of their kind begins or what holds them ends; other
open elements end with their parent. An end tag that matches nothing goes, and none but a table's own ends a cell. Scripts and styles hold one
raw text. A null or empty page has no rows; a page cut off anywhere is read to its end.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<head>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style".split())
#: Elements that stand on lines of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html li main nav ol option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
_TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
_CELLS = frozenset("td th".split())
_SECTIONS = frozenset("thead tbody tfoot".split())
#: Elements that end where another begins: which ones, and what keeps an outer one open.
_ENDED = {
    "li": ((frozenset(["li"]), frozenset("ul ol menu".split())),), **dict.fromkeys(("dt", "dd"), ((frozenset("dt dd".split()), frozenset(["dl"])),)), "option": ((frozenset(["option"]), frozenset(["select"])),),
    **dict.fromkeys(_CELLS, ((_CELLS, frozenset(["tr", "table"])),)), "tr": ((frozenset(["tr"]), frozenset(["table"])),), **dict.fromkeys(_SECTIONS, ((_SECTIONS, frozenset(["table"])),)),
}
_P = frozenset(["p"])
_HOLDS_P = frozenset("table td th caption template button object".split())


_TYPES = {"node": pa.int32(), "parent": pa.int32(), "depth": pa.int32(), "last": pa.int32(), "tag": pa.string(), "within": pa.string(), "attributes": pa.map_(pa.string(), pa.string()), "text": pa.string(), "begin": pa.int32(), "end": pa.int32(), "block": pa.int32(), "cell": pa.int32(), "row": pa.int32(), "grid": pa.int32(), "form": pa.int32(), "trail": pa.int64()}
_KINDS = {**dict.fromkeys(BLOCKS, (0,)), "form": (0, 4), **dict.fromkeys(_CELLS, (0, 1)), "tr": (0, 2), "table": (0, 3)}


def _node_columns(html: str) -> dict[str, list]:
    """The nodes of one page, in document order, column by column."""
    out: dict[str, list] = {name: [] for name in _TYPES}
    numbers, parents, depths, lasts, tags, withins, attributes, texts, begins, ends, *near, trails = out.values()
    stack: list[int] = []
    #: The open blocks, cells, rows, tables and forms.
    open_ = ([], [], [], [], [])

    def add(tag: str, begin: int, end: int, given: list | None, text: str | None) -> None:
        number = len(numbers)
        numbers.append(number)
        parents.append(stack[-1] if stack else None)
        depths.append(len(stack))
        lasts.append(number)
        tags.append(tag)
        withins.append(tags[stack[-1]] if stack else None)
        attributes.append(given)
        texts.append(text)
        begins.append(begin)
        ends.append(end)
        for column, held in zip(near, open_):
            column.append(held[-1] if held else None)
        # a trail's hash follows from its parent's, so it costs the same at any depth
        said = next((v for n, v in given if n == "class"), "") if given else ""
        trails.append(crc32(f"{tag}.{said}".encode("utf-8", "replace"), trails[stack[-1]] if stack else 0))

    def close(place: int, end: int) -> None:
        """Ends the open elements from this place of the stack on."""
        while len(stack) > place:
            number = stack.pop()
            lasts[number], ends[number] = len(numbers) - 1, end
            for kind in _KINDS.get(tags[number], ()):
                open_[kind].pop()

    def found(wanted: Iterable[str], keeps: Iterable[str]) -> int | None:
        """The place of the nearest open element of these tags, unless one that keeps it open comes first."""
        for place in range(len(stack) - 1, -1, -1):
            tag = tags[stack[place]]
            if tag in wanted:
                return place
            if tag in keeps:
                return None
        return None

    at = 0
    while at < len(html):
        token = _TOKEN.search(html, at)
        start = token.start() if token else len(html)
        if start > at:
            add("#text", at, start, None, html[at:start])
        if not token:
            break
        at, tag = token.end(), (token["tag"] or "").lower()
        if not tag:
            continue
        if token["end"]:
            if (place := found((tag,), () if tag in _TABLE else _CELLS)) is not None:
                close(place, at)
            continue
        for wanted, keeps in (*_ENDED.get(tag, ()), *(((_P, _HOLDS_P),) if tag in BLOCKS else ())):
            if (place := found(wanted, keeps)) is not None:
                close(place, start)
        head, given = token["head"], {}
        if head:
            for name, value in _ATTRIBUTE.findall(head):
                given.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') and value else value)
        add(tag, start, at, list(given.items()), " " if tag == "br" else None)
        if tag in _VOID or head.endswith("/") and tag not in BLOCKS and tag not in _RAW:
            continue
        number = len(numbers) - 1
        stack.append(number)
        for kind in _KINDS.get(tag, ()):
            open_[kind].append(number)
        if tag in _RAW:
            done = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
            if done.start() > at:
                add("#text", at, done.start(), None, html[at : done.start()])
            at = done.end()
            close(len(stack) - 1, at)
    close(0, len(html))
    return out


def read_nodes(html: str) -> list[dict]:
    """The nodes of one page, in document order."""
    columns = _node_columns(html)
    return [dict(zip(columns, row)) for row in zip(*columns.values())]


_SCHEMA = "node int, parent int, depth int, last int, tag string, within string, attributes map<string,string>, text string, begin int, end int, block int, cell int, row int, grid int, form int, trail long"
#: Characters of pages that a task turns into one Arrow batch; a longer page makes a batch of its own.
_CHARACTERS = 1 << 20


def page_nodes(pages: DataFrame) -> DataFrame:
    """page_id, node, parent, depth, last, tag, within (the parent's tag), attributes, text, begin, end, block, cell, row, grid, form, trail of (page_id, html).

    Texts are nodes with the tag ``#text``, as written; a line break is a text of one space. ``begin`` and ``end`` are places in the
    page; ``trail`` is a hash of the tags and classes from the root down to a node, so nodes of like place in pages of one layout share it.
    """
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("page_id").type
            ids, made, size = [], {name: [] for name in _TYPES}, 0

            def packed() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *[pa.array(v, _TYPES[n]) for n, v in made.items()]], names=["page_id", *_TYPES])

            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                columns = _node_columns(html or "")
                ids += [page_id] * len(columns["node"])
                for name, values in columns.items():
                    made[name] += values
                size += len(html or "")
                if size >= _CHARACTERS:
                    yield packed()
                    ids, made, size = [], {name: [] for name in _TYPES}, 0
            if ids:
                yield packed()

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, {_SCHEMA}")


def inside(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs of nodes of which the second lies in the first, as outer_node and the second's columns: a join by page with a range."""
    spans = outer.select("page_id", F.col("node").alias("outer_node"), F.col("last").alias("_to"))
    # the planner takes pages for as small as their files, so it would hand all spans to every task
    return inner.join(spans.hint("merge"), "page_id").filter((F.col("node") > F.col("outer_node")) & (F.col("node") <= F.col("_to"))).drop("_to")


def _holders(nodes: DataFrame, by: str, holds: Column, *columns: str) -> DataFrame:
    """page_id, node, the columns of the node, text: for each node that ``holds`` the texts ``by`` it, joined in document order and cleaned.

    A node and its texts meet in one group, so a page is read once; ``page_id`` alone places them, so what groups by page next moves nothing.
    Texts without such a node make a group of their own, whose node and columns are null. Exploding an array of one keeps the joined text
    from being computed anew by each use of it.
    """
    is_text = F.col("text").isNotNull()
    of = F.when(is_text, F.col(by)).otherwise(F.col("node"))
    placed = nodes.filter(is_text | holds).select("page_id", of.alias("of"), F.when(~is_text, F.struct("node", *columns)).alias("head"), F.when(is_text, F.struct("node", "text")).alias("part"))
    grouped = placed.repartition("page_id").groupBy("page_id", "of").agg(F.max("head").alias("head"), F.array_sort(F.collect_list("part")).alias("parts"))
    joined = grouped.select("page_id", F.col("of").alias("node"), "head", F.explode(F.array(F.array_join(F.transform("parts", lambda x: x["text"]), ""))).alias("raw"))
    return joined.select("page_id", "node", *[F.col("head")[c].alias(c) for c in columns], F.explode(F.array(clean_text(F.col("raw")))).alias("text"))


def block_texts(nodes: DataFrame) -> DataFrame:
    """page_id, node, tag, text of each block's own text: what lies in a block within it counts there alone. Scripts, styles and empty blocks go."""
    shown = nodes.filter(~F.coalesce(F.col("within"), F.lit("")).isin(*_RAW))
    return _holders(shown, "block", F.col("tag").isin(*BLOCKS), "tag").filter("text <> ''").select("page_id", "node", "tag", "text")


def tree_cells(nodes: DataFrame) -> DataFrame:
    """page_id, grid, row, node, tag, text of the cells of all tables; a nested table's text belongs to its own cells alone."""
    inner = nodes.filter(F.col("text").isNull() | F.col("cell").isNotNull())
    return _holders(inner, "cell", F.col("tag").isin(*_CELLS) & F.col("row").isNotNull(), "grid", "row", "tag").filter("row is not null").select("page_id", "grid", "row", "node", "tag", "text")


def tree_rows(nodes: DataFrame) -> DataFrame:
    """page_id, grid, row, cells (texts in order) of the rows of all tables."""
    rows = tree_cells(nodes).groupBy("page_id", "grid", "row").agg(F.array_sort(F.collect_list(F.struct("node", "text"))).alias("cells"))
    return rows.select("page_id", "grid", "row", F.transform("cells", lambda c: c["text"]).alias("cells"))
