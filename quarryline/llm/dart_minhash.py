"""Near-duplicate documents: DartMinHash signatures of weighted word shingles, a banded join, exact checks.

A document is the weighted set of its five-word shingles (weight: how often it occurs). Over each unit of an
element's weight stands a rank axis on which hashed darts arrive with rate one; the darts of a set are those below
its rank limit, and each falls on one of ``k`` coordinates. The earliest dart of a coordinate is the same for two
sets with a chance equal to their weighted Jaccard similarity. A set of weight W and the limit t / W gets about
t = k ln k + 2k darts, so a signature costs W + t steps instead of W k.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
#: 32 bands of 5 coordinates: a pair at 0.8 is missed with a chance of 3e-6, and one at 0.9 with 1e-12.
BANDS, BAND_ROWS = 32, 5
#: Words and darts handled at once inside a task; a dart takes about 100 bytes while it is thrown.
CHUNK_UNITS = 150_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def cells(texts: list[str | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every unit of weight of the texts' shingles, and the text that each belongs to, in order of text.

    The u-th occurrence of a shingle in a text is the unit u of its weight. A text of fewer words than a shingle has
    all its words as its one shingle; a text without words has none.
    """
    lists = [_WORD.findall(t or "") for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    words = np.array([w for x in lists for w in x], dtype=object)
    if not len(words):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    codes, names = pd.factorize(words)
    hashed = pd.util.hash_array(names, categorize=False)[codes]
    owner = np.repeat(np.arange(len(lists)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place, size = np.arange(len(words)) - first, sizes[owner]
    value = np.zeros(len(words), _U)
    for k in range(shingle):
        inside = place + k < size
        at = np.minimum(np.arange(len(words)) + k, len(words) - 1)
        value = value * _U(0x9E3779B97F4A7C15) + np.where(inside, hashed[at], _U(k + 1))
    starts = (place + shingle <= size) | (place == 0)
    value, owner = mixed(value[starts]), owner[starts]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(value)), 0))
    return mixed(value + (np.arange(len(value)) - begin).astype(_U) * _U(0xD6E8FEB86659FD93)), owner


def dart_signatures(cell: np.ndarray, owner: np.ndarray, n: int, k: int, part: np.ndarray | None = None) -> np.ndarray:
    """Signatures (n x k) of sets given as unit cells; a set without cells has zeros.

    ``part`` is the share of its unit that a cell covers (1 where not given): a dart counts if its weight
    coordinate lies in it, so weights need not be whole numbers.
    """
    signature = np.zeros((n, k), _U)
    weight = np.bincount(owner, part, minlength=n).astype(float)
    limit = (k * np.log(k) + 2 * k) / np.maximum(weight, 1e-9)
    todo = weight > 0
    while todo.any():
        use = todo[owner]
        at, seed, share = owner[use], cell[use], None if part is None else part[use]
        rank = np.zeros(len(at))
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = 0
        while len(at):
            step += 1
            dart = mixed(seed + _U(step * 0x632BE59BD9B4E019 % 2**64))
            rank = rank - np.log(((dart >> _U(11)).astype(np.float64) + 0.5) / 2.0**53)
            inside = rank <= limit[at]
            at, seed, rank, dart = at[inside], seed[inside], rank[inside], dart[inside]
            if share is not None:
                share = share[inside]
                hit = (mixed(dart + _U(1)) >> _U(11)).astype(np.float64) / 2.0**53 < share
                darts.append((at[hit], rank[hit], dart[hit]))
            else:
                darts.append((at, rank, dart))
        of, rank, dart = (np.concatenate(x) for x in zip(*darts))
        name = mixed(dart + _U(2))
        slot = of * k + (name % _U(k)).astype(np.int64)
        late_first = np.argsort(-rank, kind="stable")
        flat = signature.reshape(-1)
        flat[slot[late_first]] = name[late_first] | _U(1)  # the earliest dart of a coordinate is written last
        todo &= (signature == 0).any(axis=1)
        limit = limit * 2
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band (n x bands)."""
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), (len(signature), bands)).copy()
    for r in range(rows):
        key = mixed(key * _U(0x9E3779B97F4A7C15) + signature[:, r : rows * bands : rows])
    return key


def _chunks(texts: pa.Array, darts: int = 0) -> Iterator[tuple[int, list[str | None]]]:
    """Stretches of texts, as (first row, texts), of about CHUNK_UNITS words (six bytes each) and ``darts`` a text; at least one text."""
    begin, units = 0, 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for k, size in enumerate(sizes, 1):
        units += size // 6 + darts
        if units > CHUNK_UNITS or k == len(sizes):
            yield begin, texts.slice(begin, k - begin).to_pylist()
            begin, units = k, 0


def text_digest() -> Column:
    """The md5 of the text; null counts as empty."""
    return F.md5(F.coalesce("text", F.lit("")))


def _bands_of(documents: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, digest (of the whole text), keys (of its bands; null without words)."""
    k = bands * rows
    darts = int(k * np.log(k) + 2 * k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _chunks(batch.column(2), darts):
                cell, owner = cells(texts)
                found = band_keys(dart_signatures(cell, owner, len(texts), k), bands, rows).view(np.int64)
                none = np.bincount(owner, minlength=len(texts)) == 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), pa.array(found.reshape(-1)), mask=pa.array(none))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), batch.column(1).slice(begin, len(texts)), lists], names=["doc_id", "digest", "keys"])

    text = F.coalesce("text", F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), text.alias("text")).mapInArrow(run, "doc_id long, digest string, keys array<long>")


def _cells_of(texts: DataFrame) -> DataFrame:
    """node, cells: the sorted hashes of all units of a node's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, listed in _chunks(batch.column(1)):
                cell, owner = cells(listed)
                order = np.lexsort((cell, owner))
                edges = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(listed)))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(cell[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(listed)), lists], names=["node", "cells"])

    return texts.select("node", "text").mapInArrow(run, "node long, cells array<long>")


def similar_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose sets' weighted Jaccard similarity is at least ``threshold``, exactly.

    ``b``'s cells travel to ``a``; the cells of the nodes that stand for ``a`` stay where the first exchange put them.
    """

    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        for i, (p, q) in enumerate(zip(x, y)):
            both = len(np.intersect1d(p, q, assume_unique=True))
            out[i] = both / max(1, len(p) + len(q) - both)
        return pd.Series(out)

    left, right = sets.select(F.col("node").alias("a"), F.col("cells").alias("ca")), sets.select(F.col("node").alias("b"), F.col("cells").alias("cb"))
    return pairs.join(right, "b").join(left, "a").filter(similarity("ca", "cb") >= threshold).select("a", "b")


def _open(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows of buckets that hold nodes of several components, their number, and the pairs across components in them."""
    parts = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    buckets = parts.groupBy("key").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("within")).filter("size * size > within")
    kept = cut(rows.join(buckets, "key").select("key", "node", "label", "size", "within"))
    found = kept.groupBy("key").agg(F.first("size").alias("size"), F.first("within").alias("within")).agg(F.sum("size"), F.sum((F.col("size") * F.col("size") - F.col("within")) / 2)).first()
    return kept.select("key", "node", "label"), int(found[0] or 0), int(found[1] or 0)


def _possible(rows: DataFrame, leaders: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, label_a, label_b), a < b: the pairs across components of a bucket that can reach ``threshold``.

    Every node was compared with its bucket's leader. Let m be the leader's number of cells, n a node's, ``lost`` the leader's
    cells that the node lacks and ``new`` its cells that the leader lacks. Two nodes have at most m - max(lost, lost') of the
    leader's cells in common and need t / (1 + t) (n + n') common cells in all, so at least
    need = t / (1 + t) (n + n') - m + max(lost, lost') of them are new in both. Where that is positive, the pair is found by
    joining new cells under the leader, of each node those that a pair of its need can't do without, rare ones first;
    the few pairs with no such need are found by their sizes. Nothing that could pass is left out.
    """

    @F.pandas_udf("array<long>")
    def inserted(cells: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([np.setdiff1d(p, q, assume_unique=True) for p, q in zip(cells, base)], dtype=object)

    led = rows.join(leaders, "key").filter("node <> first").select("first", "node", "label").distinct()
    base = sets.select(F.col("node").alias("first"), F.col("cells").alias("base"))
    compared = led.join(base, "first").join(sets, "node")
    compared = stored(compared.select("first", "node", "label", F.size("cells").alias("n"), F.size("base").alias("m"), inserted("cells", "base").alias("new")))
    compared = compared.withColumn("lost", F.col("m") - F.col("n") + F.size("new"))

    def second(df: DataFrame, *on: str) -> DataFrame:
        return df.select(*on, *(F.col(c).alias(f"{c}_b") for c in df.columns if c not in (*on, "m")))

    need = f"ceil({threshold / (1 + threshold)!r}D * (n + n_b) - m + greatest(lost, lost_b) - 1e-6D)"
    across = f"node < node_b and label <> label_b and least(n, n_b) >= {threshold!r}D * greatest(n, n_b) - 1e-6D"
    sized = compared.select("first", "node", "label", "n", "m", "lost")
    by_size = sized.join(second(sized, "first"), "first").filter(f"{across} and {need} <= 0")
    held = compared.select("first", "node", "label", "n", "m", "lost", F.explode("new").alias("cell"))
    common = held.groupBy("first", "cell").agg(F.count(F.lit(1)).alias("times"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("first", "cell", "times")
    of_node = Window.partitionBy("first", "node")
    placed = held.join(common, ["first", "cell"]).withColumn("at", F.row_number().over(of_node.orderBy("times", "cell"))).withColumn("all", F.count(F.lit(1)).over(of_node)).drop("times")
    placed = cut(placed)
    by_cell = placed.join(second(placed, "first", "cell"), ["first", "cell"]).filter(f"{across} and {need} > 0 and at + {need} <= all + 1 and at_b + {need} <= all_b + 1")
    ends = [F.col("node").alias("a"), F.col("node_b").alias("b"), F.col("label").alias("label_a"), "label_b"]
    return by_size.select(*ends).union(by_cell.select(*ends)).distinct()


def _merged(named: DataFrame, leaders: DataFrame, sets: DataFrame, threshold: float) -> DataFrame | None:
    """(node, label): which components, named by their labels, are one once every bucket's pairs are settled.

    ``named`` has key, node, label. In each round every bucket with several components draws a pivot by hash, and all its
    nodes of other components are checked against it: as many checks as rows, and what links to any pivot joins its
    component. Once a round no longer halves the pairs that are left across components, or they are as few as a round's
    checks, those that can pass are all checked.
    """
    rows, size, pairs = _open(named)
    found, turn, before = None, 0, 0
    while pairs:
        last = pairs <= size or (turn > 0 and 2 * pairs > before)
        if last:
            checks = cut(_possible(rows, leaders, sets, threshold))
        else:
            order = F.xxhash64("node", "key", F.lit(turn)).alias("order")
            pivots = rows.groupBy("key").agg(F.max(F.struct(order, F.col("node").alias("pivot"), "label")).alias("top"))
            met = rows.join(pivots.select("key", "top.pivot", F.col("top.label").alias("label_b")), "key").filter("label <> label_b")
            forth = F.col("node") < F.col("pivot")
            ends = [F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"), F.when(forth, F.col("label")).otherwise(F.col("label_b")).alias("label_a"), F.when(forth, F.col("label_b")).otherwise(F.col("label")).alias("label_b")]
            checks = cut(met.select(*ends).distinct())
        passed = checks.join(similar_pairs(checks.select("a", "b"), sets, threshold), ["a", "b"])
        links = cut(passed.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct())
        found = links if found is None else found.union(links)
        if last:
            break
        now = components(links).select(F.col("node").alias("label"), F.col("label").alias("new"))
        before, turn = pairs, turn + 1
        rows, size, pairs = _open(rows.join(now, "label", "left").select("key", "node", F.coalesce("new", "label").alias("label")))
    return None if found is None else components(found)


def near_classes(documents: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """digest, class for every distinct text: the md5 of the text (null counts as empty) and the number of its class of near duplicates.

    Each distinct text is one node, whatever ids its rows have; its number is given once, when the nodes are stored. Nodes are
    linked where they share a band and their exact similarity is at least ``threshold``; classes are the connected components.
    Texts without words link to equal texts only.

    In a first round each bucket's nodes are checked against its leader only: the node that shares most buckets' places,
    which in a group of copies is the text that the others were made from, or one like it. Buckets that still hold nodes
    of several components go on to :func:`_merged`, so no link that matters to a class is lost while a group of copies
    never emits all its pairs.
    """
    banded = stored(_bands_of(documents, bands, rows))
    nodes = banded.groupBy("digest").agg(F.min_by("keys", F.coalesce("doc_id", F.lit(0))).alias("keys"), F.min("doc_id").alias("least"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    members = nodes.filter("keys is not null").select(F.explode("keys").alias("key"), "node")
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = stored(members.join(buckets, "key"))  # the buckets of two nodes or more
    central = shared.groupBy("node").agg(F.sum("size").alias("score"))
    scored = stored(shared.select("key", "node").join(central, "node"))
    leaders = scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("node")).alias("back"))).alias("top")).select("key", (-F.col("top.back")).alias("first"))
    # a node's text is read from the rows of its smallest id, so that of a group of copies one travels
    wanted = nodes.join(shared.select("node").distinct(), "node").select("node", "digest", "least")
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), "text")
    texts = read.join(wanted, (read["digest"] == wanted["digest"]) & read["doc_id"].eqNullSafe(wanted["least"])).groupBy("node").agg(F.min("text").alias("text"))
    sets = stored(_cells_of(texts))
    first = cut(scored.join(leaders, "key").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    links = cut(similar_pairs(first, sets, threshold))
    labels = components(links)
    named = cut(shared.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    merged = _merged(named, leaders, sets, threshold)
    named_nodes = nodes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    if merged is not None:
        merged = merged.select(F.col("node").alias("label"), F.col("label").alias("new"))
        named_nodes = named_nodes.join(merged, "label", "left").select("digest", F.coalesce("new", "label").alias("label"))
    return stored(named_nodes.select("digest", F.col("label").alias("class")))


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, class_id, class_number for every row: the smallest doc_id, and the number, of the class of near duplicates of the row's text.

    Classes are those of :func:`near_classes`, so rows that share a doc_id are each compared by their own text, and rows
    without one are compared like others. ``class_id`` is null where no row of the class has a doc_id; where one doc_id has
    several texts, two classes can have the same smallest one, but never the same number.
    """
    classes = near_classes(documents, threshold, bands, rows)
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"))
    placed = stored(ids.join(classes, "digest"))
    named = placed.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return placed.join(named, "class").select("doc_id", "class_id", F.col("class").alias("class_number"))
