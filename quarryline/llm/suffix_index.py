"""Exact removal of long byte strings that occur earlier: suffix arrays in a logarithmic family of levels.

A window is ``length`` bytes of one text. Windows are compared where their content sends them, in three steps:

1. Every window names its anchor, the smallest hash among its ``gram``-byte grams. Windows of equal content have
   equal anchors, and neighbouring windows mostly share one, so about one gram in 37 is an anchor. Anchors are
   shuffled by hash (a few bytes each) with a second hash of all bytes that their windows cover. Anchors that agree in
   both cover the same bytes: all but the first are repeats. An anchor that meets no other bytes has nothing to match.
2. What is left, anchors that occur with different bytes around them, is where matches begin and end. Their windows,
   cut into blocks that share ``length - BLOCK + 1`` bytes, go to the task that the hash of these shared bytes names,
   with just the bytes that they cover. A frequent line surrounded by different text is thereby spread over many tasks.
3. There, in order of the corpus, each batch of windows gets its suffix array (depth ``length``), which is
   merge-scanned against the existing levels for full-length matches and then becomes a level itself; levels of
   like size are merged, so there are logarithmically many and a window is merged logarithmically often.

Texts are shuffled once, by id; all steps that need them read that exchange.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions

LENGTH = 100
GRAM = 28
BLOCK = 24
#: Bytes hashed at once, windows of a batch of the index, and entries of the table of blocks that a task has sent.
CHUNK_BYTES = 1 << 20
BATCH_WINDOWS = 1 << 16
#: Distinct windows (100 bytes each) that a task's index holds in memory; what is over goes to its temporary folder.
MEMORY_WINDOWS = 1_000_000
SENT_BLOCKS = 200_000
#: Rows without a doc_id get one below this, from the hash of their text: they come first, and spread over all tasks.
NO_ID = -(1 << 61)

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


class GramHasher:
    """Hashes of all grams of a byte array from prefix sums modulo 2**64."""

    def __init__(self, gram: int, most: int):
        self.gram = gram
        inverse = pow(_BASE, -1, 1 << 64)
        self.up = np.cumprod(np.full(most + 1, _BASE, _U))
        self.down = np.cumprod(np.full(most + 1, inverse, _U))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, _U)
        np.cumsum(_TABLE[raw] * self.up[: len(raw)], out=sums[1:])
        return sums

    def grams(self, sums: np.ndarray) -> np.ndarray:
        return _mixed((sums[self.gram :] - sums[: -self.gram]) * self.down[: len(sums) - self.gram])

    def spans(self, sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from ``first`` to before ``end``, their number included."""
        return _mixed(_mixed((sums[end] - sums[first]) * self.down[first]) + (end - first).astype(_U) * _U(0xD6E8FEB86659FD93))


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its leftmost minimum, by doubling spans."""
    at, span = np.arange(len(values), dtype=np.int32), 1
    best = values
    while span < width:
        step = min(span, width - span)
        n = len(best) - step
        left = best[:n] <= best[step : step + n]
        at, best = np.where(left, at[:n], at[step : step + n]), np.where(left, best[:n], best[step : step + n])
        span += step
    return at


def anchors(texts: list[bytes], length: int, gram: int, hasher: GramHasher) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, hash, first window, number of windows, anchor less first window, hash of all bytes covered) of
    each anchor's run of windows.

    Texts are hashed in chunks; one longer than a chunk is taken in overlapping parts, which splits runs at most.
    """
    parts: list[tuple[int, int, bytes]] = []
    held = 0

    def run() -> tuple[np.ndarray, ...]:
        raw = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        sizes = np.fromiter((len(p[2]) for p in parts), np.int64, len(parts))
        begin = np.cumsum(sizes) - sizes
        sums = hasher.sums(raw)
        hashes = hasher.grams(sums)
        owner = leftmost_minima(hashes, length - gram + 1)
        part = np.repeat(np.arange(len(parts)), sizes)[: len(owner)]
        inside = np.arange(len(owner)) + length <= (begin + sizes)[part]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
        starts = np.flatnonzero(new & inside)
        count = np.diff(np.append(np.flatnonzero(new), len(owner)))[inside[np.flatnonzero(new)]]
        # a run that reaches past its text's last window is cut there
        count = np.minimum(count, (begin + sizes)[part[starts]] - length + 1 - starts)
        base = np.array([p[1] for p in parts], np.int64)[part[starts]] - begin[part[starts]]
        number = np.array([p[0] for p in parts], np.int64)[part[starts]]
        full = hasher.spans(sums, starts, starts + count - 1 + length) + (owner[starts] - starts).astype(_U)
        return number, hashes[owner[starts]].view(np.int64), starts + base, count, owner[starts] - starts, full.view(np.int64)

    for k, text in enumerate(texts):
        for a in range(0, len(text) - length + 1, CHUNK_BYTES):
            piece = text[a : a + CHUNK_BYTES + length - 1]
            if held + len(piece) > CHUNK_BYTES + length - 1 and parts:
                yield run()
                parts, held = [], 0
            parts.append((k, a, piece))
            held += len(piece)
    if parts:
        yield run()


class SuffixLevels:
    """Sorted arrays of distinct windows; levels of like size merge, so sizes grow geometrically.

    At most ``most`` windows and one batch are held in memory: beyond that the levels go to one sorted file of a temporary
    folder, where files of like size merge too. All are searched, so no window is forgotten.
    """

    def __init__(self, length: int, most: int = MEMORY_WINDOWS):
        self.kind, self.most = f"S{length}", most
        self.levels: list[np.ndarray] = []
        self.files: list[np.ndarray] = []
        self.folder: tempfile.TemporaryDirectory | None = None
        self.written = 0

    def add(self, windows: np.ndarray) -> np.ndarray:
        """Flags the windows found in a level or earlier in this batch; the others become a level."""
        order = np.argsort(windows, kind="stable")  # the batch's suffix array, cut at the window's length
        ranked = windows[order]
        again = np.zeros(len(windows), bool)
        again[1:] = ranked[1:] == ranked[:-1]
        for level in (*self.files, *self.levels):  # merge-scan: both sides are sorted
            place = np.searchsorted(level, ranked)
            again |= level[np.minimum(place, len(level) - 1)] == ranked
        found = np.zeros(len(windows), bool)
        found[order] = again
        fresh = ranked[~again]
        if len(fresh):
            self.levels.append(fresh)
            while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
                merged = np.concatenate([self.levels.pop(), self.levels.pop()])
                merged.sort(kind="stable")
                self.levels.append(merged)
            if sum(map(len, self.levels)) > self.most:
                self._spill()
        return found

    def _spill(self) -> None:
        whole = np.concatenate(self.levels)
        self.levels = []
        whole.sort(kind="stable")
        self.files.append(self._file([whole]))
        del whole
        while len(self.files) > 1 and len(self.files[-2]) <= 2 * len(self.files[-1]):
            right, left = self.files.pop(), self.files.pop()
            self.files.append(self._file(self._merged(left, right)))
            for old in (left, right):
                os.unlink(old.filename)

    def _file(self, parts: Iterable[np.ndarray]) -> np.memmap:
        self.folder = self.folder or tempfile.TemporaryDirectory(prefix="levels-")
        self.written += 1
        path = os.path.join(self.folder.name, str(self.written))
        with open(path, "wb") as out:
            for part in parts:
                part.tofile(out)
        return np.memmap(path, self.kind, "r")

    def _merged(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        """Two sorted arrays as one, in parts of at most ``most`` windows."""
        step, i, j = max(1, self.most // 2), 0, 0
        while i < len(a) and j < len(b):
            x, y = a[i : i + step], b[j : j + step]
            edge = min(x[-1], y[-1])
            x, y = x[: np.searchsorted(x, edge, "right")], y[: np.searchsorted(y, edge, "right")]
            part = np.concatenate([x, y])
            part.sort(kind="stable")
            yield part
            i, j = i + len(x), j + len(y)
        for rest, k in ((a, i), (b, j)):
            for at in range(k, len(rest), step):
                yield rest[at : at + step]

    def close(self) -> None:
        self.levels, self.files = [], []
        if self.folder is not None:
            self.folder.cleanup()


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges, in order; touching ones are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def repeated_ranges(documents: DataFrame, length: int = LENGTH, carried: bool = False) -> tuple[DataFrame, DataFrame]:
    """The texts (_id, text, _n) and for each _id the list of (n, a, b): byte ranges covered by earlier windows.

    With ``carried`` the other columns go along, the k-th of ``documents`` as ``_ck``; all steps read all columns, so
    that they share one exchange. ``_id`` is the doc_id and ``_n`` numbers the rows of one doc_id in order of text. Rows without a
    doc_id come before all, in the order of their texts' hashes; a doc_id below -2**61 isn't allowed.
    """
    gram, block = (GRAM, BLOCK) if length >= 2 * GRAM else (max(1, length // 2), max(1, length // 4))
    n = shuffle_partitions(documents.sparkSession)
    others = [(F.col("text").isNull() if c == "text" else F.col(c)).alias(f"_c{k}") for k, c in enumerate(documents.columns)] if carried else []
    # never null, also for the planner: a test for null before one of its uses would keep them from sharing the exchange
    keyed = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2 * NO_ID) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(-NO_ID)), F.lit(2 * NO_ID)).alias("_id"), F.coalesce("text", F.lit("")).alias("text"), *others)
    texts = keyed.repartition(n, "_id").withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy("text")).cast("long"))
    # kind 0: to be compared; 1: a repeat; 2: to be indexed; 3: as 2, and tells others that the hash occurs with other bytes
    grams_schema = "kind int, hash long, full long, _id long, _n long, start long, shape long"

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = GramHasher(gram, CHUNK_BYTES + length)
        for batch in batches:
            ids, ns = batch.column("_id").to_numpy(), batch.column("_n").to_numpy()
            raw = [t.encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            found = list(anchors(raw, length, gram, hasher))
            if not found:
                continue
            number, hashed, start, count, ahead, full = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((full, hashed))  # stable: the corpus order within equal ones
            same_hash = hashed[order][1:] == hashed[order][:-1]
            same = same_hash & (full[order][1:] == full[order][:-1])
            again = np.zeros(len(order), bool)
            again[order[1:][same]] = True
            # of the anchors with several surroundings in this batch, one stands for all in the comparison
            first = np.flatnonzero(np.append(True, ~same_hash))
            several = np.add.reduceat(np.append(0, same_hash & ~same), first) > 0
            kind = np.zeros(len(order), np.int32)
            kind[order] = np.where(np.repeat(several, np.diff(np.append(first, len(order)))), 2, 0)
            kind[order[first[several]]] = 3
            # repeats in a row are one range
            at = np.flatnonzero(again)
            joined = (number[at][1:] == number[at][:-1]) & (start[at][1:] == start[at][:-1] + count[at][:-1])
            head = np.flatnonzero(np.append(True, ~joined)) if len(at) else at
            total = np.add.reduceat(count[at], head) if len(at) else at
            keep = np.flatnonzero(~again)
            head = at[head] if len(at) else at
            rows = np.append(keep, head)
            shape = np.append(count[keep] << 8 | ahead[keep], total << 8)
            kind = np.append(kind[keep], np.ones(len(head), np.int32))
            spread = (ids[number[rows]] * 0x9E3779B97F4A7C1 + start[rows] * 0xBF58476D1CE4E5) >> 3
            key = np.where((kind == 1) | (kind == 2), spread, hashed[rows])
            for a in range(0, len(rows), 100_000):
                s = slice(a, a + 100_000)
                r = rows[s]
                yield _batch(dict(kind=pa.array(kind[s].astype(np.int32)), hash=pa.array(key[s]), full=pa.array(full[r]), _id=pa.array(ids[number[r]]), _n=pa.array(ns[number[r]]), start=pa.array(start[r]), shape=pa.array(shape[s])))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by hash, then full, then place; the last hash of a batch waits for the next."""

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            h, f, kind = (table.column(c).to_numpy() for c in ("hash", "full", "kind"))
            known = (kind == 1) | (kind == 2)
            new_hash = np.append(True, (h[1:] != h[:-1]) | known[1:] | known[:-1])
            new_full = new_hash | np.append(True, f[1:] != f[:-1])
            first = np.flatnonzero(new_hash)
            many = (np.add.reduceat(new_full.astype(np.int64), first) > 1) | (np.add.reduceat((kind == 3).astype(np.int64), first) > 0)
            many = np.repeat(many, np.diff(np.append(first, len(h))))
            out = np.where(known, kind, np.where(~new_full, 1, np.where(many, 2, 0))).astype(np.int32)
            yield from table.set_column(0, "kind", pa.array(out)).filter(pa.array(out > 0)).combine_chunks().to_batches()

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            h = table.column("hash").to_numpy()
            edge = int(np.searchsorted(h, h[-1])) if len(h) else 0
            held = table.slice(edge)
            if edge:
                yield from settle(table.slice(0, edge))
        if held is not None and held.num_rows:
            yield from settle(held)

    found = texts.mapInArrow(find_anchors, grams_schema)
    settled = found.repartition(n, "hash").sortWithinPartitions("hash", "full", "_id", "_n", "start").mapInArrow(compare, grams_schema)
    listed = settled.groupBy("_id").agg(F.collect_list(F.struct("_n", "start", "shape", "kind")).alias("items"))
    blocks_schema = "key long, _id long, _n long, start long, windows int, content binary"

    def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            for _id, text, _n, items in zip(*(batch.column(c).to_pylist() for c in ("_id", "text", "_n", "items"))):
                raw = text.encode("utf-8", "replace")
                again: list[tuple[int, int]] = []
                for start, shape, kind in sorted((x["start"], x["shape"], x["kind"]) for x in items if x["_n"] == _n):
                    count, ahead = shape >> 8, shape & 255
                    if kind == 1:
                        again.append((start, start + count - 1 + length))
                        continue
                    anchor = start + ahead
                    for b in range((ahead - count + 1) // block, ahead // block + 1):
                        first = max(start, anchor - b * block - block + 1)
                        last = min(start + count - 1, anchor - b * block)
                        content = raw[first : last + length]
                        if content in sent:
                            again.append((first, last + length))
                            continue
                        sent.add(content)
                        shared = anchor - b * block
                        key = xxhash.xxh64_intdigest(raw[shared : shared + length - block + 1])
                        out.append((key - (1 << 63), _id, _n, first, last - first + 1, content))
                if len(sent) > SENT_BLOCKS:
                    sent.clear()
                for a, b in merge_ranges(again):  # already known, passed on: no content
                    out.append((xxhash.xxh64_intdigest(f"{_id} {a}") - (1 << 63), _id, _n, a, b - a, None))
                if len(out) > 50_000:
                    yield rows_of(out)
                    out = []
            if out:
                yield rows_of(out)

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["key", "_id", "_n", "start", "windows", "content"])

    # a merge join keeps the order of ids, by which a task tells the first of equal blocks; other joins don't
    blocks = texts.join(listed.hint("merge"), "_id").mapInArrow(cut_blocks, blocks_schema)
    ranges_schema = "_id long, _n long, a long, b long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SuffixLevels(length)
        try:
            yield from scanned(batches, index)
        finally:
            index.close()

    def scanned(batches: Iterator[pa.RecordBatch], index: SuffixLevels) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()

        def ranges(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 4)], names=["_id", "_n", "a", "b"])

        def flush(waiting: list[tuple], out: list[tuple]) -> None:
            raw = np.frombuffer(b"".join(w[4] for w in waiting), np.uint8)
            counts = np.fromiter((w[3] for w in waiting), np.int64, len(waiting))
            sizes = counts + length - 1
            at = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, length)[at]).view(index.kind).reshape(-1)
            found = index.add(windows)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], found.view(np.int8), [0]])))
            which = np.repeat(np.arange(len(waiting)), counts)
            begin = np.cumsum(counts) - counts
            for a, b in zip(edges[::2], edges[1::2]):  # runs of found windows, cut at the blocks' ends
                while a < b:
                    k = which[a]
                    end = min(b, begin[k] + counts[k])
                    first = waiting[k][2] + int(a - begin[k])
                    out.append((waiting[k][0], waiting[k][1], first, first + int(end - a) - 1 + length))
                    a = end

        waiting: list[tuple] = []
        held = 0
        for batch in batches:
            out: list[tuple] = []
            for _id, _n, start, windows, content in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                if content is None:
                    out.append((_id, _n, start, start + windows))
                elif content in known:  # the same block, whole, earlier in the corpus
                    out.append((_id, _n, start, start + windows - 1 + length))
                else:
                    known.add(content)
                    waiting.append((_id, _n, start, windows, content))
                    held += windows
                    if held >= BATCH_WINDOWS:
                        flush(waiting, out)
                        waiting, held = [], 0
            if len(known) > SENT_BLOCKS:
                known.clear()
            yield ranges(out)
        if waiting:
            out = []
            flush(waiting, out)
            yield ranges(out)

    ordered = blocks.repartition(n, "key").sortWithinPartitions("_id", "_n", "start")
    covered = ordered.mapInArrow(scan, ranges_schema).groupBy("_id").agg(F.collect_list(F.struct("_n", "a", "b")).alias("ranges"))
    return texts, covered


def _own(ranges: list[dict] | None, n: int) -> list[tuple[int, int]]:
    return merge_ranges([(r["a"], r["b"]) for r in ranges or () if r["_n"] == n])


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    Removed is each byte covered by a ``length``-byte string that also starts earlier: in a smaller doc_id, in an
    earlier row of the same doc_id, or earlier in the same text. A null text is empty; texts shorter than ``length``
    stay whole.
    """
    texts, covered = repeated_ranges(documents, length)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _id, text, _n, ranges in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw, spans = text.encode("utf-8", "replace"), _own(ranges, _n)
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                out.append((None if _id < NO_ID else _id, len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
            kinds = (pa.int64(),) * 4 + (pa.string(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return texts.join(covered, "_id", "left").select("_id", "text", "_n", "ranges").mapInArrow(finish, schema)


def without_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``documents`` with repeated passages cut out of their texts, and n_chars counted anew.

    A removed run is narrowed to whole characters. Documents without repeats, empty ones included, keep their text (a null
    stays null); a document of which only white space is left goes. Rows that repeat a doc_id are one document here: each
    loses what an earlier one of them has.
    """
    texts, covered = repeated_ranges(documents, length, carried=True)

    def cut_out(texts, ns, ranges):
        import pandas as pd

        out = []
        for text, n, found in zip(texts, ns, ranges):
            spans = _own(None if found is None else list(found), n)
            raw, at, kept = text.encode("utf-8", "replace"), 0, []
            for a, b in spans:
                while a < len(raw) and raw[a] & 0xC0 == 0x80:
                    a += 1
                while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
                    b -= 1
                kept.append(raw[at:a])
                at = max(at, b)
            kept.append(raw[at:])
            left = b"".join(kept).decode("utf-8", "replace")
            out.append(None if spans and not left.strip() else left)
        return pd.Series(out, dtype=object)

    # not deterministic in name only: or else the filter on its result would have it computed twice
    cut_out = F.pandas_udf(cut_out, "string").asNondeterministic()
    joined = texts.join(covered, "_id", "left")
    new = joined.withColumn("_new", F.when(F.col("ranges").isNull(), F.col("text")).otherwise(cut_out("text", "_n", "ranges"))).filter("_new is not null")
    same = F.col("_new") == F.col("text")
    columns = []
    for k, c in enumerate(documents.columns):
        old = F.col(f"_c{k}")
        if c == "text":
            columns.append(F.when(~old | ~same, F.col("_new")).alias(c))
        elif c == "n_chars":
            columns.append(F.when(same, old).otherwise(F.length("_new").cast(documents.schema[c].dataType)).alias(c))
        else:
            columns.append(old.alias(c))
    return new.select(*columns)
