"""Packing token sequences into fixed-size training sequences (linear grouping, then best fit).

Only the histogram of piece lengths reaches the driver: at most ``capacity`` numbers whatever the corpus.
There the plan is made: large lengths are rounded up within groups of equal cardinality, a configuration
programme over those few sizes is solved by column generation, actual lengths replace the rounded ones,
and everything left is placed by best fit, longest first. The plan is a list of runs ("this pattern of
lengths, so many times"), whose number depends on the number of distinct lengths, not of documents; each
document finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, shuffle_partitions

CAPACITY = 2048
GROUPS = 64
#: Lengths above this share of the capacity are "large".
LARGE_SHARE = 0.45
#: White space of the tokenizer's own splitting rule (Unicode White_Space); a cut before it never splits a token.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: The byte-level rule for words, as the tokenizer's file names it (fixed value).
_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts that leave Latin-1 are encoded in parts of this many white-space chunks, so the library's own objects stay few.
PART_CHUNKS = 50_000


class TextTokenizer:
    """Ids of whole texts from a byte-level BPE file; equal to those of the tokenizers library.

    Where the file's merges make ids in their own order, the rank of a merge is the id of what it makes, and the merge loop of
    tiktoken, fed with the file's pieces, gives the same ids in a quarter of the time. It takes texts within Latin-1, whose
    classes of letters, digits and white space don't depend on a Unicode version, unless they hold one of the file's added
    tokens or a run of white space too long for its pattern. All other texts go through the tokenizers library, in parts.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        self.fast = None
        ranks = _ranks(spec)
        if ranks is not None:
            self.fast = tiktoken.Encoding("file", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        """Unsigned 32-bit ids; a null text has none."""
        if not text:
            return np.zeros(0, "<u4")
        if self.fast is not None and _latin(text) and not any(t in text for t in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
            except ValueError:  # its pattern gives up on white space of some hundred thousand characters
                pass
        chunks = _CHUNK.findall(text) if len(text) > 6 * PART_CHUNKS else [text]
        parts = ("".join(chunks[a : a + PART_CHUNKS]) for a in range(0, len(chunks), PART_CHUNKS))
        return np.concatenate([np.asarray(self.library.encode(p, add_special_tokens=False).ids, "<u4") for p in parts])


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Pieces and their ids, if byte-level merges with default settings make ids in order; else none."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not (plain and level and spec.get("normalizer") is None):
        return None
    vocabulary = model["vocab"]
    made = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    if made != list(range(256, 256 + len(made))):
        return None
    # the byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in itself} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in itself)}
    return {bytes(map(byte_of.__getitem__, piece)): i for piece, i in vocabulary.items() if i < 256 + len(made)}


@lru_cache(maxsize=1)
def tokenizer(path: str) -> TextTokenizer:
    """One per worker; it keeps nothing of the texts."""
    return TextTokenizer(path)


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: a document's ids and its end id, cut only when longer than ``capacity``.

    The first piece takes the odd part. A null or empty text is the end id alone.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = tokenizer(tokenizer_path).encode, np.asarray([end_id], "<u4").tobytes()
        for batch in (whole.slice(a, 1000) for whole in batches for a in range(0, whole.num_rows, 1000)):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()).tobytes() + end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=PIECES.names
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_up, PIECES)


# ---------------------------------------------------------------- the plan


def _price(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration: an unbounded knapsack, one more item per round."""
    most = int(capacity // sizes.min())
    best, taken = np.zeros(capacity + 1), []
    for _ in range(most):
        now, by = best.copy(), np.full(capacity + 1, -1)
        for g, (s, w) in enumerate(zip(sizes, worth)):
            if w > 1e-12:
                value = best[: capacity + 1 - s] + w
                better = value > now[s:] + 1e-12
                now[s:][better] = value[better]
                by[s:][better] = g
        if (by < 0).all():
            break
        taken.append(by)
        best = now
    column, room = np.zeros(len(sizes)), capacity
    for by in reversed(taken):
        if by[room] >= 0:
            column[by[room]] += 1
            room -= sizes[by[room]]
    return float(best[capacity]), column


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, float]]:
    """Fractional numbers of configurations (columns of counts per size) that cover ``demand`` with few sequences.

    Revised simplex with columns generated by :func:`_price`; it may stop after ``rounds`` with a feasible cover.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    for _ in range(rounds):
        worth = inverse.sum(axis=0)
        value, column = _price(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        step, x = inverse @ column, inverse @ demand
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    return [(basis[:, j], float(x)) for j, x in enumerate(inverse @ demand) if x > 1e-9]


def _pop(stretches: list[list[int]], n: int) -> list[tuple[int, int]]:
    """Takes the next ``n`` items of a group as (length, count) runs."""
    got = []
    while n and stretches:
        length, count = stretches[0]
        m = min(n, count)
        got.append((length, m))
        n -= m
        if m == count:
            stretches.pop(0)
        else:
            stretches[0][1] -= m
    return got


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths in one sequence, number of such sequences) that hold every item of ``histogram`` exactly once."""
    runs: list[tuple[tuple[int, ...], int]] = []
    rest = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in rest):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    if full := rest.pop(capacity, 0):
        runs.append(((capacity,), full))
    large = sorted((n for n in rest if n > capacity * LARGE_SHARE), reverse=True)
    open_bins: dict[int, list[list]] = {}  # room left: runs of [lengths, count]
    if large:
        total = sum(rest[n] for n in large)
        per = -(-total // groups)
        parts: list[list[list[int]]] = [[]]
        held = 0
        for n in large:
            left = rest.pop(n)
            while left:
                m = min(left, per - held)
                parts[-1].append([n, m])
                left, held = left - m, held + m
                if held == per:
                    parts.append([])
                    held = 0
        parts = [p for p in parts if p]
        sizes = np.array([p[0][0] for p in parts])
        # groups whose largest lengths agree are one size of the programme
        distinct, which = np.unique(sizes, return_inverse=True)
        queues: list[list[list[int]]] = [[] for _ in distinct]
        for p, g in zip(parts, which):
            queues[g] += p
        demand = np.array([sum(c for _, c in q) for q in queues], float)
        for column, x in sorted(configurations(distinct, demand, capacity), key=lambda c: -c[1]):
            times = int(x + 1e-6)
            slots = [_pop(queues[g], times) for g in reversed(range(len(distinct))) for _ in range(int(round(column[g])))]
            while slots := [s for s in slots if s]:
                m = min(s[0][1] for s in slots)
                lengths = tuple(s[0][0] for s in slots)
                open_bins.setdefault(capacity - sum(lengths), []).append([lengths, m])
                for s in slots:
                    s[0] = (s[0][0], s[0][1] - m)
                    if not s[0][1]:
                        s.pop(0)
        for q in queues:
            for n, c in q:
                rest[n] = rest.get(n, 0) + c
    rooms = sorted(open_bins)

    def put(room: int, run: list) -> None:
        if room not in open_bins:
            rooms.insert(bisect_left(rooms, room), room)
            open_bins[room] = []
        open_bins[room].append(run)

    for n in sorted(rest, reverse=True):
        left = rest[n]
        while left:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                put(capacity, [(), -(-left // (capacity // n))])
                continue
            room = rooms[at]
            lengths, count = open_bins[room].pop()
            each = min(room // n, left)
            times = min(count, left // each)
            if times < count:
                open_bins[room].append([lengths, count - times])
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
            put(room - each * n, [lengths + (n,) * each, times])
            left -= each * times
    runs += [(lengths, count) for held in open_bins.values() for lengths, count in held if lengths]
    return runs


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to rows that have a ``length`` from 1 to ``capacity``.

    Ranks within a length are found in salted buckets with running offsets, so a length that many pieces share
    (full ones above all) never meets in one task. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    buckets = shuffle_partitions(spark)
    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = cut(salted.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    runs = plan_packing(histogram, capacity, groups)
    used: dict[int, int] = {}
    slots, sequence = [], 0
    for lengths, count in runs:
        at = 0
        for n in lengths:
            slots.append((n, used.get(n, 0), sequence, at))
            used[n] = used.get(n, 0) + count
            at += n
        sequence += count
    slots.sort()
    plan = np.array(slots, np.int64).reshape(-1, 4)
    key = plan[:, 0] * (1 << 48) + plan[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        at = np.searchsorted(key, length.to_numpy() * (1 << 48) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": plan[at, 2] + rank.to_numpy() - plan[at, 1], "offset": plan[at, 3]})

    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["length", "_bucket"])
    placed = ranked.withColumn("_place", place("length", F.col("_rank") + F.col("_before")))
    return placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, groups: int = GROUPS, end_id: int = 0) -> DataFrame:
    """Packs every document; see :func:`token_pieces` and :func:`place_pieces`.

    Rows that repeat a doc_id are packed each on their own; a null doc_id stays null.
    """
    return place_pieces(cut(token_pieces(documents, tokenizer_path, capacity, end_id)), capacity, groups)
