"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of scored pieces.

A text's spaces become whitespace markers and one marker goes in front. The best segmentation maximises the sum of
the pieces' log scores; a character that no piece covers falls back to its bytes. No piece has a marker after other
characters, so segmentations break before each run of markers: the stretches between are solved once for each
distinct one, many at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "▁"
#: An unknown character scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Entries of a worker's cache of solved stretches; a full cache is emptied.
CACHE_UNITS = 250_000
_UNIT = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")


@dataclass
class DoubleArray:
    """Trie over bytes: from state s, byte b leads to base[s] + b + 1 if check there is s; value is the piece or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, pieces: dict[bytes, int]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for piece, number in pieces.items():
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][b]
            ends[node] = number
        size = 2 * len(children) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        value[0] = ends[0]
        hint, queue = 1, [(0, 0)]
        for node, state in queue:
            codes = sorted(b + 1 for b in children[node])
            if not codes:
                continue
            at, tries = max(hint - codes[0], 0), 0
            while True:
                if at + 300 >= len(taken):
                    more = len(taken)
                    taken.extend(bytes(more))
                    base, check, value = (np.concatenate([x, np.full(more, fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
                if not any(taken[at + c] for c in codes):
                    break
                at, tries = at + 1, tries + 1
            if tries > 24:  # the stretch before is nearly full: later nodes start further on
                hint += tries // 2
            base[state] = at
            for c in codes:
                child = children[node][c - 1]
                taken[at + c] = 1
                check[at + c], value[at + c] = state, ends[child]
                queue.append((child, at + c))
        return cls(base, check, value)


class UnigramModel:
    """Pieces with log scores. ``scores``: "model" takes the file's; "rank" makes log scores of a ranked vocabulary.

    A vocabulary learned by merging carries ranks instead of log scores; by Zipf's law the piece of rank r then scores
    -log(r + 2).
    """

    def __init__(self, path: str | None = None, scores: str = "rank", proto: bytes | None = None):
        import sentencepiece

        spm = sentencepiece.SentencePieceProcessor(model_file=path) if proto is None else sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = spm.get_piece_size()
        self.text = [spm.id_to_piece(i) for i in range(n)]
        self.fallback = np.full(256, -1, np.int32)
        self.raw: list[bytes] = []
        self.score = np.zeros(n, np.float32)
        usable: dict[bytes, int] = {}
        rank = 0
        for i, piece in enumerate(self.text):
            if spm.is_byte(i):
                self.fallback[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif spm.is_control(i) or spm.is_unknown(i) or spm.is_unused(i):
                self.raw.append(b"")
            else:
                usable[piece.encode()] = i
                self.raw.append(piece.replace(MARKER, " ").encode())
                self.score[i] = spm.get_score(i) if scores == "model" else -np.log(rank + 2)
                rank += 1
        self.unknown = spm.unk_id()
        self.worst = np.float32(min((self.score[i] for i in usable.values()), default=0.0) - UNKNOWN_PENALTY)
        self.breaks = not any(re.search(f"[^{MARKER}]{MARKER}", p.decode()) for p in usable)
        self.trie = DoubleArray.build(usable)
        self.known: dict[str, bytes] = {}

    def _solve(self, units: list[str]) -> list[bytes]:
        """Ids (little-endian 32-bit) of the best segmentation of each unit; ties go to the earlier start."""
        raws = [u.encode("utf-8", "replace") for u in units]
        n, width = len(raws), max(map(len, raws))
        sizes = np.fromiter(map(len, raws), np.int64, n)
        grid = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(n, width)
        starts_char = (grid & 0xC0) != 0x80
        best = np.full((n, width + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            rows = np.flatnonzero(starts_char[:, i] & (i < sizes) & (best[:, i] > -np.inf))
            if not len(rows):
                continue
            char = np.ones(len(rows), np.int64)  # bytes of the character at i
            lead = grid[rows, i]
            for limit in (0xC0, 0xE0, 0xF0):
                char += lead >= limit
            single = np.zeros(len(rows), bool)
            live, state, k = np.arange(len(rows)), np.zeros(len(rows), np.int32), i
            while len(live) and k < width:
                at = rows[live]
                to = base[state] + grid[at, k] + 1
                ok = (k < sizes[at]) & (to < len(check))
                ok &= check[np.where(ok, to, 0)] == state
                live, state, k = live[ok], to[ok], k + 1
                found = value[state]
                end = found >= 0
                if end.any():
                    who, ids = live[end], found[end]
                    at = rows[who]
                    total = best[at, i] + self.score[ids]
                    better = total > best[at, k]
                    w = at[better]
                    best[w, k], back[w, k], piece[w, k] = total[better], i, ids[better]
                    single[who] |= char[who] == k - i
            lone = np.flatnonzero(~single)
            if len(lone):
                at, end = rows[lone], np.minimum(i + char[lone], sizes[rows[lone]])
                total = best[at, i] + self.worst
                better = total > best[at, end]
                w, e = at[better], end[better]
                best[w, e], back[w, e], piece[w, e] = total[better], i, -2
        out = []
        for r in range(n):
            ids, k = [], int(sizes[r])
            while k:
                i = int(back[r, k])
                if piece[r, k] >= 0:
                    ids.append(int(piece[r, k]))
                else:
                    for b in reversed(raws[r][i:k]):
                        ids.append(int(self.fallback[b]) if self.fallback[b] >= 0 else self.unknown)
                k = i
            out.append(np.array(ids[::-1], "<i4").tobytes())
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit numbers; an empty or null text has none."""
        out: list[bytes] = []
        for first in range(0, len(texts), 256):  # the new stretches of many texts are solved together
            marked = [MARKER + t.replace(" ", MARKER) if t else "" for t in texts[first : first + 256]]
            units = [_UNIT.findall(m) if self.breaks else [m] if m else [] for m in marked]
            wanted = set().union(*units)
            new = [u for u in wanted if u not in self.known]
            if len(self.known) + len(new) > CACHE_UNITS:
                self.known.clear()
                new = list(wanted)
            new.sort(key=len)
            a = 0
            while a < len(new):  # stretches of like length, at most 8192 or about a million bytes at once
                b = a + 1
                while b < len(new) and b - a < 8192 and (b + 1 - a) * 4 * len(new[b]) <= 1 << 20:
                    b += 1
                self.known.update(zip(new[a:b], self._solve(new[a:b])))
                a = b
            out += [b"".join(map(self.known.__getitem__, u)) for u in units]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: markers become spaces, byte pieces join to characters, the marker in front goes."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode_documents(documents: DataFrame, model_path: str, scores: str = "rank") -> DataFrame:
    """doc_id, ids, n_pieces, n_fallback (byte pieces), ids_crc32, decoded_crc32 and round_trip for every row.

    ``round_trip`` tells whether decoding the ids gives the text back; it fails only for texts that hold the
    whitespace marker itself. A null text counts as empty and has no ids.
    """
    schema = "doc_id long, ids array<int>, n_pieces int, n_fallback int, ids_crc32 long, decoded_crc32 long, round_trip boolean"
    shared = documents.sparkSession.sparkContext.broadcast(UnigramModel(model_path, scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: UnigramModel = shared.value
        is_byte = np.zeros(len(model.text), bool)
        is_byte[model.fallback[model.fallback >= 0]] = True
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                texts = batch.column(1).to_pylist()
                found = [np.frombuffer(x, "<i4") for x in model.encode(texts)]
                back = [model.decode(x) for x in found]
                edges = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = np.concatenate(found) if found else np.zeros(0, np.int32)
                columns = [
                    batch.column(0),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(flat, pa.int32())),
                    pa.array(np.diff(edges)),
                    pa.array([int(is_byte[x].sum()) for x in found], pa.int32()),
                    pa.array([zlib.crc32(x) for x in found], pa.int64()),
                    pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()),
                    pa.array([t == (u or "") for t, u in zip(back, texts)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_pieces", "n_fallback", "ids_crc32", "decoded_crc32", "round_trip"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
