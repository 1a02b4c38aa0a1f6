"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads a text's bytes as one stream, from both ends, and labels every byte position; a document's probabilities are
the mean over all of its positions. The stream is read in windows that overlap: the bytes before and after a window's own
stretch are read with it, so that the state has context there, but their labels come from the windows whose own they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder

#: Bounds on the labelled documents that the network is fitted on: how many, and the bytes of one; all bytes of those that are taken are read.
SAMPLE_ROWS, SAMPLE_BYTES = 1_000, 192_000
TRAINING_WIDTH = 96
#: Bytes of a window's own stretch, and of its context on either side.
STRETCH, CONTEXT = 480, 16
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """A character of Unicode's letter categories; fractions, powers and Roman numerals are none."""
    return any(map(str.isalpha, text))


def stream_windows(raw: bytes, stretch: int = STRETCH, context: int = CONTEXT) -> list[tuple[bytes, int, int]]:
    """(bytes, where the own stretch begins in them, where it ends) of each window; own stretches cover the text without overlap."""
    return [(raw[max(0, a - context) : a + stretch + context], min(a, context), min(a, context) + min(stretch, len(raw) - a)) for a in range(0, len(raw), stretch)]


def training_windows(raw: bytes, width: int = TRAINING_WIDTH) -> list[bytes]:
    return [raw[a : a + width] for a in range(0, len(raw), width)]


def padded(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as rows (0 where a row has ended; a zero byte counts as 1) and the lengths."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    width = int(lengths.max(initial=1))
    flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width).astype(np.int64)
    inside = np.arange(width) < lengths[:, None]
    return np.where(inside, np.maximum(flat, 1), 0), lengths


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class ByteGru:
    """Weights: one input table (256 x 3h), one recurrent matrix (h x 3h) and a bias for each direction; then the labels'."""

    languages: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], hidden: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        table = [rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32) for _ in range(2)]
        matrix = [rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32) for _ in range(2)]
        return cls(languages, table, matrix, rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    def _run(self, x: np.ndarray, way: int, keep: bool) -> tuple[np.ndarray, list]:
        """States (time x rows x h) of one direction; a row's state stands still outside its bytes."""
        table, matrix, h = self.inputs[way], self.recurrent[way], self.recurrent[way].shape[0]
        n, width = x.shape
        by_time = np.ascontiguousarray(x.T)
        whole = (by_time > 0).all(axis=1)
        state, states, kept = np.zeros((n, h), matrix.dtype), np.zeros((width, n, h), matrix.dtype), []
        for t in range(width) if way == 0 else reversed(range(width)):
            given, carried = table[by_time[t]], state @ matrix
            gates = given[:, : 2 * h] + carried[:, : 2 * h]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            update, reset = gates[:, :h], gates[:, h:]
            new = reset * carried[:, 2 * h :]
            new += given[:, 2 * h :]
            np.tanh(new, out=new)
            after = new + update * (state - new)
            inside = None if whole[t] else (by_time[t] > 0)[:, None]
            if inside is not None:
                after = np.where(inside, after, state)
            if keep:
                kept.append((t, state, update, reset, new, carried[:, 2 * h :], inside))
            states[t] = state = after
        return states, kept

    def _states(self, by_time: np.ndarray, way: int) -> np.ndarray:
        """As :meth:`_run` without what training keeps, and with units before rows (time x h x rows), so that each gate is one stretch of memory."""
        table, matrix = np.ascontiguousarray(self.inputs[way].T), np.ascontiguousarray(self.recurrent[way].T)
        h, (width, n) = matrix.shape[1], by_time.shape
        state, states = np.zeros((h, n), matrix.dtype), np.empty((width, h, n), matrix.dtype)
        ended = by_time == 0
        some = ended.any(axis=1)
        for t in range(width) if way == 0 else reversed(range(width)):
            given, carried = table.take(by_time[t], axis=1), matrix @ state
            gates, new, after = given[: 2 * h], carried[2 * h :], states[t]
            gates += carried[: 2 * h]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            new *= gates[h:]
            new += given[2 * h :]
            np.tanh(new, out=new)
            np.subtract(state, new, out=after)
            after *= gates[:h]
            after += new
            if some[t]:
                np.copyto(after, state, where=ended[t])
            state = after
        return states

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities of every byte position, time x rows x languages."""
        by_time, h = np.ascontiguousarray(x.T), self.recurrent[0].shape[0]
        logits = self.out[:h].T @ self._states(by_time, 0)
        logits += self.out[h:].T @ self._states(by_time, 1)
        logits += self.bias[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.transpose(0, 2, 1)

    def train(self, parts: list[bytes], labels: np.ndarray, epochs: int = 2, batch: int = 256, rate: float = 0.02, seed: int = 11) -> None:
        """Back-propagation through time with Adam; every position of a window has its document's label."""
        rng = np.random.default_rng(seed)
        weights = [*self.inputs, *self.recurrent, self.out, self.bias]
        mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step, order = 0, np.arange(len(parts))
        total = max(1, epochs * -(-len(parts) // batch))
        for _ in range(epochs):
            rng.shuffle(order)
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                x, _ = padded([parts[i] for i in chosen])
                grads = self._gradients(x, labels[chosen])
                step += 1
                pace = rate * (1 - step / (total + 1))
                for w, g, m, v in zip(weights, grads, mean, square):
                    np.clip(g, -1, 1, out=g)
                    m += 0.1 * (g - m)
                    v += 0.002 * (g * g - v)
                    w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        n, width = x.shape
        h = self.recurrent[0].shape[0]
        runs = [self._run(x, way, True) for way in (0, 1)]
        both = np.concatenate([runs[0][0], runs[1][0]], axis=2)
        logits = both @ self.out + self.bias
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        delta = e / e.sum(axis=2, keepdims=True)
        delta[:, np.arange(n), labels] -= 1
        inside = (x.T > 0)[:, :, None]
        delta = np.where(inside, delta / max(1, inside.sum()), 0).astype(np.float32)
        d_out, d_bias = np.einsum("tnh,tnl->hl", both, delta), delta.sum(axis=(0, 1))
        d_both = delta @ self.out.T
        d_inputs, d_recurrent = [], []
        for way, (_, kept) in enumerate(runs):
            matrix, d_state = self.recurrent[way], np.zeros((n, h), np.float32)
            d_table, d_matrix = np.zeros_like(self.inputs[way]), np.zeros_like(matrix)
            read, flows = [], []
            for t, before, update, reset, new, carried, there in reversed(kept):
                d_after = d_state + d_both[t][:, way * h : (way + 1) * h]
                d_now = d_after if there is None else np.where(there, d_after, 0)
                d_new = d_now * (1 - update) * (1 - new * new)
                d_update = d_now * (before - new) * update * (1 - update)
                d_reset = d_new * carried * reset * (1 - reset)
                d_given = np.concatenate([d_update, d_reset, d_new], axis=1)
                d_carried = np.concatenate([d_update, d_reset, d_new * reset], axis=1)
                read.append(x[:, t])
                flows.append(d_given)
                d_matrix += before.T @ d_carried
                d_state = (d_now * update if there is None else np.where(there, d_now * update, d_after)) + d_carried @ matrix.T
            order = np.argsort(np.concatenate(read), kind="stable")
            sorted_bytes, flow = np.concatenate(read)[order], np.concatenate(flows)[order]
            first = np.flatnonzero(np.append(True, sorted_bytes[1:] != sorted_bytes[:-1]))
            d_table[sorted_bytes[first]] = np.add.reduceat(flow, first)
            d_inputs.append(d_table)
            d_recurrent.append(d_matrix)
        return [*d_inputs, *d_recurrent, d_out, d_bias]


def document_probabilities(model: ByteGru, texts: list[str | None], rows: int = 256) -> tuple[list[str], np.ndarray]:
    """Each text's language and the mean probability of that language over all its byte positions.

    A null text, and one without a letter, is ``und`` with score 0. Ties go to the language that sorts first. The windows of
    many texts are read together, ``rows`` at a time and those of like length side by side.
    """
    sums, sizes = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    held: list[tuple[int, bytes, int, int]] = []

    def flush() -> None:
        held.sort(key=lambda w: len(w[1]))
        for a in range(0, len(held), rows):
            owner, parts, begin, end = zip(*held[a : a + rows])
            x, _ = padded(list(parts))
            p = model.positions(x)
            time = np.arange(x.shape[1])[:, None]
            own = (time >= np.array(begin)) & (time < np.array(end))
            np.add.at(sums, np.array(owner), np.einsum("tnl,tn->nl", p, own.astype(p.dtype)))
        held.clear()

    for k, text in enumerate(texts):
        if text is None or not has_letter(text):
            continue
        raw = text.encode("utf-8", "replace")
        sizes[k] = len(raw)
        for w in stream_windows(raw):
            held.append((k, *w))
            if len(held) >= 16 * rows:
                flush()
    if held:
        flush()
    mean = sums / np.maximum(sizes, 1)[:, None]
    best = mean.argmax(axis=1) if len(texts) else np.zeros(0, int)
    return [model.languages[b] if s else UNKNOWN for b, s in zip(best, sizes)], np.where(sizes > 0, mean[np.arange(len(texts)), best], 0.0)


def fit_language_model(documents: DataFrame, train: Column, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> ByteGru:
    """Fits on the whole texts of at most ``rows`` labelled documents of at most ``most_bytes`` each, the same ones on every run.

    Without labelled rows the model has no language to name, and everything is ``und``.
    """

    @F.pandas_udf("array<binary>")
    def cut_up(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: training_windows((t or "").encode("utf-8", "replace")))

    chosen = documents.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes)).select("doc_id", "lang", "text")
    ids = chosen.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(rows)
    sample = chosen.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id").select("doc_id", "lang", cut_up("text").alias("parts"))
    got = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(rows).collect()
    languages = sorted({r["lang"] for r in got})
    model = ByteGru.new(languages or [UNKNOWN])
    pairs = [(bytes(p), languages.index(r["lang"])) for r in got for p in r["parts"] if p]
    if len(languages) > 1:
        # a small sample is read more often, so that the weights move about as far
        model.train([p for p, _ in pairs], np.array([y for _, y in pairs], np.int64), epochs=max(2, min(20, 40_000 // len(pairs))))
    return model


def identify_languages(documents: DataFrame, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; the held-out fold's labels are never read."""
    aside = remainder(F.col("doc_id"), modulus) == held_out
    shared = documents.sparkSession.sparkContext.broadcast(fit_language_model(documents, ~aside))

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        found, score = document_probabilities(shared.value, texts.tolist())
        return pd.DataFrame({"lang_pred": found, "score": score})

    return documents.select("doc_id", aside.alias("held_out"), label("text").alias("found")).select("doc_id", "held_out", "found.*")
