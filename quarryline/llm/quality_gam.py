"""Quality classifier: an additive model with pairwise interactions, scored by adding up bins of lookup tables."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import AdditiveTables, sigmoid
from .common import labelled_sample, remainder

#: Bound on the labelled rows that the classifier is fitted on.
SAMPLE_ROWS = 20_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = (
    "log_words mean_word longest_word symbols_per_word symbols_share distinct_share top_word_share neighbour_repeats longest_run repeated_fives "
    "duplicate_lines blank_lines words_per_line capital_words capital_run exclamation_words sentence_ends commas digits non_ascii short_words packed_share letter_share"
).split()


def features(text: str | None) -> list[float]:
    """Shape of a whole text as numbers; the empty text has all-zero features."""
    t = text or ""
    words = _WORD.findall(t)
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(t)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = np.fromiter((a == b for a, b in zip(words, words[1:])), bool, n - 1)
    upper = np.fromiter((len(w) > 1 and w.isupper() for w in words), bool, n)
    symbols = len(re.findall(r"[#*$%&|<>]", t))
    lines = [x for x in t.split("\n") if x.strip()]
    fives: dict[int, int] = {}
    for i in range(n - 4):
        key = hash(tuple(words[i : i + 5]))
        fives[key] = fives.get(key, 0) + 1
    raw = t.encode("utf-8", "replace")
    return [
        np.log1p(n), sum(map(len, words)) / n, np.log1p(max(map(len, words))), symbols / n, symbols / size, len(counts) / n, max(counts.values()) / n, same.sum() / n,
        np.log1p(_longest(same)), sum(c for c in fives.values() if c > 1) / n,
        1 - len(set(lines)) / len(lines), 1 - len(lines) / (t.count("\n") + 1), np.log1p(n / len(lines)), upper.sum() / n, np.log1p(_longest(upper)),
        sum(w[-1] == "!" for w in words) / n, sum(w[-1] == "." for w in words) / n, t.count(",") / n, len(re.findall(r"\d", t)) / size, (len(raw) - size) / size,
        sum(len(w) <= 3 for w in words) / n, len(zlib.compress(raw, 1)) / len(raw), len(re.findall(r"[^\W\d_]", t)) / size,
    ]


def _longest(flags: np.ndarray) -> int:
    """Length of the longest run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def fit_quality(documents: DataFrame, labels: DataFrame, train: Column, rows: int = SAMPLE_ROWS) -> AdditiveTables:
    """Fits on at most ``rows`` labelled documents; with labels of one kind only, every text scores their smoothed share."""

    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    sample = labelled_sample(documents, labels, "quality", train, rows)
    got = sample.select("doc_id", "label", vector("text").alias("x")).toPandas().sort_values("doc_id")  # at most `rows` short vectors
    return AdditiveTables.fit(np.array(got["x"].tolist(), float).reshape(-1, len(NAMES)), got["label"].to_numpy(float))


def quality_score(model: AdditiveTables, documents: DataFrame):
    """A Column function text -> probability of good quality."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], float).reshape(-1, len(NAMES))
        return pd.Series(sigmoid(shared.value.margin(x)))

    return score


def score_quality(documents: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels of the held-out fold are never read."""
    model = fit_quality(documents, labels, remainder(F.col("doc_id"), modulus) != held_out)
    scored = documents.select("doc_id", (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"), quality_score(model, documents)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
