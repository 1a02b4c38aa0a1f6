"""Quality rules as weak supervision: rules vote or abstain, and a posterior replaces all-must-pass filtering.

Every rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of vote patterns
(at most 3 to the number of rules, whatever the corpus) estimates the share of good documents and each rule's
accuracy on good and on bad ones; a document's posterior follows from its pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def covered_by_repeats(words: list[str], window: int = 5) -> int:
    """Words that lie in a ``window``-word sequence found twice or more in the list, the first finding included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    rank = ids[:n].copy()
    for k in range(1, window):  # ranks of ever longer sequences, exact at each step
        _, rank, counts = np.unique(rank * (len(words) + 1) + ids[k : k + n], return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[rank] > 1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((edge.cumsum()[:-1] > 0).sum())


#: Longest block in which distinct words are counted: their share falls with the length of a text, so blocks keep it comparable.
VARIETY_WORDS = 5000


def repeated_share(words: list[str], most: int = VARIETY_WORDS) -> float:
    """Share of words that are not the first of their kind in their block; the list is cut into equal blocks of at most ``most`` words."""
    n = len(words)
    blocks = -(-n // most)
    edges = [n * k // blocks for k in range(blocks + 1)] if n else [0]
    return 1 - sum(len(set(words[a:b])) for a, b in zip(edges, edges[1:])) / max(1, n)


def measure(text: str | None) -> dict[str, float]:
    t = text or ""
    words = _WORD.findall(t)
    seen: set[str] = set()
    dup = lines = 0
    for line in t.split("\n"):
        if _WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(_SYMBOL.findall(t)),
        "n_dup_lines": dup,
        "n_repeat_words": covered_by_repeats(words),
        "n_lines": lines,
        "n_distinct": len(set(words)),
        "same_share": repeated_share(words),
        "n_same": sum(a == b for a, b in zip(words, words[1:])),
        "n_upper": sum(len(w) > 2 and w.isupper() for w in words),
        "n_exclaimed": sum(w[-1] == "!" for w in words),
    }


#: Share of the good documents on which a rule may vote bad.
MOST_WRONG = 0.02


def _band(value: float, good: float, bad: float) -> int:
    """Good at ``good`` or below, bad above ``bad``."""
    return 1 if value <= good else -1 if value > bad else 0


#: Name and vote of each rule; m: a document's measures, n: its number of words (at least 1).
RULES: list[tuple[str, Callable[[dict, int], int]]] = [
    ("symbols", lambda m, n: _band(m["n_symbols"] / n, 0.02, 0.3)),
    ("duplicate_lines", lambda m, n: _band(m["n_dup_lines"] / m["n_lines"], 0.05, 0.5) if m["n_lines"] > 1 else 0),
    ("repeated_sequences", lambda m, n: _band(m["n_repeat_words"] / n, 0.05, 0.2) if n >= 10 else 0),
    ("word_length", lambda m, n: 1 if 3 <= m["word_chars"] / n <= 10 else -1 if not 2 <= m["word_chars"] / n <= 16 else 0),
    ("enough_words", lambda m, n: 1 if n >= 40 else 0),
    ("variety", lambda m, n: _band(m["same_share"], 0.55, 0.8) if n >= 20 else 0),
    ("capitals", lambda m, n: _band(m["n_upper"] / n, 0.02, 0.3) if n >= 5 else 0),
    ("stutter", lambda m, n: _band(m["n_same"] / n, 0.03, 0.2) if n >= 5 else 0),
    ("exclamation", lambda m, n: _band(m["n_exclaimed"] / n, 0.02, 0.2) if n >= 5 else 0),
]


def votes(m: dict[str, float]) -> int:
    """The pattern of votes as a base-3 number."""
    n = max(1, int(m["n_words"]))
    code = 0
    for _, rule in RULES:
        code = 3 * code + rule(m, n) + 1
    return code


def unpack_votes(codes: np.ndarray, rules: int) -> np.ndarray:
    return np.stack([codes // 3 ** (rules - 1 - r) % 3 - 1 for r in range(rules)], axis=1)


def fit_posteriors(codes: np.ndarray, counts: np.ndarray, rules: int = len(RULES), rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, accuracies (rule x bad, good), and the share of good documents.

    The rules watch for different faults, so given "bad" their votes aren't independent; bad is therefore one hidden
    class for each rule's fault. EM starts from a document with bad votes having one of those faults (0.9 in all) and
    estimates each class's share and each rule's chance to vote bad in it when it votes; abstaining says nothing. A rule
    is held to vote bad on at most ``MOST_WRONG`` of the good documents: that is what makes the first class the good one.
    A rule's accuracies are its chances to vote bad on bad documents and good on good ones, when it votes.
    """
    v = unpack_votes(codes, rules)
    bad = (v == -1).astype(float)
    faults = bad.sum(axis=1, keepdims=True)
    member = np.concatenate([np.where(faults > 0, 0.1, 0.9), np.where(faults > 0, 0.9 * bad / np.maximum(faults, 1), 0.1 / rules)], axis=1)
    good = (v == 1).astype(float)
    share, chance = np.full(rules + 1, 1 / (rules + 1)), np.full((rules + 1, rules), 0.5)
    for _ in range(rounds if counts.sum() else 0):
        weight = counts[:, None] * member
        soft = 0.001 * counts.sum() + 1e-9  # pseudo-documents of each class
        ones, voted = weight.T @ bad, weight.T @ (bad + good)
        chance = (ones + 0.1 * soft) / (voted + soft)
        chance[1:][np.diag_indices(rules)] = ((ones[1:] + 0.9 * soft) / (voted[1:] + soft))[np.diag_indices(rules)]
        chance[0] = np.minimum(chance[0], MOST_WRONG)
        share = (weight.sum(axis=0) + soft) / (weight.sum() + soft * (rules + 1))
        score = bad @ np.log(chance).T + good @ np.log(1 - chance).T + np.log(share)
        new = np.exp(score - score.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        moved, member = np.abs(new - member).max(initial=0), new
        if moved < 1e-9:
            break
    on_bad = (share[1:, None] * chance[1:]).sum(axis=0) / share[1:].sum()
    return member[:, 0], np.stack([on_bad, 1 - chance[0]], axis=1), float(share[0])


def judge_quality(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, posterior for every document.

    A null text counts as empty, has no words and fails the base rule. Rows that repeat an id are each judged.
    """
    extra = ("pattern",)

    @F.pandas_udf(", ".join(f"{c} long" for c in (*BASE, *extra)))
    def measured(texts: pd.Series) -> pd.DataFrame:
        found = [measure(t) for t in texts]
        return pd.DataFrame([[*(m[c] for c in BASE), votes(m)] for m in found], columns=[*BASE, *extra])

    rows = cut(documents.select("doc_id", measured("text").alias("m")).select("doc_id", "m.*"))
    patterns = rows.groupBy("pattern").count().orderBy("pattern").toPandas()  # at most 3 ** rules rows
    posterior, _, _ = fit_posteriors(patterns["pattern"].to_numpy(np.int64), patterns["count"].to_numpy(float))
    known = dict(zip(patterns["pattern"].tolist(), posterior.tolist()))
    table = rows.sparkSession.createDataFrame(list(known.items()) or [(0, 0.5)], "pattern long, posterior double")
    judged = rows.join(F.broadcast(table), "pattern", "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select(
        "doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.col("posterior") >= threshold)).alias("kept"), "posterior"
    )
