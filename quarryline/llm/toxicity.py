"""Toxicity scores: boosted trees over dense lexicon and style features, calibrated by isotonic steps.

The features are densities, rates and proximities of the whole text. Two lexicons feed them: a short fixed list
of insults, and terms (words and word beginnings) learned from the labelled sample by their share of toxic documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, Isotonic, sigmoid
from .common import labelled_sample, remainder

#: Bound on the labelled rows that the classifier is fitted on; a learned term stands in four toxic ones of them or more.
SAMPLE_ROWS = 20_000
#: Parts of the sample, by a hash of the id: part 0 calibrates, the others train, each with terms learned on the other two.
PARTS = 8
#: Insults, second-person words, letters that digits and signs stand for.
INSULTS = frozenset("idiot idiots stupid moron dumb loser trash scum pathetic worthless disgusting clown ugly hate kill shut freak jerk fool garbage filth".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine sie ihr ihnen tu te toi ton ta vous votre vos ti tú usted ustedes vosotros vuestro su sus".split())
STANDS_FOR = str.maketrans("0134578@$!", "oieastbasi")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^\W+|\W+$")
_MIXED = re.compile(r"[^\W\d_](?:[\d@$!*_.\-]+)[^\W\d_]")
#: Signs around a word that hide nothing, and what hides a letter wherever it stands.
_AROUND = ".,;:?!\"'()[]"
_STAND_IN = re.compile(r"[\d@$!*_.\-]")
_MASKED = frozenset(w[:k] + "*" * n + w[k + n :] for w in INSULTS for n in (1, 2) for k in range(len(w) - n + 1) if len(w) > n + 1)
_NAMES = (
    "learned_words learned_stems learned_per_1000 strongest mean_strength fixed_words fixed_per_1000 hidden_words near_second_person "
    "second_person_rate capitals all_capitals exclamation question other_signs digits mixed_rate repeated_letters log_words mean_word"
).split()


def plain(word: str) -> str:
    """Lower case, without signs at its ends."""
    return _EDGE.sub("", word.lower())


def unhidden(word: str) -> str:
    """What an obfuscated word stands for: ``1d10t``, ``@sshole`` and ``i.d.i.o.t`` become letters."""
    return re.sub(r"[\W_]+", "", word.lower().strip(_AROUND).translate(STANDS_FOR))


def is_hidden(word: str, lexicon: dict[str, float]) -> str | None:
    """The listed term that a word with stand-ins spells, at any place of it; with stars for one or two letters, an insult only."""
    core = word.lower().strip(_AROUND)
    if not _STAND_IN.search(core):
        return None
    clear = unhidden(core)
    if clear in INSULTS or clear in lexicon:
        return clear
    return core if core in _MASKED else None


def stems(word: str) -> list[str]:
    """Word beginnings of four to six letters, marked by a star."""
    return [word[:n] + "*" for n in (4, 5, 6) if len(word) > n]


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    raw = _WORD.findall(text or "")
    words = [plain(w) for w in raw]
    n = max(1, len(words))
    strengths, by_word, by_stem, fixed, hidden, hits, second = [], 0, 0, 0, 0, [], []
    mixed = 0
    for k, w in enumerate(words):
        s = lexicon.get(w)
        if s is not None:
            by_word += 1
        else:
            for stem in stems(w):
                if (found := lexicon.get(stem)) is not None and found > (s or 0):
                    s = found
            by_stem += s is not None
        if w in INSULTS:
            fixed += 1
            s = s or 1.0
        elif s is None and not raw[k].isalpha():
            mixed += _MIXED.search(raw[k]) is not None
            if clear := is_hidden(raw[k], lexicon):
                hidden += 1
                s = lexicon.get(clear, 1.0)
        if s is not None:
            strengths.append(s)
            hits.append(k)
        if w in SECOND_PERSON:
            second.append(k)
    near = 0
    if hits and second:
        at = np.array(second)
        place = np.searchsorted(at, hits)
        gap = np.minimum(np.abs(at[np.minimum(place, len(at) - 1)] - hits), np.abs(at[np.maximum(place - 1, 0)] - hits))
        near = int((gap <= 5).sum())
    t = text or ""
    size = max(1, len(t))
    letters = sum(map(len, words)) or 1
    capitals = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", t))
    return [
        np.log1p(by_word), np.log1p(by_stem), 1000 * (by_word + by_stem) / n, max(strengths, default=0.0), sum(strengths) / max(1, len(strengths)),
        np.log1p(fixed), 1000 * fixed / n, hidden, near,
        len(second) / n, capitals / letters, sum(len(w) > 1 and w.isupper() for w in raw) / n, t.count("!") / size, t.count("?") / size,
        len(re.findall(r"[#*$%&|<>@~^]", t)) / size, len(re.findall(r"\d", t)) / size, mixed / n, len(re.findall(r"([^\W\d_])\1\1", t)) / n, np.log1p(len(words)), letters / n,
    ]


def learn_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Terms whose share of toxic documents is far above the sample's, with their log odds: one lexicon for each part.

    That of part 0 is learned on all other parts, that of another on the two besides it and part 0, so no document's features
    come from its own label. ``sample`` has text, label and part. Counted by Spark over the bounded sample: each
    document counts once for each of its terms.
    """

    @F.pandas_udf("array<string>")
    def distinct_terms(texts: pd.Series) -> pd.Series:
        def of(text):
            words = {plain(w) for w in _WORD.findall(text or "")} - {""}
            return [*words, *{s for w in words for s in stems(w)}]

        return texts.map(of)

    learned = [[q for q in range(1, PARTS) if q != part] for part in range(PARTS)]
    sums = [c for q in range(1, PARTS) for c in (F.sum(F.when(F.col("part") == q, F.col("label"))).alias(f"ones{q}"), F.count(F.when(F.col("part") == q, 1)).alias(f"rows{q}"))]
    base = sample.agg(*sums).first()
    counted = sample.filter("part > 0").select("label", "part", F.explode(distinct_terms("text")).alias("term")).groupBy("term").agg(*sums)
    odds = []
    for k, parts in enumerate(learned):
        total, rows = (sum(base[f"{c}{q}"] or 0 for q in parts) for c in ("ones", "rows"))
        if not 0 < total < rows:
            odds.append(F.lit(None).cast("double").alias(f"odds{k}"))
            continue
        ones, n = (sum((F.coalesce(F.col(f"{c}{q}"), F.lit(0)) for q in parts), F.lit(0)) for c in ("ones", "rows"))
        odd = F.log((ones + 0.5) / (n - ones + 0.5)) - float(np.log(total / (rows - total)))
        spread = F.sqrt(1 / (ones + 0.5) + 1 / (n - ones + 0.5))
        odds.append(F.when((ones >= 4) & (odd > 2) & (odd / spread > 3.5), odd).alias(f"odds{k}"))
    strong = counted.select("term", *odds).filter(F.coalesce(*[f"odds{k}" for k in range(PARTS)]).isNotNull()).collect()
    return [{r["term"]: r[f"odds{k}"] for r in strong if r[f"odds{k}"] is not None} for k in range(PARTS)]


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: BoostedTrees
    steps: Isotonic

    def score(self, texts) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts], float).reshape(-1, len(_NAMES))
        margin = self.trees.margin(x)
        # a little of the raw probability orders documents that share a calibrated step
        return np.clip(0.999 * self.steps.apply(margin) + 0.001 * sigmoid(margin), 0, 1)


def fit_toxicity(documents: DataFrame, labels: DataFrame, train: Column, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fits on at most ``rows`` labelled documents; a quarter of them, chosen by hash, calibrates and is seen by nothing else.

    The trees learn from features whose lexicon comes from other documents, as it does for a text that is scored.
    Without labels of both kinds, every text scores the smoothed share of ones.
    """
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).cast("int").alias("part")
    sample = labelled_sample(documents, labels, "toxic", train, rows).select("doc_id", "text", "label", part).persist()
    lexicons = learn_lexicons(sample)
    shared = sample.sparkSession.sparkContext.broadcast(lexicons)

    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([features(t, shared.value[p]) for t, p in zip(texts, parts)], dtype=object)

    got = sample.select("doc_id", "label", "part", vector("text", "part").alias("x")).toPandas().sort_values("doc_id")  # at most `rows` short vectors
    sample.unpersist()
    x, y = np.array(got["x"].tolist(), float).reshape(-1, len(_NAMES)), got["label"].to_numpy(float)
    aside = got["part"].to_numpy() == 0
    trees = BoostedTrees.fit(x[~aside], y[~aside])
    return ToxicityModel(lexicons[0], trees, Isotonic.fit(trees.margin(x[aside]), y[aside]) if aside.any() else Isotonic(np.array([-5.0, 5.0]), sigmoid(np.array([-5.0, 5.0]))))


def toxicity_score(model: ToxicityModel, documents: DataFrame):
    """A Column function text -> score; null and empty texts are scored from their (zero) features."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts))

    return score


def score_toxicity(documents: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels of the held-out fold are never read."""
    model = fit_toxicity(documents, labels, remainder(F.col("doc_id"), modulus) != held_out)
    scored = documents.select("doc_id", (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"), toxicity_score(model, documents)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
