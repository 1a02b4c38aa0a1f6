"""Texts in another language by a dictionary of phrases: the longest phrases that don't overlap are replaced, the rest stays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.phrases import PhraseAutomaton, longest_apart, words_of

#: A dictionary of more phrases isn't collected.
MOST_PHRASES = 100_000


def translate_text(text: str, automaton: PhraseAutomaton, targets: list[str]) -> tuple[str, int, int]:
    """The text with its longest phrases replaced, the number of its words that they cover, and of all its words. A capital stays one."""
    out, at, covered = [], 0, 0
    for begin, end, number in longest_apart(automaton.spans(text)):
        target = targets[number]
        out += [text[at:begin], target[:1].upper() + target[1:] if text[begin].isupper() else target]
        covered, at = covered + len(words_of(text[begin:end])), end
    return "".join([*out, text[at:]]), covered, len(words_of(text))


def translated(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, text, n_covered, n_words of (doc_id, text) by a dictionary (phrase, target).

    Phrases are collected behind a check of their number and found in one pass. Of phrases that are equal but for case the first by target
    counts; a null target removes nothing. Null texts stay null with no words. Further columns are not read.
    """
    listed = dictionary.filter("phrase is not null and target is not null").select("phrase", "target").orderBy("phrase", "target").limit(MOST_PHRASES + 1).collect()
    if len(listed) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases")
    sent = texts.sparkSession.sparkContext.broadcast([(r.phrase, r.target) for r in listed])
    kind = dict(texts.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, targets = PhraseAutomaton([p for p, _ in sent.value]), [t for _, t in sent.value]
        for batch in batches:
            made = [(None, 0, 0) if t is None else translate_text(t, automaton, targets) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), *[pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_covered", "n_words"])

    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, n_covered int, n_words int")
