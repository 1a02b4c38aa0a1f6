"""Phrases in texts against plain search, and specifications mined from prose."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarryline.functions.phrases import PhraseAutomaton, longest_apart
from quarryline.operators.spec_miner import LABEL_SCHEMA, default_labels, label_spans, mined_specs


def plain_spans(phrases, text):
    """All places of phrases, each phrase by a pattern of its own."""
    out = set()
    for number, phrase in enumerate(phrases):
        words = re.findall(r"[^\W_]+", phrase)
        if words:
            pattern = r"(?<![^\W_])" + r"[\s _./-]{1,3}".join(map(re.escape, words)) + r"(?![^\W_])"
            for m in re.finditer(f"(?=({pattern}))", text, re.I):
                out.add((m.start(), m.start() + len(m[1]), number))
    return sorted(out)


def plain_apart(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[2])):
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


def test_automaton_and_choice_like_plain_search():
    rng = random.Random(4)
    words = ["a", "b", "ab", "é", "c1"]
    for _ in range(400):
        phrases = [" ".join(rng.choices(words, k=rng.randrange(4))) for _ in range(6)]
        text = "".join(rng.choice([w, w.upper()]) + rng.choice([" ", "-", ", ", "  ", "\n", "    ", "_"]) for w in rng.choices(words, k=14))
        spans = PhraseAutomaton(phrases).spans(text)
        assert sorted(spans) == plain_spans(phrases, text)
        assert longest_apart(spans) == plain_apart(spans)


def test_many_nested_phrases():
    text = "x " * 3000
    spans = PhraseAutomaton(["x", "x x", "x x x"]).spans(text)
    kept = longest_apart(spans)
    assert len(kept) == 1000 and all(b - a == 5 for a, b, _ in kept) and PhraseAutomaton([]).spans(text) == [] and PhraseAutomaton(["", "!"]).spans(text) == []


def labels(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], LABEL_SCHEMA)


def texts(spark, *rows):
    return spark.createDataFrame([(i, t, "odd") for i, t in enumerate(rows)], "doc_id long, text string, begin string")


def test_spans(spark):
    table = labels(spark, ("long", "voltage", "rated voltage", False), ("short", "voltage", "voltage", False), ("symbol", "voltage", "Ue", True), ("none", "voltage", None, False), ("again", "voltage", "VOLTAGE", False))
    got = label_spans(texts(spark, "Rated-Voltage 5 V, voltage 6 V; ue Ue", None, "", "\U0001f642 voltage"), table).orderBy("doc_id", "begin").collect()
    assert [(r.doc_id, r.begin, r.end, r.key, r.label, r.after) for r in got] == [(0, 0, 13, "long", "Rated-Voltage", " 5 V, "), (0, 19, 26, "again", "voltage", " 6 V; ue "), (0, 35, 37, "symbol", "Ue", ""), (3, 2, 9, "again", "voltage", "")]
    assert label_spans(texts(spark), table).count() == 0 and label_spans(texts(spark, "voltage"), table.filter("false")).count() == 0


@pytest.mark.parametrize("text, want", [
    ("Rated voltage: 24 V DC, rated current is 5 A", [("Rated voltage", "24 V DC"), ("Rated current", "5 A")]), ("insulation voltage = 690 V", [("Rated insulation voltage", "690 V")]), ("the coil resistance, control voltage 24 V", []),
    ("Operating voltage (type A operation) 50 V", []), ("Net weight - 2 kg", [("Net weight", "2 kg")]), ("Operating temperature -25 to 60 °C", [("Operating temperature", "-25 to 60 °C")]), ("Rated voltage of the thing 5 A", []), ("Ui 500 V, ui 5 V", [("Rated insulation voltage", "500 V")]),
    ("rated current " + "x" * 230 + " 5 A", []), ("leakage current of 3 mA at 40 °C", [("Leakage current", "3 mA at 40 °C")]), ("rated voltage 24VDC", [("Rated voltage", "24VDC")]),
])
def test_mined_specs(spark, text, want):
    got = mined_specs(texts(spark, text), default_labels(spark)).orderBy("begin").collect()
    assert [(r.key, r.value) for r in got] == want and all(text[r.begin : r.end] == r.label for r in got)


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr("quarryline.operators.spec_miner.MOST_LABELS", 1)
    with pytest.raises(ValueError):
        label_spans(texts(spark, "x"), labels(spark, ("a", None, "x", False), ("b", None, "y", False)))
    assert label_spans(texts(spark, "x"), labels(spark, ("a", None, "x", False))).select(F.max("end")).first()[0] == 1


def test_equal_texts_are_mined_once(spark):
    from quarryline.operators.spec_miner import default_labels, mined_specs

    rows = [(k, "The net weight is 5 kg." if k % 2 else "Leakage current: 7 mA") for k in range(50)] + [(None, "The net weight is 5 kg."), (60, None), (1, "Leakage current: 7 mA")]
    made = mined_specs(spark.createDataFrame(rows, "doc_id long, text string"), default_labels(spark))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert all("Aggregate" in part for part in plan.split("MapInArrow")[1:])
    assert sorted((str(r.doc_id), r.key, r.value) for r in made.collect()) == sorted((str(i), *(("Net weight", "5 kg") if "weight" in t else ("Leakage current", "7 mA"))) for i, t in rows if t)
