"""Containment of short and long passages, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarryline.operators import resolve
from quarryline.operators.resolve import catalog_matches, containing_documents


@pytest.fixture(params=["scanned", "joined"], autouse=True)
def way(request, monkeypatch):
    """Both ways of finding needles: by automata, and beyond their bound by a join."""
    if request.param == "joined":
        monkeypatch.setattr(resolve, "MOST_SCANNED", -1)


def tables(spark):
    rng = random.Random(4)
    words = ["ab", "AB-12", "1756-L8", "x", "é", "Straße", "cat:1756-L8", "the", "of"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 300)))) for k in range(20)] + [(None, "no id 1756-l8"), (3, "second AB12 text"), (90, None), (91, "")]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate([1, 1, 1, 2, 2, 3, 3, 4, 5, 6])]
    parts = [t[a : a + n] for (_, t), a, n in zip(docs, range(0, 40, 2), (1, 2, 3, 5, 9, 14, 30, 33, 50, 80))]
    items += [(100 + k, p) for k, p in enumerate(parts)] + [(200, "B-"), (201, "1756l8"), (202, "zz:ab12"), (203, ""), (204, None), (205, "é")]
    return items, docs, spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")


def test_passages_of_any_length(spark):
    items, docs, passages, documents = tables(spark)
    got = sorted(map(str, containing_documents(passages, documents).collect()))
    want = {(i, d) for i, p in items for d, t in docs if p and t is not None and p in t}
    assert len({len(p.split(" ")) for _, p in items if p}) > 6
    assert got == sorted(f"Row(item_id={i}, doc_id={d})" for i, d in want)


def test_catalog_matches(spark):
    items, docs, passages, documents = tables(spark)

    def compact(t):
        return re.sub("[^a-z0-9]", "", t.lower())

    def matches(text, number):
        found = [c for c in (number.strip(), number.split(":")[-1].strip()) if c]
        return any(c.lower() in text.lower() or len(compact(c)) >= 4 and compact(c) in compact(text) for c in found)

    want = {(i, d) for i, p in items for d, t in docs if p and t is not None and matches(t, p)}
    assert sorted(map(str, catalog_matches(passages, documents).collect())) == sorted(f"Row(item_id={i}, doc_id={d})" for i, d in want)


def test_rows_of_the_join_follow_the_hits(spark, way):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz "
    texts = ["".join(rng.choices(letters, k=2000)) for _ in range(200)]
    needles = [texts[k][100 : 100 + rng.choice([9, 20, 50])] for k in range(0, 200, 10)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = resolve.with_ends(spark.createDataFrame(list(enumerate(needles)), "item_id long, needle string"))
    rows = resolve.stretches_of_needles(wanted, documents)
    hits = rows.join(wanted.select("h"), "h").count()
    assert 20 <= hits <= rows.count() < 0.1 * sum(map(len, texts))  # one in sixteen bits is set at most, for each length of an end
    assert rows.select("h").distinct().join(wanted.select("h"), "h").count() == wanted.select("h").distinct().count()
    pairs = {(r["item_id"], r["doc_id"]) for r in resolve.substring_pairs(wanted.select("item_id", "needle"), documents).collect()}
    assert pairs == {(i, d) for i, n in enumerate(needles) for d, t in enumerate(texts) if n in t}


def test_no_needles_and_no_texts(spark):
    needles, texts = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "item_id long, needle string"), spark.createDataFrame([(1, "ba"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in resolve.substring_pairs(needles, texts).collect()] == [(1, 1)]
    assert resolve.substring_pairs(needles, texts.limit(0)).collect() == []
    if resolve.MOST_SCANNED > 0:
        assert resolve.substring_pairs(needles.filter(F.length("needle") == 0), texts).collect() == []
