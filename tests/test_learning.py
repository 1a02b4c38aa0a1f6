"""Learned places of values and translation by phrases, on small cases."""

import random

from quarryline.functions.phrases import PhraseAutomaton
from quarryline.operators import extractors, translate

from test_phrases import plain_apart, plain_spans


def page(width, extra=""):
    return f"<table class=a><tr><th>Width<td>{width}<tr><th>Height<td>9 mm</table>{extra}"


def test_places_are_learned_and_tried(spark):
    pages = [(1, "h", page("1 mm")), (2, "h", page("2 mm")), (3, "h", page("3 mm")), (4, "g", page("4 mm")), (5, "h", None), (6, "h", page("6 mm").replace("class=a", "class=b"))]
    texts = extractors.placed_texts(spark.createDataFrame(pages, "page_id int, host string, html string"))
    accepted = spark.createDataFrame([(1, "w", "1 MM"), (2, "w", "2 mm"), (1, "h", "9 mm"), (2, "h", "8 mm"), (4, "w", "4 mm"), (1, "x", None), (None, "w", "1 mm"), (9, "w", "1 mm")], "page_id int, field string, value string")
    learned = extractors.learned_extractors(texts, accepted)
    assert [(r.host, r.field, r.label, r.n_pages, r.share) for r in learned.collect()] == [("h", "w", "width", 2, 1.0)]
    got = extractors.extracted(texts.filter("page_id > 2"), learned)
    assert [(r.page_id, r.field, r.value) for r in got.collect()] == [(3, "w", "3 mm")]
    truth = spark.createDataFrame([(3, "w", "3 MM"), (4, "w", "4 mm"), (3, "h", "1")], "page_id int, field string, value string")
    assert {r.field: (r.n, r.found, r.right) for r in extractors.extractor_quality(got, truth).collect()} == {"w": (2, 1, 1), "h": (1, 0, 0)}
    assert extractors.learned_extractors(texts, accepted.filter("false")).count() == 0


def test_share_and_pages_that_are_asked(spark):
    pages = [(k, "h", page(f"{k} mm")) for k in range(10)]
    texts = extractors.placed_texts(spark.createDataFrame(pages, "page_id int, host string, html string")).cache()
    for right, least, want in ((8, 0.8, 1), (7, 0.8, 0), (7, 0.7, 1)):
        accepted = spark.createDataFrame([(k, "w", f"{k} mm" if k < right else "other") for k in range(10)], "page_id int, field string, value string")
        assert extractors.learned_extractors(texts, accepted, least_share=least).count() == want


def test_translation_like_plain_replacement(spark):
    rng = random.Random(8)
    words = ["rot", "der", "Motor", "mit", "x1", "é"]
    for _ in range(200):
        phrases = [" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(5)]
        targets = [f"t{i}" for i in range(5)]
        text = "".join(w + rng.choice([" ", ", ", "-"]) for w in rng.choices(words, k=12))
        want, shift = text, 0
        for begin, end, number in plain_apart(plain_spans(phrases, text)):
            target = targets[number].capitalize() if text[begin].isupper() else targets[number]
            want, shift = want[: begin + shift] + target + want[end + shift :], shift + len(target) - (end - begin)
        assert translate.translate_text(text, PhraseAutomaton(phrases), targets)[0] == want
    rows = spark.createDataFrame([(1, "Motor mit Bremse", "z"), (2, None, "z"), (3, "", "z")], "doc_id int, text string, phrase string")
    book = spark.createDataFrame([("motor", "engine"), ("mit Bremse", "with brake"), (None, "x"), ("Motor mit", None)], "phrase string, target string")
    assert sorted(map(tuple, translate.translated(rows, book).collect())) == [(1, "Engine with brake", 3, 3), (2, None, 0, 0), (3, "", 0, 0)]
    assert translate.translated(rows, book.filter("false")).filter("doc_id = 1").first().text == "Motor mit Bremse"
