"""Repair from evidence: readers, points, images, the fixed point against plain loops, odd rows, and decisions on retries."""

import random

import pytest

from quarryline.operators import repair

EVIDENCE = "item int, ord int, group string, name string, value string, source_url string, source_type string, parser string, stage string, confidence double"


def evidence(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (10 - len(r))) for r in rows], EVIDENCE)


def best(frame):
    return {(r["item"], r["field"]): r["value"] for r in frame.collect()}


def test_what_labels_and_values_say(spark):
    said = [
        ("Net weight", "about 2.5 kg (5.5 lb)", "weight", "2.5 kg"), ("Weight", "24 months", "weight", None), ("Dimensions", "120 x 80  x 60 mm", "dimensions", "120 x 80 x 60 mm"), ("Size", "12 x 3 m²", "dimensions", None),
        ("Package dimensions", "1 x 2 x 3 cm", "dimensions", None), ("Note", "made of stainless steel", "material", "stainless steel"), ("Material", "Aluminium", "material", "aluminum"), ("Werkstoff", "Edelstahl V2A", "material", "stainless steel Type 304"), ("Fuse", "glass body", "typeCode", None),
        ("Note", "cULus, rohs and CE; IEC 60947-1", "certificates", "cULus; CE; RoHS; IEC 60947-1"), ("Rating", "IP65 inside", "certificates", None), ("Protection class", "ip 65, NEMA Type 4X, type 12", "protection", "ip65; NEMA Type 4X; Type12"), ("Rated voltage", "24...230 V AC/DC 50 Hz", "voltage", "24...230 V AC/DC 50 Hz"),
        ("Rated current", ">= 0,5 A", "current", ">= 0,5 A"), ("Operating temperature", "-20 to 60 °C", "operatingTemperature", "-20..60 °C"), ("Storage temperature range", "-40 to 70 °C", "operatingTemperature", None), ("Colour", "RAL 7035", "color", "RAL 7035"),
        ("Type code", "x" * 121, "typeCode", None), ("Type code", "AB 12", "typeCode", "AB 12"), ("", "", "weight", None), (None, None, "material", None), ("Weight", "1 kg " * 20_000, "weight", "1 kg"),
    ]
    got = best(repair.evidence_values(evidence(spark, [(i, 1, None, name, value) for i, (name, value, *_) in enumerate(said)] + [(None, 1, None, "Weight", "1 kg")])))
    assert [got.get((i, field)) for i, (*_, field, _) in enumerate(said)] == [want for *_, want in said]
    assert all(item is not None for item, _ in got)


def test_texts_that_say_nothing_are_not_read(spark, monkeypatch):
    """Many texts that differ in each row go at one pattern; they don't keep the others from being broadcast, and none that says something goes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(repair.broadcast_if_few, "__defaults__", (20, 1_000))
    noise = [(i, 2, None, "Gallery", f"see /img/p-{i}.png", "u", "official") for i in range(100)]
    found = repair.evidence_values(evidence(spark, [(1, 1, None, "Weight", "1 kg", "u", "official"), *noise]))
    assert best(found) == {(1, "weight"): "1 kg"} and "Exchange hashpartitioning(_label" not in found._jdf.queryExecution().executedPlan().toString()
    said = ["weight 1 kg", "Mat\u00e9riau: x", "a\u00a0steel", "in CE", "IEC\t60947-1", "&#119;eight 1 kg", "type  code AB", "IP65", "ambient&nbsp;temperature -20 to 60 \u00b0C", "(RAL 7035)", "x\u212aweight 2 kg", "made of pvc", "nothing", "", "steelworks", "ULx", "overall 1 x 2 mm"]
    rows = spark.createDataFrame([(a, b) for a in said for b in said], "l string, v string").select(repair._clean(F.col("l")).alias("l"), repair._clean(F.col("v")).alias("v"), repair.clean_text(F.col("v")).alias("plain"))
    got = rows.select("v", "plain", repair._says(F.col("l"), F.col("v")).alias("says"), (F.size(repair._readings(F.col("l"), F.col("v"))) > 0).alias("read")).collect()
    assert all(r.v == r.plain and (r.says or not r.read) for r in got) and {r.says for r in got} == {True, False}


def test_rounds_take_fields_of_any_name_and_smallest_held_values(spark):
    missing = spark.createDataFrame([(i, f) for i in (1, 2, 3, 4) for f in ("weight", "grip", "image")], "item int, field string")
    held = spark.createDataFrame([(1, "grip", "b"), (1, "grip", "a"), (1, "grip", "a"), (5, "grip", "0"), (5, "weight", "9 kg"), (2, None, "x"), (None, "grip", "x")], "item int, field string, value string")
    bases = spark.createDataFrame([(2, 1), (3, 2), (4, 1), (4, 5)], "item int, base int")
    got = repair.repair_from_evidence(missing, evidence(spark, [(1, 1, None, "Weight", "1 kg", "u", "official"), (5, 1, None, "Weight", "5 kg", "u", "official")]), None, bases, held).collect()
    assert sorted((r["item"], r["field"], r["value"], r["from_item"], r["round"]) for r in got) == [
        (1, "grip", "a", 1, 0), (1, "weight", "1 kg", 1, 0), (2, "grip", "a", 1, 1), (2, "weight", "1 kg", 1, 1), (3, "grip", "a", 1, 2), (3, "weight", "1 kg", 1, 2), (4, "grip", "a", 1, 1), (4, "weight", "9 kg", 5, 1),
    ]


def test_completeness_meets_each_field_once(spark):
    from quarryline.operators import devices

    need = spark.createDataFrame([(i, "weight", "preferred") for i in (1, 2, 3, 4, None, 1)], "item int, field string, requirement string")
    rows = lambda *xs: spark.createDataFrame([(*x[:1], "weight", *x[1:]) for x in xs], "item int, field string, value string")
    got = devices.completeness(need, rows((1, "a"), (1, "b"), (2, ""), (2, None)), rows((1, "a"), (2, "c"), (3, "d"), (None, "x")), rows((2, "c"), (2, "c"), (None, "x")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1
    assert sorted((r["item"] or 0, r["status"]) for r in got.collect()) == [(0, "missing"), (1, "present"), (1, "present"), (2, "found-after-repair"), (3, "found-after-retry"), (4, "missing")]


def test_points_choose_the_reading(spark):
    rows = [
        (1, 1, None, "Gross weight", "3 kg", "u", "official", "pdf", None, 1.0), (1, 2, None, "Net weight", "2 kg", "u", "official", "pdf", None, 0.9), (2, 2, None, "Weight", "5 kg", "u", "official"), (2, 1, None, "Weight", "4 kg", "u", "official"),
        (3, 1, None, "Weight", "6 kg", "u", "distributor", "pdf", None, 0.2), (3, 2, None, "Weight", "7 kg", "u", "generated"), (4, 1, None, "Weight", "9 kg", "u", "official"), (4, 1, None, "Weight", "8 kg", "u", "official"),
    ]
    got = {r["item"]: (r["value"], r["points"], r["confidence"]) for r in repair.evidence_values(evidence(spark, rows)).collect()}
    assert got == {1: ("2 kg", 169, 0.78), 2: ("4 kg", 100, 0.72), 3: ("7 kg", 75, 0.72), 4: ("8 kg", 100, 0.72)}


def test_images_lie_on_the_makers_host(spark):
    rows = [
        (1, 1, None, "g", "/img/logo-ab1.png '/img/AB-1.jpg'", "https://a.example/p"), (2, 1, None, "g", "https://other.example/ab2.png", "https://a.example/p"), (3, 1, None, "g", "https://cdn.a.example/media/x.webp?w=1", None),
        (4, 1, None, "g", "https://other.example/AB4.png", None), (5, 1, None, "g", "/gallery/ab5.jpg", None), (6, 1, None, "g", "//a.example/ab6.jpeg", None), (7, 1, None, "g", "https://nota.example/ab7.png", None),
    ]
    items = spark.createDataFrame([(i, f"AB-{i}", None if i == 4 else ["a.example"]) for i in range(1, 8)], "item int, key string, hosts array<string>")
    got = best(repair.image_values(evidence(spark, rows), items))
    assert got == {(1, "image"): "https://a.example/img/AB-1.jpg", (3, "image"): "https://cdn.a.example/media/x.webp?w=1", (4, "image"): "https://other.example/AB4.png", (6, "image"): "https://a.example/ab6.jpeg"}


@pytest.mark.parametrize("seed", [1, 2])
def test_the_fixed_point_equals_plain_rounds(spark, seed):
    rng = random.Random(seed)
    n = 60
    own = {i: f"{i + 1} kg" for i in range(n) if rng.random() < 0.12}
    sources = {i: rng.choice(["official", "distributor"]) for i in own}
    held = {i: f"held {i}" for i in range(n) if i not in own and rng.random() < 0.05}
    conflict = {i for i in range(n) if rng.random() < 0.08}
    wanted = {i for i in range(n) if i not in held and rng.random() < 0.85}
    bases = {(i, rng.randrange(n)) for i in range(n) for _ in range(rng.choice([0, 1, 2]))} | {(5, 6), (6, 7), (7, 5)}
    bases |= {(i, 3) for i in range(20, 50)}  # one base of very many
    # in plain rounds
    points = lambda i: 1000 if i in held else 100 if sources[i] == "official" else 45
    has = {i: (v, points(i), i) for i, v in {**own, **held}.items() if i not in conflict}
    want, news, at = {i: (has[i][0], i, 0) for i in wanted - conflict if i in has}, dict(has), 0
    still = wanted - conflict - set(has)
    while news:
        at += 1
        offers = {i: [(-news[b][1], news[b][2], news[b][0]) for x, b in bases if x == i and b in news] for i in still}
        news = {i: (min(o)[2], -min(o)[0], min(o)[1]) for i, o in offers.items() if o}
        want.update({i: (v, origin, at) for i, (v, _, origin) in news.items()})
        still -= set(news)
    pairs = lambda xs: spark.createDataFrame([(i, "weight") for i in xs] * 2 + [(None, "weight"), (1, None)], "item int, field string")
    got = repair.repair_from_evidence(
        pairs(wanted), evidence(spark, [(i, 1, None, "Weight", v, "u", sources[i]) for i, v in own.items()] * 2), spark.createDataFrame([(i, i in conflict) for i in range(n)], "item int, conflict boolean"),
        spark.createDataFrame([*bases, *bases, (None, 1), (1, None)], "item int, base int"), spark.createDataFrame([(i, "weight", v) for i, v in held.items()] + [(9, "weight", ""), (8, "weight", None)], "item int, field string, value string"),
    )
    rows = got.collect()
    assert {r["item"]: (r["value"], r["from_item"], r["round"]) for r in rows} == want and len(rows) == len(want)
    assert max(r["round"] for r in rows) > 1


def test_fields_alone_are_those_that_values_fill(spark, monkeypatch):
    """Fields of any name, images, conflicts, several bases, cycles and null items; more names than bits take the way of the values."""
    rng, n = random.Random(1), 40
    said = [("Weight", "1 kg"), ("Note", "made of steel, CE"), ("Rated voltage", "24 V"), ("g", "/img/AB-{}.jpg"), ("Fuse", "none"), (None, None)]
    rows = [(rng.choice([None, *range(n)]), k, None, *(x and x.format(k % n) for x in rng.choice(said)), "https://a.example/p", "official") for k in range(60)]
    rows += [(i, 99, None, "g", f"/img/AB-{i}.jpg", "https://a.example/p") for i in range(0, n, 7)]
    names = ["weight", "material", "certificates", "voltage", "image", "grip", "length of cord", None]
    missing = spark.createDataFrame([(rng.choice([None, *range(n)]), rng.choice(names)) for _ in range(150)] * 2, "item int, field string")
    held = spark.createDataFrame([(rng.choice([None, *range(n)]), rng.choice([*names, "unasked"]), rng.choice(["x", "y", "", None])) for _ in range(30)], "item int, field string, value string")
    items = spark.createDataFrame([(i, f"AB-{i}", ["a.example"], rng.choice([None, False, False, i % 9 == 0])) for i in range(n)], "item int, key string, hosts array<string>, conflict boolean")
    bases = spark.createDataFrame([(rng.choice([None, *range(n)]), rng.randrange(n)) for _ in range(50)] * 2 + [(5, 6), (6, 7), (7, 5), (3, None)], "item int, base int")
    found = lambda frame: sorted((r["item"], r["field"], r["round"]) for r in frame.collect())
    want = found(repair.repair_from_evidence(missing, evidence(spark, rows), items, bases, held))
    assert {r[2] for r in want} > {0, 1, 2} and found(repair.repaired_fields(missing, evidence(spark, rows), items, bases, held)) == want
    monkeypatch.setattr(repair, "MOST_BITS", len(repair._READ) + 1)
    monkeypatch.setattr(repair, "repair_from_evidence", lambda *given: spark.createDataFrame([(len(given), "by values", 0)], "item int, field string, round int"))
    assert found(repair.repaired_fields(missing, evidence(spark, rows), items, bases, held)) == [(5, "by values", 0)]


def test_completeness_keeps_no_values_of_repairs(spark, monkeypatch):
    """Rounds of the query exchange and keep one short row for an item: its number, its base and bits."""
    from quarryline.plans import registry

    kept, keep = [], repair._kept
    monkeypatch.setattr(repair, "_kept", lambda rows: kept.append(dict(rows.dtypes)) or keep(rows))
    assert registry.queries()["repaired_completeness"](spark, "/root/testdata/sf0.001").filter("status = 'found-after-repair'").count() > 0
    assert kept and all(len(row) <= 3 and set(row.values()) == {"bigint"} for row in kept)


def test_nothing_to_repair(spark):
    none, rows = evidence(spark, []), evidence(spark, [(1, 1, None, "Weight", "1 kg")])
    pairs, bases = spark.createDataFrame([(1, "weight")], "item int, field string"), spark.createDataFrame([(1, 1)], "item int, base int")
    assert repair.repair_from_evidence(pairs, none).collect() == [] == repair.repair_from_evidence(pairs.limit(0), rows, bases=bases).collect()
    assert repair.repair_from_evidence(pairs, none, bases=bases).collect() == []
    assert best(repair.repair_from_evidence(pairs, rows)) == {(1, "weight"): "1 kg"}


def test_retries(spark):
    audit = [
        (1, "weight", "required", True), (2, "image", "preferred", True), (3, "image", "required", True), (4, "weight", "preferred", True), (5, "weight", "preferred", True), (6, "weight", "required", True), (7, "certificates", "required", True), (8, "weight", "not-applicable", True),
        (9, "weight", "required", True), (9, "material", "preferred", True), (10, "image", "required", True), (10, "typeCode", "required", True), (11, "image", "preferred", True), (12, "weight", "required", None), (13, "weight", "preferred", True), (14, "weight", "required", True),
    ]
    both = ["discovery", "reader"]
    items = [(i, i == 11, i == 4, i == 5, [] if i == 14 else both, both if i == 6 else None) for i in range(1, 16)]
    got = {r["item"]: (r["retry"], r["reason"], r["fields"], r["untried"]) for r in repair.retry_decisions(
        spark.createDataFrame(audit * 2, "item int, field string, requirement string, missing boolean"), spark.createDataFrame(items, "item int, force boolean, skip_preferred boolean, passed boolean, possible array<string>, tried array<string>"),
        spark.createDataFrame([(9, "weight"), (13, "weight"), (11, "image")], "item int, field string"),
    ).collect()}
    all_ = "discovery,reader"
    assert got == {
        1: (True, "untried-stages", "weight", all_), 2: (False, "final-only", "image", ""), 3: (True, "untried-stages", "image", all_), 4: (False, "preferred-only", "weight", ""), 5: (False, "passed", "weight", ""), 6: (False, "all-tried", "weight", ""),
        7: (False, "nothing-missing", "", ""), 8: (False, "nothing-missing", "", ""), 9: (True, "untried-stages", "material", all_), 10: (False, "final-only", "image,typeCode", ""), 11: (True, "untried-stages", "image", all_), 12: (False, "nothing-missing", "", ""),
        13: (False, "exhausted", "weight", ""), 14: (False, "no-stage", "weight", ""), 15: (False, "nothing-missing", "", ""),
    }
