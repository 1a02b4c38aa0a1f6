"""Operators on attributes, markup, layout, normalised fields, legends and delimited lines: odd rows, ties and single values."""

import pytest
from pyspark.sql import functions as F

from quarryline.operators import attributes, compare, devices, gates, layout, markup, normalize, ontology, resolve, state
from quarryline.sources import delimited

from test_functions import each

ATTRIBUTES = "item int, ord int, name string, value string, group string, source_url string, source_type string, parser string, stage string, confidence double, extra string"


def table(spark, rows):
    full = [(*r, *[None] * (11 - len(r))) for r in rows]
    return spark.createDataFrame(full, ATTRIBUTES)


def test_dedupe_attributes(spark):
    rows = table(spark, [(1, 2, "Weight", "2 KG"), (1, 1, "weight", "2 kg"), (1, 3, "Weight", None), (1, 4, "", "x"), (2, 1, "Weight", "2 kg"), (1, 5, "weight", "2 kg", "G")])
    got = attributes.dedupe_attributes(rows)
    assert got.columns == rows.columns
    assert sorted((r.item, r.ord) for r in got.collect()) == [(1, 1), (1, 5), (2, 1)]
    assert attributes.dedupe_attributes(rows.filter("false")).count() == 0


def test_candidates_and_resolution(spark):
    rows = table(spark, [
        (1, 1, "Rated voltage", "24 V", None, "u", "distributor", "generic", "s", 1.0), (1, 2, "Voltage", "230 V", None, "v", "official", "pdf-table", "s", 0.5), (1, 3, "voltage", "230 V", None, "v", "official", "pdf-table", "s", 0.9),
        (1, 4, "Voltage", "see manual", None, "w", "official", "x", "s", 0.9), (1, 5, "Voltage", "9 V", "Page Evidence"), (1, 6, "Colour", "Red"), (1, 7, "Color", "red ", None, None, "cache"), (2, 1, "Weight", "900000 kg"), (None, 1, "Finish", "matt"),
    ])
    candidates = attributes.field_candidates(rows)
    got = sorted((str(r.item), r.field, r.value, r.priority, r.ord) for r in candidates.collect())
    assert got == [("1", "color", "Red", 100, 6), ("1", "voltage", "230 V", 910, 2), ("1", "voltage", "24 V", 320, 1), ("None", "finish", "matt", 100, 9 - 8)]
    best = {(r.item, r.field): r for r in attributes.field_resolutions(candidates).collect()}
    assert best[1, "voltage"].selected == "230 V" and best[1, "voltage"].conflicts == 1 and best[1, "voltage"].reason == "Selected official parsed document priority; retained 1 conflicting value(s) for review."
    conflicts = [(r.rank, r.value, r.selected) for r in attributes.field_conflicts(candidates).orderBy("rank").collect()]
    assert conflicts == [(1, "230 V", True), (2, "24 V", False)]
    health = {r.field: r.status for r in attributes.field_health(rows.filter("item = 1"), candidates).collect()}
    assert health["voltage"] == "conflicting" and health["color"] == "low-confidence" and health["weight"] == "missing"
    assert attributes.field_candidates(rows.filter("false")).count() == 0


def test_documents_keep_first_place_and_best_row(spark):
    rows = [(1, 1, "other", "files", "https://a.com/x?utm_source=1", None, None, False), (1, 2, "datasheet", "Technical data sheet here", "https://A.com/x", "official", 0.9, True), (1, 3, "other", "x", None, None, None, False), (1, 4, "datasheet", "Technical data sheet here", "https://a.com/x#p", "official", 0.9, True)]
    got = attributes.dedupe_documents(spark.createDataFrame(rows, "item int, ord int, type string, label string, url string, source_type string, confidence double, held boolean")).collect()
    assert [(r.first_seen, r.ord, r.copies) for r in got] == [(1, 2, 3)]


def test_properties(spark):
    rules = spark.createDataFrame(ontology.PROPERTIES, ontology.PROPERTY_SCHEMA)
    labels = ["Rated control circuit voltage", "Rated voltage", "Insulation rated voltage", "Colour temperature", "Storage temperature", "Net weight", None, "", "nonsense"]
    got = each(spark, lambda c: ontology.property_of(c, rules), labels)
    assert [g and g.key for g in got] == ["controlVoltage", "ratedVoltage", None, None, None, "weight", None, None, None]
    assert each(spark, lambda c: ontology.property_of(c, rules.filter("false")), ["Rated voltage"]) == [None]
    score = each(spark, lambda c: ontology.similarity(ontology.plain_label(c), F.lit("rated operational current")), ["RatedOperationalCurrent", "operational rated current", "rated current", "zz", ""])
    assert score[0] == 1 and score[1] >= 0.95 and 0.6 < score[2] < 0.95 and score[3] == score[4] == 0
    attributes_ = spark.createDataFrame([(1, 1, "Leistungsfaktor", "5 W"), (1, 2, "Rated voltage", "5 V"), (2, 1, "Power losses", "5 W"), (2, 2, "Note", "no number"), (3, 1, None, "3 A")], "item int, ord int, name string, value string")
    aliases = spark.createDataFrame([("Power loss", "powerLoss")], "alias string, key string")
    assert [tuple(r) for r in ontology.unmapped_labels(attributes_, rules, aliases).collect()] == [("Leistungsfaktor", 1, 1)]


PAGE = """<html><title>Not found</title><table><TR class="a > b"><th scope='row'>Weight <b>net</b></th><td>2&nbsp;kg</td></TR><tr><td>lone</td></tr></table>
<dl><dt>Material</dt><dd>Steel</dd><dt>no value</dt></dl><ul><li>Voltage: 24 V</li><li>class: x</li></ul><div hidden>Current = 3 A</div><div data-sku=A1 aria-label='part "x"' data-empty=""></div>
<script type="application/ld+json">[{"@type":["Thing","Product"],"sku":7,"name":"a &amp; b","brand":"B"},{"@type":"Offer"}]</script><script type='application/ld+json'>not json</script>
<img src=/a.png data-src='/a.png' srcset="/b.webp 1x, /c.webp 2x"><img src="/x"></html>"""


def test_markup(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id int, html string")
    got = sorted((r.source, r.name, r.value) for r in markup.mined_pairs(pages).collect())
    assert got == [
        ("data", "data-sku", "A1"), ("definition", "Material", "Steel"), ("hidden", "Current", "3 A"), ("table", "Weight net", "2 kg"), ("text", "Current", "3 A"), ("text", "Voltage", "24 V"),
    ]
    assert [tuple(r) for r in markup.json_products(pages).collect()] == [(1, 0, "7", "a & b", "B")]
    assert [r.url for r in markup.page_images(pages).orderBy("ord").collect()] == ["/a.png", "/b.webp", "/c.webp"]
    assert {r.page_id: r.state for r in markup.page_state(pages.withColumn("html", F.replace("html", F.lit("Not found"), F.lit("Page Not Found")))).collect()} == {1: "blocked", 2: "page", 3: "page"}


def test_legends_and_equivalence(spark):
    pairs = [("1,5 kg", "1.5", True), ("10 to 20", "10…20", True), ("+5..10 V", "5-10 v", True), ("2024-05-12T00:00:00.000Z", "12.5", True), ("a  B", "A b", True), ("1", "2", False), (None, "", True), ("x", None, False), ("AC", "DC", False)]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(pairs)], "k int, a string, b string").select("k", compare.values_equivalent(F.col("a"), F.col("b")).alias("out"))
    assert [r.out for r in sorted(frame.collect())] == [w for *_, w in pairs]
    legend = F.lit("Voltage 1 - < 50 V 2 - 50 V to 250 V 3 - 400/690 V 4 - greater than 1000 V")
    got = each(spark, lambda c: compare.match_legend(legend, c), ["24 V", "230", "690 V", "1,5 V", "2000V", "300 V", "2", None])
    assert [g and g.code for g in got] == ["1", "2", "3", "1", "4", None, "1", None]
    assert each(spark, compare.is_enum, ["1 - a 2 - b", "1 - a", "1 - a 2 - b otherwise text", "1 - a 2 - A", None]) == [True, False, False, False, False]


def test_comparison_of_null_values(spark):
    left, right = (spark.createDataFrame(rows, "k int, v int") for rows in ([(1, None), (2, None), (3, 1), (4, 1)], [(1, None), (2, 5), (3, 1), (5, None)]))
    assert {r.k: r.verdict for r in resolve.compare_relations(left, right, "k", "v").collect()} == {1: "match", 2: "mismatch", 3: "match", 4: "left_only", 5: "right_only"}


@pytest.mark.parametrize(
    "read, want",
    [
        (normalize.weight_text, {"600 g": "600 g (0.6 kg)", "1,050.00 lbs": "1,050.00 lbs (476.272 kg)", "270 g (0.60 lb)": "270 g (0.60 lb) (0.27 kg)", "600 g 700 g": None, "2 kg": "2 kg", "heavy": None, None: None}),
        (normalize.dimension_text, {"10 x 20 x 30 mm": "10 x 20 x 30 mm", "1,5 x 2 in": "1,5 x 2 in (38.1 x 50.8 mm)", "2 x 3 mm²": None, "10 mm": None, None: None}),
        (normalize.voltage_text, {"24VDC": "24 V DC", "100-240 VAC": "100...240 V AC", "230 volts; IP20": "230 V", "12 A": None, None: None}),
        (normalize.current_text, {"16 amps": "16 A", "6kA": "6 kA", "10 to 20 A": "10...20 A", "24 V": None}),
        (normalize.protection_text, {"IP 67 datasheet": "IP 67", "NEMA": None, "NEMA 4X": "NEMA 4X", "IEC 60529": "IEC 60529", None: None}),
        (normalize.certificate_text, {"CEcULus": "cULus; CE", "UL, cULus": "cULus; UL", "UL Listed E1; UL": "UL Listed", "tüv, rohs": "TÜV; RoHS", "none": None,
            "IEC 60947-1": "IEC 60947-1", "Registro Italiano Navale": "Registro Italiano Navale", "cULus Listed E12345": "cULus Listed E12345", "UL 508": "UL 508", "CSA C22.2 No. 14": "CSA C22.2 No. 14", "UL File E319779, UL": "UL File E319779"}),
        (normalize.material_text, {"Aluminium housing": "aluminum", "stainless steel cleaner": None, "Stainless steel type 304": "stainless steel Type 304", "x": None, None: None,
            "Glass fiber reinforced polyamide": "glass-fiber reinforced polyamide", "aluzinc coated steel": "aluzinc coated steel", "PA66": "PA66", "Edelstahl V2A": "stainless steel Type 304", "Edelstahl 1.4301": "stainless steel Type 304", "Gehäuse aus Edelstahl": "stainless steel",
            "verzinkter Stahl": "galvanized steel", "Kunststoff": "plastic", "acier inoxydable": "stainless steel", "fonte": "cast iron", "ottone": "brass", "PA 6 GF30, black": "polyamide GF30", "aluminium die-cast": "die-cast aluminum", "S.S. bolt": "stainless steel", "Techpolymer": "Techpolymer"}),
        (normalize.colour_text, {"hellgrau pulverbeschichtet": "light gray", "gris": "gray", "nero": "black", "powder coated, RAL 7035": "RAL 7035", "light GREY and black": "gray; black", "RAL7035": "RAL 7035", "ANSI 61 gray": "ANSI-61 gray", "x": None}),
        (normalize.thickness_text, {"1.5 mm sheet": "1.5 mm", "body 0.1 in": "0.1 in (2.54 mm)", "5 mm": None, "2 x 3 mm sheet": None}),
        (normalize.finish_text, {"Black powder coated. Door": "Black powder coated", "none": None}),
    ],
)
def test_field_texts(spark, read, want):
    assert each(spark, read, list(want)) == list(want.values())


def test_layout(spark):
    items = spark.createDataFrame([(1, 1, "a", 10.0, 100.0), (1, 1, "b", 14.0, 101.0), (1, 1, "c", 60.0, 99.5), (1, 1, "d", 12.0, 80.0), (1, 2, "e", 10.0, 5.0)], "doc int, page int, text string, x double, y double")
    headers = spark.createDataFrame([(1, 1, "H1", 12.0), (1, 1, "H2", 100.0)], "doc int, page int, text string, x double")
    got = sorted((r.page, r.row, str(r.column), r.value) for r in layout.table_cells(items, headers).collect())
    assert got == [(1, 0, "H1", "a b"), (1, 0, "H2", "c"), (1, 1, "H1", "d"), (2, 0, "None", "e")]
    lines = ["x"] * 8 + ["KEY one"] + ["y"] * 3 + ["AB-1234 other", "z"] + ["KEY two"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "no such"), (None, "KEY"), (3, None)], "doc_id int, text string")
    kept = layout.tight_contexts(docs, F.contains(F.col("text"), F.lit("KEY"))).collect()
    assert sorted(r.line for r in kept if r.doc_id == 1) == [2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14] and sum(r.doc_id is None for r in kept) == 1
    text = "a" * 3000 + "Key" + "b" * 100 + "KEY" + "c" * 3000 + "key"
    spans = layout.character_windows(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string"), "key").orderBy("begin").collect()
    assert [(r.begin, r.end) for r in spans] == [(1000, 5500), (4106, 6109)]


def test_gates_and_devices(spark):
    assert each(spark, gates.quality_tier, [0.9, 0.75, 0.6, 0.1, 0.0], "double") == ["Complete", "Good", "Usable", "Sparse", "No data"]
    empty = spark.createDataFrame([], "item int, status string, confidence double, coverage double, gate_passed boolean, n_attributes int, n_documents int, url string")
    assert gates.readiness(gates.review_rows(empty)).first().state == "No rows exported"
    signals = spark.createDataFrame([(1, "text", "A", 1000.0), (1, "url", "A", 400.0), (1, "text", "B", 1500.0), (2, "text", "B", 1.0), (2, "text", "A", 1.0)], "item int, channel string, type string, score double")
    assert sorted(map(tuple, devices.classify_devices(signals).collect())) == [(1, "A", 1650.0, 150.0, 2, 0.87), (2, "A", 1.0, 0.0, 1, 0.56)]


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x", 1), ("b", 1, "y", 5)], "k string, ts int, v string, uses int")
    new = spark.createDataFrame([("a", 3, "z", 1), ("a", 2, "w", 1), ("c", 1, None, 1)], "k string, ts int, v string, uses int")
    assert sorted(map(tuple, state.upsert(old, new, ["k"], "ts", "uses").collect())) == [("a", 3, "z", 3), ("b", 1, "y", 5), ("c", 1, None, 1)]


def test_delimited(spark, tmp_path):
    assert each(spark, delimited.detect_delimiter, ["a;b;c", "a\tb", 'x,"a;b;c"', "plain", ""]) == [";", "\t", ",", ",", ","]
    assert each(spark, lambda c: delimited.split_fields(c, ","), ['a, "b ""q"" ,c" ,d', ",,", "x"]) == [["a", 'b "q" ,c', "d"], ["", "", ""], ["x"]]
    (tmp_path / "one.csv").write_text("﻿Catalog no;Name\n\nAB-1;x\nab-1;y\n CD  2 ;z;more\n", encoding="utf-8")
    (tmp_path / "two.txt").write_text("XY-100\nXY-200\nXY-100\n", encoding="utf-8")
    rows = delimited.table_rows(delimited.read_lines(spark, str(tmp_path)))
    got = sorted(r.catalog_number for r in delimited.catalog_numbers(rows).collect())
    assert got == ["AB-1", "CD 2", "XY-100", "XY-200"]
    assert {tuple(sorted(r.fields)) for r in rows.collect()} == {("Catalog no", "Name"), ("Catalog Number",)}


def test_requirements_of_items_without_findings(spark):
    items, required = spark.createDataFrame([(1,), (2,), (2,)], "item int"), spark.createDataFrame([("a", "x"), ("a", "y")], "kind string, name string")
    found = spark.createDataFrame([(2, "a", "x"), (2, "b", "y"), (3, "a", "x")], "item int, kind string, name string")
    assert {r.item: r.missing for r in gates.missing_requirements(items, found, required).collect()} == {1: ["a:x", "a:y"], 2: ["a:y"]}


def test_terms_of_the_score(spark):
    base = (True, 0.9, 3, 1, 1, {"document": 1}, [])
    rows = [(k, *base, k == 1, k == 2, k == 3, 2 if k == 4 else None) for k in range(5)]
    items = spark.createDataFrame(rows, "item int, identity boolean, confidence double, n_attributes int, n_documents int, min_attributes int, n_required map<string,int>, missing array<string>, template_stage boolean, reader boolean, browser boolean, min_documents int")
    got = {r.item: (r.score, r.missing) for r in gates.score_results(items).collect()}
    assert got == {0: (100, ""), 1: (100, ""), 2: (98, ""), 3: (96, ""), 4: (84, "minDocuments:2")}


def test_issues_name_the_first_items(spark):
    rows = spark.createDataFrame([(i, "High" if i == 3 else "Low", "Gap: 5%; Other" if i == 7 else "Gap: 4%") for i in range(30)] + [(99, "Low", "")], "item int, priority string, reasons string")
    got = {r.issue: r for r in gates.issue_rows(rows).collect()}
    assert got["Gap"]["items"] == "; ".join(map(str, range(25))) + "; +5 more" and got["Gap"].severity == "High" and got["Other"]["items"] == "7" and set(got) == {"Gap", "Other"}


def test_one_of_tied_values_is_selected(spark):
    from quarryline.operators.attributes import field_conflicts

    rows = [(1, "protection", "IP63", 7, "official", "generic", "scan", 0.95), (1, "protection", "IP37", 7, "official", "generic", "scan", 0.95), (1, "protection", "IP20", 9, "official", "generic", "scan", 0.95)]
    candidates = spark.createDataFrame(rows, "item long, field string, value string, ord long, source_type string, parser string, stage string, confidence double")
    got = field_conflicts(candidates).orderBy("rank").select("rank", "value", "selected").collect()
    assert [tuple(r) for r in got] == [(1, "IP37", True), (2, "IP63", False), (3, "IP20", False)]


def test_repeats_at_one_place_do_not_go_by_the_order_of_rows(spark):
    from quarryline.operators.attributes import field_candidates, field_conflicts

    rows = [(1, 7, "Net weight", "5 kg", "u", kind, "generic", 0.95) for kind in ("distributor", "official")] + [(1, 8, "Net weight", "6 kg", "u", "official-fallback", "generic", 0.95)]
    for given in (rows, rows[::-1]):
        attributes = spark.createDataFrame(given, "item long, ord long, name string, value string, source_url string, source_type string, parser string, confidence double").coalesce(1)
        got = field_conflicts(field_candidates(attributes)).orderBy("rank").select("rank", "value", "priority", "selected").collect()
        assert [tuple(r) for r in got] == [(1, "5 kg", 869, True), (2, "6 kg", 739, False)]


def test_a_legend_is_read_once(spark):
    from quarryline.operators.compare import match_legend

    plan = spark.createDataFrame([("Kind 1 - AC 2 - DC", "dc")], "d string, v string").select(match_legend(F.col("d"), F.col("v"))["code"].alias("code"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("(.+?)(?=") <= 2
    assert [r.code for r in plan.collect()] == ["2"]
