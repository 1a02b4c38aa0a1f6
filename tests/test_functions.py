"""Text, url, key, quantity and unit functions on single values."""

import pytest
from pyspark.sql import functions as F

from quarryline.functions import keys, quantities, text, units, urls


def each(spark, function, values, kind="string"):
    """The function's results for a list of values, in order."""
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["out"] for r in sorted(frame.select("k", function(F.col("v")).alias("out")).collect(), key=lambda r: r["k"])]


def test_clean_text(spark):
    want = {
        "a&#8211;b": "a–b", "&#x41;&#X42;": "AB", "m&sup2; &DEG;C &Micro;": "m² °C µ", "&amp;lt;": "<", "&amp;#65;": "&#65;", "&#x26;#65;": "A", "&#1114112;x": "&#1114112;x", "&#x1F389;": "🎉",
        "1â€“2 â€¦ 5Â°C mÂ²": "1-2 ... 5°C m²", " a\u00a0\u2003b\n": "a b", "&copy;&middot;": "&copy;&middot;", "&#39;&apos;&quot;": "''\"", "&#99999999999999999999;": "&#99999999999999999999;", None: "", "": "",
    }
    assert each(spark, text.clean_text, list(want)) == list(want.values())


def test_unique_strings(spark):
    values = [["b", "a", "b", None, "", "A "], None, []]
    assert each(spark, text.unique_strings, values, "array<string>") == [["b", "a", "A "], [], []]
    assert each(spark, lambda c: text.unique_strings(c, "trim", ignore_case=True), values, "array<string>") == [["b", "a"], [], []]
    assert each(spark, lambda c: text.unique_strings(c, keep_empty=True), values, "array<string>") == [["b", "a", "", "A "], [], []]
    assert each(spark, lambda c: text.unique_strings(c, "clean"), [["a&amp;b", "a&b"]], "array<string>") == [["a&b"]]


def test_name_value(spark):
    want = {"Weight: 1.2 kg": ("Weight", "1.2 kg"), "R = 10 Ω": ("R", "10 Ω"), "120 W: x": None, "(1.65 lb): y": None, "12: z": None, "no pair": None, None: None, "W x H x D: 1 x 2 x 3": ("W x H x D", "1 x 2 x 3")}
    assert [tuple(r) if r else None for r in each(spark, text.split_name_value, list(want))] == list(want.values())


def test_url_keys(spark):
    want = {
        "HTTP://A.com?b=2&a=1&utm_source=x#f": "http://a.com/?a=1&b=2", "https://a.com/P?ref=1&TS=4&a": "https://a.com/p?a=&ref=1", "https://a.com/?a=2&a=1": "https://a.com/?a=2&a=1",
        " not a url#x": "not a url", None: "", "https://a.com/x?q=a%20b": "https://a.com/x?q=a+b",
    }
    assert each(spark, urls.canonical_url_key, list(want)) == list(want.values())
    links = {"https://a.com/X?q=1&k=1&m=2&k=3": "https://a.com/x?k=3&m=2", "https://a.com/x?utm_medium=1": "https://a.com/x", "Rel/X": "rel/x", None: None}
    assert each(spark, urls.unique_link_key, list(links)) == list(links.values())
    assert each(spark, lambda c: urls.without_params(c, ["pf", "attrs"]), ["https://a.com/P?pf=1&attrs[x]=2&attrs.y=3&k=4#z", "x?pf=1"]) == ["https://a.com/P?k=4#z", "x?pf=1"]


@pytest.mark.parametrize(
    "function, pairs",
    [
        (urls.same_normalized_url, [("https://A.com/p/", "https://a.com/P", True), ("https://a.com/p?x=1", "https://a.com/p", False), ("Abc/", "abc", True)]),
        (urls.same_url_ignoring_hash, [("https://a.com/p#1", "https://A.com/P", True), ("https://a.com/p/", "https://a.com/p", False), (None, "a", False), ("", "", False)]),
        (urls.same_origin_and_path, [("https://a.com/p?x", "https://a.com/p", True), ("https://a.com/P", "https://a.com/p", False), ("a", "a", False), (None, None, False)]),
        (keys.same_key, [("ab-12", "AB12", True), ("x", "cat:X", True), ("x", "y", False), (None, "y", False)]),
        (keys.text_names_key, [("see 1756 L8 here", "1756-L8", True), ("a1", "x:A1", True), ("a-1", "A1", False), (None, "A1", False), ("a", None, False)]),
    ],
)
def test_pairs(spark, function, pairs):
    frame = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(pairs)], "k int, a string, b string").select("k", function(F.col("a"), F.col("b")).alias("out"))
    assert [r.out for r in sorted(frame.collect())] == [w for _, _, w in pairs]


def test_document_urls(spark):
    want = {"https://a.com/x.PDF?y": True, "https://a.com/download-pdf": True, "https://a.com/?format=pdf": True, "https://a.com/?file=a.pdf": True, "https://a.com/?docid=4": True, "https://a.com/pdfs": False, None: False}
    assert each(spark, urls.is_pdf_like_url, list(want)) == list(want.values())
    assert each(spark, urls.is_downloadable_url, ["https://a.com/a.step", "https://a.com/?name=b.zip", "https://a.com/cutsheet", "https://a.com/a"]) == [True, True, True, False]


def test_templates(spark):
    template = F.lit("{part}|{partUpper}|{partLower}|{partCompact}|{partSlashBraces}|{partAfterColon}|{partAfterColonLower}|{partAfterColonCompact}|{partSnake}|{partDash}")
    got = each(spark, lambda c: keys.fill_template(template, c), ["ab:C/1 d(x)"])
    assert got == ["ab%3AC%2F1%20d(x)|AB%3AC%2F1%20D(X)|ab%3Ac%2F1%20d(x)|abc1dx|ab%3AC%7B%7D1%20d(x)|C%2F1%20d(x)|c%2F1%20d(x)|c1dx|ab_c_1_d_x|ab-c-1-d-x"]
    assert each(spark, keys.has_placeholder, ["/{partDash}", "/{parts}", None]) == [True, False, False]


def test_quantities(spark):
    def of(value):
        return [(q.kind, q.unit, q.value, q.min, q.max, q["values"], q.qualifier, q.tolerance and tuple(q.tolerance), q.current_type, q.condition) for q in each(spark, quantities.parse_quantities, [value])[0]]

    assert of("ambient temperature -40 to +80 °C") == [("temperature", "°C", None, -40, 80, None, "range", None, None, None)]
    assert of("Rated current AC-1: 70 A at 40 °C") == [("current", "A", 70, None, None, None, "point", None, None, "at 40 °C")]
    assert of("24 V DC ±20%") == [("voltage", "V", 24, None, None, None, "nominal", ("percent", 20), "DC", None)]
    assert of("230/400 V") == [("voltage", "V", None, None, None, [230, 400], "alternatives", None, None, None)]
    assert of("≤ 16 A") == [("current", "A", 16, None, 16, None, "max", None, None, None)]
    assert of("212 °F") == [("temperature", "°C", 100, None, None, None, "point", None, None, None)]
    assert of("1,050.00 lb; 2,5 kVA") == [("mass", "lb", 1050, None, None, None, "point", None, None, None), ("apparentPower", "kVA", 2.5, None, None, None, "point", None, None, None)]
    assert of("100–240 VAC, 50/60 Hz") == [("voltage", "V", None, 100, 240, None, "range", None, "AC", None), ("frequency", "Hz", None, None, None, [50, 60], "alternatives", None, None, None)]
    assert of("10 A ± 2 mm 5 kg") == [("current", "A", 10, None, None, None, "point", None, None, None), ("length", "mm", 2, None, None, None, "point", None, None, None), ("mass", "kg", 5, None, None, None, "point", None, None, None)]
    assert of(None) == of("") == of("12 apples") == []
    plausible = each(spark, lambda c: F.transform(quantities.parse_quantities(c), quantities.is_plausible), ["900 °C 20 °C 5 mm", "120 %"])
    assert plausible == [[False, True, True], [True]]
    ends = each(spark, lambda c: F.transform(quantities.parse_quantities(c), lambda q: F.array(quantities.quantity_min(q), quantities.quantity_max(q))), ["230/400 V 1-3 A 7 W"])
    assert ends == [[[230, 400], [1, 3], [7, 7]]]


def test_temperature_range(spark):
    want = {
        "Operating -25 °C to 70 °C; storage -40 to 85 °C": (-25, 70), "storage -40 to 85 °C": None, "70 A at 40 °C": None, "Temperature range -40 do 70": (-40, 70), "20 A 40 °C 60 °C": None,
        "ambient temperature -20...+55 °C": (-20, 55), "5 °C, 40 °C": (5, 40), None: None, "": None,
    }
    assert [tuple(r) if r else None for r in each(spark, quantities.temperature_range, list(want))] == list(want.values())


def test_units(spark):
    def most(target):
        return lambda c: units.max_in_unit(c, target)

    assert each(spark, most("mm"), ["2 in", '6"', "1.5 m and 20 cm", "12", "5-9", "3 kg", "", None]) == [50.8, 152.4, 1500, 12, 9, None, None, None]
    assert each(spark, most("kg"), ["10 lb", "500 g", "1,050 kg"]) == [4.535924, 0.5, 1050]
    assert each(spark, most("bar"), ["100 psi", "-25 °C ... 40 °C"]) == [6.894757, None]
    assert each(spark, most("parsec"), ["3 kg"]) == [None]
    assert [tuple(r) for r in each(spark, units.split_temperatures, ["-25...+60 °C", "5 °C and 40 °C", "ambient 5 to 9", "rated operational current 5-9", None])] == [(-25, 60), (5, 40), (5, 9), (None, None), (None, None)]


def test_rules_of_document_urls(spark):
    pdf = {
        "https://a.example/x.PDF?y": True, "https://a.example/x?file=y.pdf": True, "https://a.example/x?type=application%2Fpdf": True, "https://a.example/x?docId=5": True, "https://a.example/x.pdfx": False, None: False,
        "https://configurator.rockwellautomation.com/api/Product/1/cutsheet?format=pdf": False, "https://hit.sbt.siemens.com/RWD/AssetsByProduct.aspx?asset_type=Data+Sheet+for+Product&prodId=S1": True,
    }
    assert dict(zip(pdf, each(spark, urls.is_pdf_like_url, list(pdf)))) == pdf
    files = {"https://a.example/x.zip": True, "https://a.example/x?asset=y.step": True, "https://configurator.rockwellautomation.com/api/Product/1/cutsheet": True, "https://a.example/documents/td/1": True, "https://a.example/x?n=y.html": False, "https://a.example/x.pdf": True}
    assert dict(zip(files, each(spark, urls.is_downloadable_url, list(files)))) == files
