"""Quantities in texts: numbers, ranges, alternatives, tolerances, conditions and units, as Column expressions.

``parse_quantities`` makes one array of structs per text from pattern matches and array functions, so it stays inside
generated code. A null or empty text has an empty array. All counts of matches are those of the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, let, plain_numbers

#: Unit spellings (lower case, without spaces), the unit that they mean and its kind.
KINDS = {
    "voltage": "vac=V vdc=V v=V volt=V volts=V kv=kV mv=mV", "current": "a=A amp=A amps=A ampere=A amperes=A ka=kA ma=mA", "power": "w=W watt=W watts=W kw=kW mw=mW hp=hp",
    "torque": "nm=Nm", "force": "n=N kn=kN", "temperature": "°c=°C degc=°C °f=°C degf=°C", "frequency": "hz=Hz khz=kHz mhz=MHz",
    "pressure": "pa=Pa hpa=hPa kpa=kPa mpa=MPa bar=bar mbar=mbar psi=psi atm=atm torr=Torr mmhg=mmHg inhg=inHg",
    "flowRate": "nl/min=Nl/min l/min=l/min lpm=l/min m3/h=m3/h m3/min=m3/min dm3/min=dm3/min gpm=gpm cfm=cfm", "mass": "kg=kg mg=mg g=g lb=lb oz=oz",
    "length": "mm=mm cm=cm inch=in inches=in ft=ft feet=ft µm=µm um=µm", "resistance": "ω=Ω ohm=Ω kω=kΩ mω=MΩ", "apparentPower": "va=VA kva=kVA", "reactivePower": "var=var kvar=kvar",
    "charge": "ah=Ah mah=mAh", "energy": "wh=Wh kwh=kWh", "area": "mm²=mm² mm2=mm² cm²=cm² cm2=cm²", "speed": "rpm=rpm r/min=rpm 1/min=rpm min-1=rpm min⁻¹=rpm",
    "soundLevel": "db=dB db(a)=dB(A) dba=dB(A)", "time": "ms=ms µs=µs us=µs s=s", "ratio": "%=%",
}
#: Units in the order in which they are tried, longer ones before their beginnings.
UNITS = (
    r"VAC|VDC|kVA|VA|kvar|var|kV|mV|V|mAh|Ah|kA|mA|A|kWh|Wh|kW|mW|W|Nm|kN|N|hp|°\s*F|degF|°\s*C|degC|kHz|MHz|Hz|hPa|mmHg|inHg|Torr|mbar|kPa|MPa|Pa|bar|psi|atm|Nl\s*/\s*min|l\s*/\s*min|lpm"
    r"|m3\s*/\s*h|m3\s*/\s*min|dm3\s*/\s*min|gpm|cfm|rpm|r\s*/\s*min|1\s*/\s*min|min⁻¹|min-1|dB\(A\)|dBA|dB|kg|mg|g|lb|oz|mm²|mm2|cm²|cm2|mm|cm|inches|inch|feet|ft|µm|um|MΩ|kΩ|Ω|ohm"
    r"|amperes?|amps?|volts?|watts?|%|µs|us|ms|s"
)
CONDITION_UNITS = r"°\s*C|°\s*F|degC|degF|VAC|VDC|kV|mV|V|kA|mA|A|kW|mW|W|kHz|MHz|Hz|%|bar|kg|g"
#: Least and greatest value of a kind that can be real.
BOUNDS = {
    "temperature": (-120, 400), "voltage": (0, 2_000_000), "current": (0, 500_000), "power": (0, 100_000_000), "mass": (0, 200_000), "frequency": (0, 5_000_000), "pressure": (0, 5_000_000),
    "flowRate": (0, 10_000_000), "apparentPower": (0, 100_000_000), "reactivePower": (0, 100_000_000), "charge": (0, 1_000_000), "energy": (0, 1_000_000_000), "area": (0, 1_000_000),
    "force": (0, 10_000_000), "speed": (0, 2_000_000), "soundLevel": (0, 200), "time": (0, 100_000_000), "ratio": (-100, 1_000_000),
}

_NUMBER = r"[+-]?\d+(?:\.\d+)?"
_WORDED = r"\.{2,3}|…|\bto\b|\bbis\b|\bdo\b|~"
_EXPRESSION = rf"{_NUMBER}(?:\s*(?:{_WORDED}|/|-)\s*\+?{_NUMBER})*"
_QUALIFIER = r"≤|<=|<|≥|>=|>|max\.?|min\.?|maximum|minimum|up\s*to|nominal|rated"
_QUANTITY = rf"(?iu)({_QUALIFIER})?\s*({_EXPRESSION})\s*({UNITS})(?![a-zµ])"
_CONDITION = rf"(?iu)(?:\bat\b|@|\bbei\b|\bper\b|\bpri\b|\bà\b)\s*{_NUMBER}\s*(?:{CONDITION_UNITS})"
#: A percent sign that belongs to a tolerance, as it is marked while quantities are looked for.
_MARK = "\uE000"
_PLUS_MINUS = r"(?:±|\+/-|\+-)\s*"
_TYPE = "struct<kind:string,unit:string,value:double,min:double,max:double,values:array<double>,qualifier:string,tolerance:struct<type:string,value:double>,current_type:string,condition:string,raw:string>"


def normalize_for_parsing(text: Column) -> Column:
    """Dashes, degrees and cubes in one spelling, white space collapsed, numbers with a decimal point and no grouping."""
    out = F.coalesce(text, F.lit(""))
    for pattern, sign in (("[–—−]", "-"), ("â[€\u0088][“”\u0092-\u0094]", "-"), (r"(?i)[?\x{FFFD}]\s*C\b", " C"), ("Â°", "°"), ("℃", "°C"), ("³", "3"), (f"[{SPACE}]+", " ")):
        out = F.regexp_replace(out, pattern, sign)
    return plain_numbers(F.trim(out))


def conditions_of(normalized: Column) -> Column:
    """The conditions such as ``at 40 °C``, joined; null without any."""
    found = F.regexp_extract_all(normalized, F.lit(f"({_CONDITION})"), F.lit(1))
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda c: F.trim(c)), "; "))


def without_conditions(normalized: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(normalized, _CONDITION, " "), r"\s+", " "))


def _numbers(expression: Column) -> Column:
    """value, or min and max, or values of a number, a range or alternatives."""
    worded = expression.rlike(f"(?i)({_WORDED})")
    several = F.filter(F.transform(F.split(expression, "/"), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    alternatives = F.contains(expression, F.lit("/")) & ~worded & (F.size(several) >= 2)
    ends = rf"(?i)^({_NUMBER})\s*(?:{_WORDED}|-)\s*\+?({_NUMBER})$"
    a, b = (F.regexp_extract(expression, ends, k).try_cast("double") for k in (1, 2))
    ranged = expression.rlike(ends)
    return F.struct(
        F.when(~alternatives & ~ranged, F.regexp_extract(expression, f"({_NUMBER})", 1).try_cast("double")).alias("value"),
        F.when(~alternatives & ranged, F.least(a, b)).alias("min"), F.when(~alternatives & ranged, F.greatest(a, b)).alias("max"), F.when(alternatives, several).alias("values"),
    )


def _celsius(value: Column) -> Column:
    return F.floor((value - 32) * 5 / 9 * 10 + 0.5) / 10


def _unit_table() -> Column:
    pairs = [(spelling, unit, kind) for kind, listed in KINDS.items() for spelling, unit in (x.rsplit("=", 1) for x in listed.split())]
    return F.create_map(*[c for s, u, k in pairs for c in (F.lit(s), F.struct(F.lit(u).alias("unit"), F.lit(k).alias("kind")))])


def parse_quantities(text: Column, kind: str | None = None) -> Column:
    """An array of structs: kind, unit, value, min, max, values, qualifier, tolerance, current_type, condition, raw.

    The qualifier is alternatives, range, max, min, nominal (with a tolerance) or point. Degrees Fahrenheit are converted.
    With ``kind``, only quantities of that kind.
    """
    def of(normalized: Column) -> Column:
        return let(F.struct(_marked(normalized).alias("marked"), conditions_of(normalized).alias("condition")), lambda x: _found(x["marked"], x["condition"]))

    quantities = F.when(F.coalesce(text, F.lit("")).rlike(r"\d"), let(normalize_for_parsing(text), of)).otherwise(F.array().cast(f"array<{_TYPE}>"))
    return quantities if kind is None else F.filter(quantities, lambda q: q["kind"] == kind)


def _marked(normalized: Column) -> Column:
    """The text without conditions, and with the percent signs of tolerances marked."""
    return F.regexp_replace(without_conditions(normalized), rf"({_PLUS_MINUS})({_EXPRESSION}\s*)%(?![a-zA-Zµ])", f"$1$2{_MARK}")


def _found(marked: Column, condition: Column) -> Column:
    """The quantities of a marked text: each match with what lies between it and the next; its parts are read from the match alone."""
    raws, between = F.regexp_extract_all(marked, F.lit(_QUANTITY.replace("(?iu)", "(?iu)(") + ")"), F.lit(1)), F.split(marked, _QUANTITY, -1)
    pairs = F.transform(raws, lambda raw, i: F.struct(raw.alias("raw"), F.substring(F.get(between, i + 1), 1, 28).alias("window")))
    whole = _QUANTITY.replace("(?![a-zµ])", "$")
    table = _unit_table()

    def first(m: Column) -> Column:
        spelling = F.lower(F.regexp_replace(F.regexp_extract(m["raw"], whole, 3), r"\s+", ""))
        window = m["window"]
        token = F.lower(F.trim(F.regexp_replace(F.regexp_extract(m["raw"], whole, 1), r"\s+", " ")))
        percent, absolute = (F.regexp_extract(window, _PLUS_MINUS + r"(\d+(?:\.\d+)?)" + tail, 1) for tail in (rf"\s*[%{_MARK}]", ""))
        tolerance = F.when(percent != "", F.struct(F.lit("percent").alias("type"), percent.cast("double").alias("value"))).when(absolute != "", F.struct(F.lit("absolute").alias("type"), absolute.cast("double").alias("value")))
        return F.struct(
            F.trim(m["raw"]).alias("raw"), spelling.alias("spelling"), table[spelling].alias("info"), _numbers(F.trim(F.regexp_extract(m["raw"], whole, 2))).alias("n"), window.alias("window"), tolerance.alias("tolerance"),
            F.when(token.rlike(r"^(≤|<=|<|max\.?|maximum|up to)$"), "max").when(token.rlike(r"^(≥|>=|>|min\.?|minimum)$"), "min").alias("bound"),
        )

    def converted(q: Column) -> Column:
        warm = q["spelling"].isin("°f", "degf")
        n = q["n"]
        values = F.struct(*[F.when(warm, _celsius(n[c])).otherwise(n[c]).alias(c) for c in ("value", "min", "max")], F.when(warm, F.transform(n["values"], _celsius)).otherwise(n["values"]).alias("values"))
        plain = n["value"].isNotNull()
        qualifier = F.when(n["values"].isNotNull(), "alternatives").when(n["min"].isNotNull(), "range").when(q["bound"].isNotNull(), q["bound"]).when(q["tolerance"].isNotNull(), "nominal").otherwise("point")
        return F.struct(q["raw"].alias("raw"), q["spelling"].alias("spelling"), q["info"].alias("info"), values.alias("n"), q["window"].alias("window"), q["tolerance"].alias("tolerance"), qualifier.alias("qualifier"), plain.alias("plain"))

    def last(q: Column) -> Column:
        n, w = q["n"], q["window"]
        ac, dc = w.rlike(r"(?i)\bAC\b") | (q["spelling"] == "vac"), w.rlike(r"(?i)\bDC\b") | (q["spelling"] == "vdc")
        flow = F.when(w.rlike(r"(?i)\bAC\s*/\s*DC\b|\bAC-DC\b|\bACDC\b") | (ac & dc), "AC/DC").when(ac, "AC").when(dc, "DC")
        return F.struct(
            q["info"]["kind"].alias("kind"), q["info"]["unit"].alias("unit"), n["value"].alias("value"),
            F.when(q["plain"] & (q["qualifier"] == "min"), n["value"]).otherwise(n["min"]).alias("min"), F.when(q["plain"] & (q["qualifier"] == "max"), n["value"]).otherwise(n["max"]).alias("max"),
            n["values"].alias("values"), q["qualifier"].alias("qualifier"), q["tolerance"].alias("tolerance"), F.when(q["info"]["kind"].isin("voltage", "current"), flow).alias("current_type"),
            condition.alias("condition"), q["raw"].alias("raw"),
        ).cast(_TYPE)

    return F.transform(F.transform(F.filter(F.transform(pairs, first), lambda q: q["info"].isNotNull()), converted), last)


def quantity_max(q: Column) -> Column:
    return F.coalesce(q["max"], F.array_max(q["values"]), q["value"])


def quantity_min(q: Column) -> Column:
    return F.coalesce(q["min"], F.array_min(q["values"]), q["value"])


def is_plausible(q: Column) -> Column:
    """All numbers of the quantity lie within the bounds of its kind; a kind without bounds and a quantity without numbers pass."""
    table = F.create_map(*[c for k, (a, b) in BOUNDS.items() for c in (F.lit(k), F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")))])
    bounds = table[q["kind"]]
    listed = F.concat(F.array(q["value"], q["min"], q["max"]), F.coalesce(q["values"], F.array().cast("array<double>")))
    return bounds.isNull() | F.forall(F.filter(listed, lambda x: x.isNotNull()), lambda x: (x >= bounds["low"]) & (x <= bounds["high"]))


def is_plausible_celsius(value: Column) -> Column:
    return value.between(*BOUNDS["temperature"])


_STORAGE = r"(?i)\b(storage|lager|transport)\b"
_OPERATING = r"(?i)\b(operating|operational|ambient|working|surrounding|service|umgebung|betrieb)\b"
_TEMPERATURE = r"(?i)\b(temp|temperature|temperatur|operating|operational|ambient|working|surrounding|service|storage|lager|transport|umgebung|betrieb)\b"
_BARE_RANGE = rf"(?i)({_NUMBER})\s*(?:°?\s*C)?\s*(?:{_WORDED}|-)\s*\+?({_NUMBER})\s*(?:°?\s*C)?"


def temperature_range(text: Column) -> Column:
    """(min, max) of the operating temperature, else null.

    Clauses on operation come first, those on storage never count. A bare temperature beside a current, voltage, power or
    frequency without a word for temperature is a condition of that reading and doesn't count either.
    """
    return let(without_conditions(normalize_for_parsing(text)), _operating)


def _operating(cleaned: Column) -> Column:
    clauses = F.filter(F.transform(F.split(cleaned, r"[;\n]+|,(?=\s*[A-Za-zÄÖÜäöüß])"), lambda c: F.trim(c)), lambda c: c != "")
    open_ones = F.filter(clauses, lambda c: ~c.rlike(_STORAGE))
    ordered = F.array_distinct(F.concat(F.filter(open_ones, lambda c: c.rlike(_OPERATING)), open_ones))

    def read(clause: Column) -> Column:
        return F.struct(clause.alias("clause"), parse_quantities(clause).alias("all"))

    def of(x: Column) -> Column:
        named = x["clause"].rlike(_TEMPERATURE)
        rated = F.exists(x["all"], lambda q: q["kind"].isin("voltage", "current", "power", "frequency"))
        warm = F.filter(x["all"], lambda q: q["kind"] == "temperature")
        ranged = F.get(F.filter(warm, lambda q: q["min"].isNotNull() & q["max"].isNotNull()), F.lit(0))
        values = F.flatten(F.transform(warm, lambda q: F.coalesce(q["values"], F.when(q["value"].isNotNull(), F.array(q["value"])).otherwise(F.array().cast("array<double>")))))
        a, b = (F.regexp_extract(x["clause"], _BARE_RANGE, k).try_cast("double") for k in (1, 2))

        def pair(low: Column, high: Column) -> Column:
            return F.struct(low.alias("min"), high.alias("max"))

        trusted = named | ~rated
        return (
            F.when(ranged.isNotNull() & trusted, pair(ranged["min"], ranged["max"]))
            .when((F.size(values) >= 2) & trusted, pair(F.array_min(values), F.array_max(values)))
            .when(named & ~rated & x["clause"].rlike(_BARE_RANGE), pair(F.least(a, b), F.greatest(a, b)))
        )

    return F.get(F.filter(F.transform(F.transform(ordered, read), of), lambda r: r.isNotNull()), F.lit(0))
