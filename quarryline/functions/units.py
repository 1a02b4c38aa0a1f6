"""Numbers in a wanted unit, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quantities import normalize_for_parsing
from .text import let

#: Units of each family with their size in the family's base unit.
FAMILIES = {
    "current": {"A": 1, "mA": 0.001, "kA": 1000}, "voltage": {"V": 1, "mV": 0.001, "kV": 1000}, "power": {"W": 1, "mW": 0.001, "kW": 1000}, "frequency": {"Hz": 1, "kHz": 1000, "MHz": 1_000_000},
    "torque": {"Nm": 1}, "temperature": {"C": 1}, "length": {"mm": 1, "cm": 10, "m": 1000, "in": 25.4, "ft": 304.8, "yd": 914.4},
    "mass": {"g": 1, "kg": 1000, "lb": 453.59237, "oz": 28.349523125},
    "flowRate": {"Nl/min": 1, "l/min": 1, "m3/h": 1000 / 60, "m3/min": 1000, "dm3/min": 1, "gpm": 3.785411784, "cfm": 28.316846592},
    "pressure": {"Pa": 0.00001, "kPa": 0.01, "MPa": 10, "mbar": 0.001, "bar": 1, "psi": 0.0689475729},
}
#: Other spellings, beside a unit's own in lower case.
ALIASES = {
    "A": "amp amps ampere amperes", "mA": "milliamp milliamps milliampere milliamperes", "V": "volt volts", "W": "watt watts", "Hz": "hertz", "Nm": "n*m newtonmeter newtonmeters", "C": "°c degc",
    "in": 'inch inches "', "ft": "foot feet", "yd": "yard yards", "lb": "lbs pound pounds", "oz": "ounce ounces", "l/min": "lpm",
}
SPELLINGS = {s: u for family in FAMILIES.values() for u in family for s in (u.lower(), *ALIASES.get(u, "").split())}
FAMILY_OF = {u: name for name, family in FAMILIES.items() for u in family}
#: The spellings that are read behind a number, in the four passes in which they are read.
TAGGED = (
    r"mA|kA|A|mV|kV|V|mW|kW|W|MHz|kHz|Hz|kg|g|lb|lbs|mm|cm|m|°C|C", r"Nl\s*/\s*min|l\s*/\s*min|lpm|m3\s*/\s*h|m3\s*/\s*min|dm3\s*/\s*min|gpm|cfm", "mbar|kPa|MPa|Pa|bar|psi",
    "inches|inch|feet|foot|yards|yard|ounces|ounce|pounds|pound|in|ft|yd|oz",
)

_NUMBER = r"-?\d+(?:\.\d+)?"
_RANGE = rf"(?i)({_NUMBER})\s*(?:\.\.\.|\.{{2}}|-|to|do)\s*\+?({_NUMBER})"


def _prepared(text: Column) -> Column:
    """As for parsing, with a dash between digits as a range."""
    return normalize_for_parsing(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[–—−]", "-"), r"(\d)\s*-\s*(\d)", "$1 to $2"))


def tagged_numbers(text: Column) -> Column:
    """Every number that carries a known unit: structs (value, unit) in the order of the passes."""
    return let(_prepared(text), _tagged)


def _tagged(prepared: Column) -> Column:
    parts = []
    table = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    for pattern, end in (*((p, r"\b") for p in TAGGED), ('"', "")):
        read = rf"(?i)({_NUMBER})\s*({pattern}){end}"
        zipped = F.arrays_zip(F.regexp_extract_all(prepared, F.lit(read), F.lit(1)).alias("n"), F.regexp_extract_all(prepared, F.lit(read), F.lit(2)).alias("u"))
        parts.append(F.transform(zipped, lambda x: F.struct(x["n"].cast("double").alias("value"), table[F.lower(F.regexp_replace(x["u"], r"\s+", ""))].alias("unit"))))
    return F.filter(F.concat(*parts), lambda x: x["unit"].isNotNull())


def convert(value: Column, unit: Column, target: str) -> Column:
    """The value in ``target``; a value without unit stays, one of another family is null."""
    family = FAMILIES[FAMILY_OF[target]]
    factor = F.create_map(*[F.lit(x) for u, f in family.items() for x in (u, float(f))])
    return F.when(unit.isNull() | (unit == target), value).otherwise(value * factor[unit] / float(family[target]))


def max_in_unit(text: Column, target: str) -> Column:
    """The greatest number of the text in ``target`` (any spelling), to six places; null for an unknown unit.

    Numbers tagged with the target's family count. With other families only there is none; without any tag, the
    first range's or number's is taken as it stands.
    """
    unit = SPELLINGS.get(target.replace(" ", "").lower())
    if unit is None:
        return F.lit(None).cast("double")
    def best_of(x: Column) -> Column:
        prepared, tagged = x["prepared"], x["tagged"]
        own = F.filter(tagged, lambda t: t["unit"].isin(*FAMILIES[FAMILY_OF[unit]]))
        best = F.array_max(F.transform(own, lambda t: convert(t["value"], t["unit"], unit)))
        a, b = (F.regexp_extract(prepared, _RANGE, k).try_cast("double") for k in (1, 2))
        bare = F.when(prepared.rlike(_RANGE), F.greatest(a, b)).otherwise(F.regexp_extract(prepared, f"({_NUMBER})", 1).try_cast("double"))
        return F.round(F.when(F.size(own) > 0, best).when(F.size(tagged) == 0, bare), 6)

    return let(_prepared(text), lambda p: let(F.struct(p.alias("prepared"), _tagged(p).alias("tagged")), best_of))


def split_temperatures(text: Column) -> Column:
    """(min, max) in degrees Celsius of a range, of two readings or more, or of a labelled range without unit; else nulls."""
    prepared = _prepared(text)
    ranged = rf"(?i)({_NUMBER})\s*(?:\.\.\.|\.{{2}}|-|to|do)\s*\+?({_NUMBER})\s*(?:°?\s*C|deg\s*C|degrees?\s*C?)?\b"
    labelled = rf"(?i)(?:temp(?:erature)?|ambient|operating).*?({_NUMBER})\s*(?:-|to|do)\s*({_NUMBER})"
    found = F.regexp_extract_all(prepared, F.lit(rf"(?i)({_NUMBER})\s*(?:°\s*)?C\b"), F.lit(1))

    def ends(pattern: str) -> tuple[Column, Column]:
        return F.regexp_extract(prepared, pattern, 1), F.regexp_extract(prepared, pattern, 2)

    pairs = ends(ranged), (F.get(found, F.lit(0)), F.try_element_at(found, F.lit(-1))), ends(labelled)
    usable = (prepared.rlike(ranged), F.size(found) >= 2, prepared.rlike(labelled))
    skip = F.coalesce(text, F.lit("")).rlike(r"(?i)\brated operational current\b")

    def pick(k: int) -> Column:
        out = F.when(skip, None)
        for use, pair in zip(usable, pairs):
            out = out.when(use, pair[k])
        return F.round(out.try_cast("double"), 6)

    return F.struct(pick(0).alias("min"), pick(1).alias("max"))
