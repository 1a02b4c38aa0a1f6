"""Text and key functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the rules below: ASCII, no-break and the other Unicode spaces, and the byte-order mark.
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Named entities in the order in which they are decoded, in any case; the ampersand comes second, so ``&amp;lt;`` ends as ``<``.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&apos;|&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&deg;", "°"), ("&sup2;", "²"), ("&micro;", "µ")]
#: UTF-8 read as CP1252, and what it stood for.
MOJIBAKE = [("â€¦", "..."), ("â€“|â€”", "-"), ("Â°", "°"), ("Â²", "²")]


def let(value: Column, read: Callable[[Column], Column]) -> Column:
    """``read`` of a value that is computed once, however often ``read`` uses it: array functions don't share common parts by themselves."""
    return F.get(F.transform(F.array(value), read), F.lit(0))


def _code_points(value: Column, pattern: str, digits: str, base: int) -> Column:
    """Numeric entities of one base as characters; one beyond Unicode stays as it is, a surrogate becomes the replacement character."""
    tokens = F.regexp_extract_all(value, F.lit(f"(?i)({pattern}|&|[^&]+)"), F.lit(1))

    def decoded(token: Column) -> Column:
        number = F.regexp_extract(token, f"(?i)^&#x?0*({digits}{{1,7}});$", 1)
        point = F.conv(F.when(number != "", number), base, 10).cast("long")
        char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        return F.when(token.rlike(f"(?i)^{pattern}$") & (point <= 0x10FFFF), char).otherwise(token)

    return F.array_join(F.transform(tokens, decoded), "")


def decode_entities(value: Column) -> Column:
    """Hexadecimal, then decimal, then named entities; what one step makes, a later one may decode."""
    numeric = _code_points(_code_points(value, "&#x[0-9a-f]+;", "[0-9a-f]", 16), "&#[0-9]+;", "[0-9]", 10)
    value = F.when(F.contains(value, F.lit("&#")), numeric).otherwise(value)
    named = value
    for name, sign in ENTITIES:
        named = F.regexp_replace(named, f"(?i){name}", sign)
    return F.when(F.contains(value, F.lit("&")), named).otherwise(value)


def collapse(value: Column) -> Column:
    """White space runs as one space, none at the ends; null becomes the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), f"[{SPACE}]+", " "))


def collapse_or_null(value: Column) -> Column:
    return F.nullif(collapse(value), F.lit(""))


def clean_text(value: Column) -> Column:
    """Decoded entities, repaired mojibake, collapsed white space; null becomes the empty text."""
    value = decode_entities(F.coalesce(value, F.lit("")))
    for broken, sign in MOJIBAKE:
        value = F.regexp_replace(value, broken, sign)
    return collapse(value)


def unique_strings(values: Column, normalize: str = "none", keep_empty: bool = False, ignore_case: bool = False) -> Column:
    """An array's distinct strings in order of first appearance, as first written; null counts as empty."""
    how = {"none": lambda x: x, "trim": lambda x: F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", ""), "clean": clean_text}[normalize]
    made = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: how(F.coalesce(x, F.lit(""))))
    if not keep_empty:
        made = F.filter(made, lambda x: x != "")
    if not ignore_case:
        return F.array_distinct(made)
    folded = F.transform(made, lambda x: F.lower(x))
    return F.filter(made, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)


def truncated(value: Column, most: int = 32_000) -> Column:
    return F.when(F.length(value) > most, F.substring(value, 1, most)).otherwise(value)


def split_name_value(text: Column) -> Column:
    """(name, value) of a ``label: value`` or ``label = value`` line, else null; a label of 2 to 80 characters that is no value itself."""
    colon, equal = r"^([^:]{2,80}):\s*(.+)$", r"^([^=]{2,80})=\s*(.+)$"

    def parts(cleaned: Column) -> Column:
        made = [F.struct(F.trim(F.regexp_extract(cleaned, p, 1)).alias("name"), F.trim(F.regexp_extract(cleaned, p, 2)).alias("value")) for p in (colon, equal)]
        return F.when(cleaned.rlike(colon), made[0]).when(cleaned.rlike(equal), made[1])

    return let(let(clean_text(text), parts), lambda x: F.when(~is_value_fragment(x["name"]), x))


def is_value_fragment(name: Column) -> Column:
    """A would-be label that is a measurement, a unit in brackets, a bare number or nothing."""
    t = F.trim(name)
    return (t == "") | t.rlike(r"^\([^)]*\d[^)]*\)$") | t.rlike(r"^[+-]?\d+(?:[.,]\d+)?$") | t.rlike(r"(?i)^[+-]?\d+(?:[.,]\d+)?\s*[a-zµΩ°%/().²³]+$")


def compact_key(value: Column) -> Column:
    """Lower-case letters and digits only: keys that differ in separators are equal."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "")


def slug(value: Column, most: int = 48) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(dashed, 1, most)


def plain_number(token: Column) -> Column:
    """One number without thousands separators and with a decimal point: ``1.050,00`` and ``1,050.00`` become ``1050.00``.

    With both separators the last one is the decimal point (of several, what follows the second is dropped, as in the
    original). Of one kind, groups of three digits after a first one without leading zero are thousands; a single point
    stays, other commas become points.
    """
    comma, dot = F.contains(token, F.lit(",")), F.contains(token, F.lit("."))

    def both(decimal: str, grouping: str) -> Column:
        parts = F.split(token, f"[{decimal}]")
        return F.concat(F.replace(F.get(parts, F.lit(0)), F.lit(grouping), F.lit("")), F.lit("."), F.get(parts, F.lit(1)))

    return (
        F.when(comma & dot, F.when(token.rlike(r",[^.]*$"), both(",", ".")).otherwise(both(".", ",")))
        .when(comma, F.when(token.rlike(r"^[1-9]\d{0,2}(,\d{3})+$"), F.replace(token, F.lit(","), F.lit(""))).otherwise(F.replace(token, F.lit(","), F.lit("."))))
        .when(token.rlike(r"^[1-9]\d{0,2}(\.\d{3}){2,}$"), F.replace(token, F.lit("."), F.lit("")))
        .otherwise(token)
    )


def plain_numbers(text: Column) -> Column:
    """The text with each of its numbers as :func:`plain_number` writes it; the rest stays."""
    tokens = F.regexp_extract_all(text, F.lit(r"([^0-9]+|[0-9]([0-9.,]*[0-9])?)"), F.lit(1))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]"), plain_number(t)).otherwise(t)), "")
