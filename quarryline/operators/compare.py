"""Comparing cells of two workbooks, and legends that stand for codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, let

_NUMBER = r"^[-+]?\d+(?:\.\d+)?"
#: A legend that allows free text is no list of codes.
FREE_TEXT = r"(?i)insert (the )?number or|name of the|otherwise|ongoing|string\)"


def canonical(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), f"[{SPACE}]+", " ")))


def pure_number(value: Column) -> Column:
    """The number of a cell that is one number, maybe with a unit behind it; else null. The first comma is a decimal point."""
    cleaned = F.regexp_replace(canonical(value), "^([^,]*),", "$1.")
    return F.when(cleaned.rlike(rf"{_NUMBER}(?:\s*[a-z°%/]+)?$"), F.regexp_extract(cleaned, f"({_NUMBER})", 1).try_cast("double"))


def unified_range(value: Column) -> Column:
    """Every range sign as a dash, plus signs dropped."""
    return F.replace(F.regexp_replace(canonical(value), r"\s*(?:\.{2,3}|…|\bto\b|\bbis\b|\bdo\b|–|—|-)\s*", "-"), F.lit("+"), F.lit(""))


def date_as_decimal(value: Column) -> Column:
    """What a spreadsheet made of day.month: the date 2024-05-12 stands for 12.5; null for other texts."""
    pattern = r"^\d{4}-(\d{2})-(\d{2})T00:00:00\.000Z$"
    month, day = (F.regexp_extract(F.trim(value), pattern, k).try_cast("int") for k in (1, 2))
    return F.when(month.between(1, 12) & day.between(1, 31), F.concat(day.cast("string"), F.lit("."), month.cast("string")).cast("double"))


def values_equivalent(a: Column, b: Column) -> Column:
    """Equal but for white space and case, equal numbers (units don't count), a number and its date form, or equal ranges. Two empty cells are equal."""
    ca, cb, na, nb, da, db = canonical(a), canonical(b), pure_number(a), pure_number(b), date_as_decimal(a), date_as_decimal(b)
    return F.coalesce(
        F.when((ca == "") | (cb == "") | (ca == cb), ca == cb).when(na.isNotNull() & nb.isNotNull(), na == nb).when(da.isNotNull() & nb.isNotNull(), da == nb)
        .when(db.isNotNull() & na.isNotNull(), db == na).otherwise(unified_range(a) == unified_range(b)), F.lit(False),
    )


def compare_cells(manual: DataFrame, generated: DataFrame) -> DataFrame:
    """article, sheet, column, manual, generated, status of every cell that either has; empty values count as none.

    Cells meet by article (letters and digits), sheet and column without regard to case; of repeated cells the last (``ord``) counts.
    """
    def cells(rows: DataFrame, name: str) -> DataFrame:
        key = F.lower(F.regexp_replace(F.coalesce("article", F.lit("")), "(?i)[^a-z0-9]+", ""))
        kept = rows.filter(F.trim(F.coalesce("value", F.lit(""))) != "")
        last = F.max_by(F.struct("article", "sheet", "column", "value"), "ord").alias(name)
        return kept.groupBy(key.alias("_a"), canonical(F.col("sheet")).alias("_s"), canonical(F.col("column")).alias("_c")).agg(last)

    joined = cells(manual, "m").join(cells(generated, "g"), ["_a", "_s", "_c"], "full_outer")
    status = F.when(F.col("g").isNull(), "manual-only").when(F.col("m").isNull(), "generated-only").when(values_equivalent(F.col("m.value"), F.col("g.value")), "match").otherwise("mismatch")
    return joined.select(*[F.coalesce(f"m.{c}", f"g.{c}").alias(c) for c in ("article", "sheet", "column")], F.col("m.value").alias("manual"), F.col("g.value").alias("generated"), status.alias("status"))


def comparison_summary(cells: DataFrame) -> DataFrame:
    """One row: comparable, match, mismatch, generated_only, manual_only and precision (1 where nothing is comparable)."""
    counts = cells.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s.replace("-", "_")) for s in ("match", "mismatch", "generated-only", "manual-only")])
    comparable = F.col("match") + F.col("mismatch")
    return counts.select(comparable.alias("comparable"), "match", "mismatch", "generated_only", "manual_only", F.when(comparable == 0, 1.0).otherwise(F.col("match") / comparable).alias("precision"))


def plain(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", " "))


def parse_legend(description: Column) -> Column:
    """The options of a column description such as ``Type 1 - AC 2 - DC``: structs (code, label, plain), each label once; null for fewer than two."""
    text = F.trim(F.regexp_replace(description, f"[{SPACE}]+", " "))
    pattern = F.lit(r"(\d+)\s*[-–]\s*(.+?)(?=\s+\d+\s*[-–]\s|$)")
    made = F.transform(F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("c"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("l")), lambda x: F.struct(x["c"].alias("code"), F.trim(x["l"]).alias("label"), plain(x["l"]).alias("plain")))

    def options(made: Column) -> Column:
        named = F.filter(made, lambda x: x["plain"] != "")
        once = let(named, lambda n: let(F.transform(n, lambda x: x["plain"]), lambda names: F.filter(n, lambda x, i: F.array_position(names, x["plain"]) == i + 1)))
        return F.when(F.size(made) >= 2, let(once, lambda o: F.when(F.size(o) >= 2, o)))

    return F.when(~description.rlike(FREE_TEXT), let(made, options))


def is_enum(description: Column) -> Column:
    return F.coalesce(parse_legend(description).isNotNull(), F.lit(False))


def _voltage_fits(label: Column, volts: Column) -> Column:
    """A label in volts covers the value: less than, up to, greater than, a range, alternatives or the value itself."""
    n = r"(-?\d+(?:\.\d+)?)"

    def number(pattern: str, k: int = 1) -> Column:
        return F.regexp_extract(label, pattern, k).try_cast("double")

    less, up_to, more = rf"(?i)^<\s*{n}\s*V\b", rf"(?i)^up to\s*{n}\s*V\b", rf"(?i)^greater than\s*{n}\s*V\b"
    ranged, compact = rf"(?i)\b{n}\s*V\s*(?:up to|to|-)\s*{n}\s*V\b", rf"(?i)\b{n}\s*-\s*{n}\s*V\b"
    several, exact = r"(?i)^((?:-?\d+(?:\.\d+)?\s*/\s*)+-?\d+(?:\.\d+)?)\s*V\b", rf"(?i)^{n}\s*V\b"
    listed = F.transform(F.split(F.regexp_extract(label, several, 1), "/"), lambda x: F.trim(x).try_cast("double"))
    hit = [
        volts < number(less), volts <= number(up_to), volts > number(more), (volts >= number(ranged)) & (volts <= number(ranged, 2)), (volts >= number(compact)) & (volts <= number(compact, 2)),
        F.array_contains(F.filter(listed, lambda x: x.isNotNull()), volts), volts == number(exact),
    ]
    out = F.lit(False)
    for h in hit:
        out = out | F.coalesce(h, F.lit(False))
    return out


def match_legend(description: Column, value: Column) -> Column:
    """The option that a raw value means: by its plain label, by volts, or (in legends without volts) by its code; else null."""
    dotted = F.regexp_replace(value, "^([^,]*),", "$1.")
    tagged = F.regexp_extract(dotted, r"(?i)(-?\d+(?:\.\d+)?)\s*V\b", 1).try_cast("double")

    def chosen(legend: Column) -> Column:
        in_volts = F.exists(legend, lambda x: x["label"].rlike(r"(?i)\bV\b"))
        volts = F.coalesce(tagged, F.when(in_volts, F.regexp_extract(F.trim(dotted), r"^(-?\d+(?:\.\d+)?)$", 1).try_cast("double")))
        seen = F.struct(in_volts.alias("in_volts"), volts.alias("volts"), plain(value).alias("plain"), F.trim(value).alias("trimmed"))

        def option(seen: Column) -> Column:
            first = lambda fits: F.get(F.filter(legend, fits), F.lit(0))
            by_volts = F.when(seen["volts"].isNotNull(), first(lambda x: _voltage_fits(x["label"], seen["volts"])))
            by_code = F.when(~seen["in_volts"] & seen["trimmed"].rlike(r"^\d+$"), first(lambda x: x["code"] == seen["trimmed"]))
            return F.coalesce(first(lambda x: x["plain"] == seen["plain"]), by_volts, by_code)

        return let(seen, option)

    # a legend is read once for a row, not anew for each use and each of its options
    return let(parse_legend(description), chosen)
