"""Delimited texts with unknown separators and headers: what is detected, and the rows as a relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import SPACE, collapse

#: Names of a key column, and what a key looks like (with a digit in it).
KEY_NAME = r"(?i)catalog|part|sku|item|katalo|sifra|šifra|broj|number"
KEY_SHAPE = r"(?i)^[A-Z0-9][A-Z0-9._/-]{2,}$"


def looks_like_key(value: Column) -> Column:
    t = F.trim(value)
    return F.coalesce(t.rlike(KEY_SHAPE) & t.rlike(r"\d"), F.lit(False))


def detect_delimiter(line: Column) -> Column:
    """Tab, comma or semicolon, whichever is most frequent outside quotes (in that order for equal ones); comma where there is none."""
    bare = F.regexp_replace(line, r'"(?:[^"]|"")*("|$)', "")
    tab, comma, semicolon = (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))) for d in ("\t", ",", ";"))
    return F.when((tab >= comma) & (tab >= semicolon) & (tab > 0), "\t").when((comma >= semicolon) | (semicolon == 0), ",").otherwise(";")


def split_fields(line: Column, delimiter: Column | str) -> Column:
    """The trimmed fields of a line; quoted ones may hold delimiters and doubled quotes."""
    def by(d: str) -> Column:
        pattern = rf'{d}(?:[ ]*"((?:[^"]|"")*)"[^{d}]*|([^{d}]*))'
        quoted, bare = (F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(pattern), F.lit(k)) for k in (1, 2))
        return F.transform(F.arrays_zip(quoted.alias("q"), bare.alias("b")), lambda x: F.trim(F.when(x["q"] != "", F.replace(x["q"], F.lit('""'), F.lit('"'))).otherwise(x["b"])))

    if isinstance(delimiter, str):
        return by(delimiter)
    return F.when(delimiter == "\t", by("\t")).when(delimiter == ";", by(";")).otherwise(by(","))


def has_header(first: Column, second: Column) -> Column:
    """A first row (array of fields) is a header if it names a key column, or if the second row, as long, holds more keys; a single key never is."""
    named = F.exists(first, lambda c: c.rlike(KEY_NAME))
    keys = lambda r: F.size(F.filter(r, looks_like_key))
    single = (F.size(first) == 1) & looks_like_key(first[0])
    return named | (~single & F.coalesce((F.size(first) == F.size(second)) & (keys(second) > keys(first)), F.lit(False)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, ord, line of the texts under ``path``, without byte-order marks and blank lines; a quoted field must end on its line.

    ``ord`` rises along a file, whose parts are read by many tasks; it isn't dense.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("line"))
    return lines.filter(collapse(F.col("line")) != "")


def table_rows(lines: DataFrame) -> DataFrame:
    """file, ord, fields (map from column name to field) of the lines (file, ord, line) of each file, header lines taken off.

    The first two lines of a file tell its delimiter and whether it has a header. Missing fields are empty, surplus ones go, columns without a
    name are numbered; without a header the first column is the catalogue number.
    """
    firsts = lines.groupBy("file").agg(F.min(F.struct("ord", "line")).alias("a"))
    seconds = lines.join(firsts.select("file", F.col("a.ord").alias("_at")), "file").filter("ord > _at").groupBy("file").agg(F.min(F.struct("ord", "line")).alias("b"))
    sep = detect_delimiter(F.col("a.line"))
    two = firsts.join(seconds, "file", "left")
    heads = two.select("file", sep.alias("sep"), split_fields(F.col("a.line"), sep).alias("one"), split_fields(F.col("b.line"), sep).alias("next"), F.col("a.ord").alias("head"))
    header = F.coalesce(has_header(F.col("one"), F.col("next")), has_header(F.col("one"), F.array().cast("array<string>")))
    numbered = lambda i: F.concat(F.lit("Column "), (i + 1).cast("string"))
    names = F.when(header, F.transform("one", lambda c, i: F.when(c == "", numbered(i)).otherwise(c))).otherwise(F.transform("one", lambda c, i: F.when(i == 0, "Catalog Number").otherwise(numbered(i))))
    heads = heads.select("file", "sep", "head", header.alias("header"), names.alias("names"))
    rows = lines.join(heads, "file").filter(~F.col("header") | (F.col("ord") > F.col("head")))
    fields = split_fields(F.col("line"), F.col("sep"))
    padded = F.transform("names", lambda n, i: F.coalesce(F.get(fields, i), F.lit("")))
    return rows.select("file", "ord", F.map_from_arrays("names", padded).alias("fields"))


def key_column(rows: DataFrame, sample: int = 50) -> DataFrame:
    """file, key_column: the first column whose name says so, else the one with the greatest share of keys among the file's first ``sample`` rows (0.6 at least), else the first."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("ord"))).filter(F.col("_n") <= sample)
    entries = ranked.select("file", "ord", F.posexplode(F.map_entries("fields")).alias("at", "e")).select("file", "at", F.col("e.key").alias("name"), F.col("e.value").alias("value"))
    shares = entries.groupBy("file", "at", "name").agg((F.count(F.when(looks_like_key(F.col("value")), 1)) / F.nullif(F.count(F.when(F.col("value") != "", 1)), F.lit(0))).alias("share"))
    named = F.min(F.when(F.col("name").rlike(KEY_NAME), F.struct("at", "name"))).alias("named")
    best = F.max_by(F.struct("name", "share"), F.struct(F.coalesce("share", F.lit(-1.0)), -F.col("at"))).alias("best")
    chosen = shares.groupBy("file").agg(named, best, F.min(F.struct("at", "name")).alias("first"))
    return chosen.select("file", F.coalesce("named.name", F.when(F.col("best.share") >= 0.6, F.col("best.name")), "first.name").alias("key_column"))


def catalog_numbers(rows: DataFrame, column: str | None = None) -> DataFrame:
    """file, ord, catalog_number: the distinct numbers of a column (or the detected one), without regard to case, as first written."""
    keyed = rows.withColumn("key_column", F.lit(column)) if column else rows.join(key_column(rows), "file")
    value = collapse(F.try_element_at("fields", F.col("key_column")))
    made = keyed.select("file", "ord", value.alias("catalog_number")).filter("catalog_number <> ''")
    return made.groupBy("file", F.upper("catalog_number")).agg(F.min(F.struct("ord", "catalog_number")).alias("m")).select("file", "m.ord", "m.catalog_number")


def flat_json(text: Column) -> Column:
    """Scalars of a JSON object's first two levels as lines ``label value``; null for other texts."""
    top = F.map_entries(F.from_json(text, "map<string,string>"))

    def lines(e: Column) -> Column:
        inner = F.map_entries(F.from_json(F.when(e["value"].rlike(r"(?s)^\s*\{"), e["value"]), "map<string,string>"))
        return F.coalesce(F.transform(inner, lambda x: F.concat(e["key"], F.lit(" "), x["key"], F.lit(" "), x["value"])), F.array(F.concat(e["key"], F.lit(" "), e["value"])))

    return F.filter(F.flatten(F.transform(top, lines)), lambda x: F.regexp_replace(x, f"[{SPACE}]", "") != "")
