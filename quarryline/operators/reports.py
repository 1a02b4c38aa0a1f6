"""Report relations: coverage, fill rates, issues, queues, matrices, frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def coverage(customers: DataFrame, nations: DataFrame) -> DataFrame:
    """Share of each nation's customers with a positive balance."""
    joined = nations.join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    held = F.count(F.when(F.col("c_acctbal") > 0, 1))
    total = F.count("c_custkey")
    return joined.groupBy("n_name").agg(total.alias("total"), held.alias("covered"), F.round(held / F.nullif(total, F.lit(0)), 4).alias("ratio"))


def fill_rates(table: DataFrame) -> DataFrame:
    """column, filled, total for every column; a text that is empty or blank isn't filled."""
    def filled(name: str, kind: str):
        return F.count(F.when(F.trim(F.col(name)) != "", 1)) if kind == "string" else F.count(name)

    counts = table.agg(F.count(F.lit(1)).alias("_total"), *[filled(c, t).alias(c) for c, t in table.dtypes])
    return counts.unpivot("_total", [c for c, _ in table.dtypes], "column_name", "filled").select("column_name", "filled", F.col("_total").alias("total"))


def duplicate_keys(table: DataFrame, key: str) -> DataFrame:
    return table.groupBy(F.col(key).alias("key_value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def issue_summary(events: DataFrame) -> DataFrame:
    """Errors by day and user group, with the largest value."""
    issues = events.filter("event_type = 'error'")
    return issues.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.pmod("user_id", F.lit(10)).alias("user_group")).agg(F.count(F.lit(1)).alias("issues"), F.max("value").alias("worst"))


def review_queue(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents that need a look, with the reason that comes first."""
    reason = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "quality").when(F.col("n_chars") < 100, "short")
    return documents.join(labels, "doc_id").select("doc_id", "source", reason.alias("reason")).filter("reason is not null")


def primary_per_type(parts: DataFrame) -> DataFrame:
    """The cheapest part of each type; ties go to the smaller key."""
    best = F.min_by(F.struct("p_partkey", "p_retailprice"), F.struct("p_retailprice", "p_partkey")).alias("best")
    return parts.groupBy("p_type").agg(best).select("p_type", "best.p_partkey", "best.p_retailprice")


def spec_matrix(events: DataFrame, columns: list[str]) -> DataFrame:
    """Long rows to a wide matrix: a user's largest value of each type."""
    return events.groupBy("user_id").pivot("event_type", columns).agg(F.max("value"))


def label_frequencies(conversations: DataFrame, least: int = 1) -> DataFrame:
    """Words of all turns with their number of occurrences and of conversations; ``least`` is for queries whose SQL has a bound."""
    words = conversations.select("conv_id", F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("label")).filter("label <> ''")
    return words.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("conversations")).filter(F.col("n") >= least)


def first_wins(events: DataFrame) -> DataFrame:
    """Distinct types of each user in order of first appearance."""
    first = events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return first.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("at")).alias("ord"), F.col("at.event_id").alias("event_id"))


def neighbourhoods(documents: DataFrame, needle: str, reach: int = 1) -> DataFrame:
    """Merged windows of lines within ``reach`` of a line that has ``needle``: doc_id, first_line, last_line."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "words")).filter(F.contains("words", F.lit(needle)))
    order = Window.partitionBy("doc_id").orderBy("line")
    gap = F.coalesce((F.col("line") - F.lag("line").over(order) > 2 * reach + 1).cast("int"), F.lit(1))
    runs = lines.withColumn("gap", gap).withColumn("run", F.sum("gap").over(order))
    return runs.groupBy("doc_id", "run").agg(F.greatest(F.min("line") - reach, F.lit(0)).alias("first_line"), (F.max("line") + reach).alias("last_line")).drop("run")


def value_counts(table: DataFrame, column: str) -> DataFrame:
    """Each value with its number of rows and its place: most frequent first, then in order of text; null and blank values don't count."""
    counts = table.filter(F.trim(F.col(column).cast("string")) != "").groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value")))  # one row for each value: categories of a report


def compact_list(values: Column, most: int) -> Column:
    """The first ``most`` values joined, then how many more there are."""
    more = F.size(values) - most
    return F.when(more <= 0, F.array_join(values, "; ")).otherwise(F.concat(F.array_join(F.slice(values, 1, most), "; "), F.lit("; +"), more.cast("string"), F.lit(" more")))


def column_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """For each common column: rows that only one side fills, that both fill and agree on, that differ, that neither fills. Rows meet by key; keys of one side only don't count."""
    columns = [c for c in left.columns if c != key and c in right.columns]
    a = left.select(key, *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(f"a_{c}") for c in columns])
    b = right.select(key, *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(f"b_{c}") for c in columns])
    cells = a.join(b, key).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in columns])).alias("x")).select("x.*")
    tests = {"left_only": "a is not null and b is null", "right_only": "a is null and b is not null", "both": "a = b", "differ": "a <> b", "both_empty": "a is null and b is null"}
    return cells.groupBy("column_name").agg(*[F.count(F.when(F.expr(t), 1)).alias(n) for n, t in tests.items()])


#: Rank of an attribute's group by what it contains.
GROUPS = [("dimension", 10), ("spec|product information|product details|technical|table|definition", 20), ("industry|standard|approval|cert", 30), ("search", 40), ("offer", 50), ("embedded", 70), ("structured", 80), ("meta", 90)]


def sorted_attributes(attributes: DataFrame) -> DataFrame:
    """Attributes with their place within an item: by rank of their group, name, value (without regard to case), then order of coming."""
    group, rank = F.lower(F.coalesce("group", F.lit(""))), F.when(F.lit(False), 0)
    for pattern, n in GROUPS:
        rank = rank.when(group.rlike(pattern), n)
    order = Window.partitionBy("item").orderBy(rank.otherwise(60), F.lower("name"), F.lower("value"), "ord")
    return attributes.select("*", F.row_number().over(order).alias("place"))


def processing_summary(records: DataFrame) -> DataFrame:
    """item, parsed, skipped, failed, attributes of document processing records (item, action, attributes)."""
    counts = [F.count(F.when(F.col("action") == a, 1)).alias(a) for a in ("parsed", "skipped", "failed")]
    return records.groupBy("item").agg(*counts, F.coalesce(F.sum("attributes"), F.lit(0)).alias("attributes"))


def merge_attempts(attempts: DataFrame, most: int = 20) -> DataFrame:
    """The last ``most`` distinct attempts of an item: the first of equal stage, url, parser, status and reason stays, with its place."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in ("stage", "url", "parser", "status", "reason")]
    once = attempts.groupBy("item", *keys).agg(F.min("ord").alias("ord"), F.min_by(F.struct("stage", "url", "parser", "status", "reason"), "ord").alias("a"))
    last = Window.partitionBy("item").orderBy(F.desc("ord"))
    return once.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= most).select("item", "ord", "a.*")


def merged_fields(results: DataFrame, fields: list[str]) -> DataFrame:
    """item and its fields from several results (item, ord, fields): the first result that fills a field wins."""
    filled = [F.min_by(F.nullif(F.trim(F.col(f)), F.lit("")), F.when(F.trim(F.col(f)) != "", F.col("ord"))).alias(f) for f in fields]
    return results.groupBy("item").agg(*filled)


def rates(rows: DataFrame, group: str, flags: list[str]) -> DataFrame:
    """For each group its rows and the share of each flag in percent, to two places; a null flag is false."""
    shares = [F.round(100 * F.count(F.when(F.col(f), 1)) / F.count(F.lit(1)), 2).alias(f"{f}_pct") for f in flags]
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *shares)
