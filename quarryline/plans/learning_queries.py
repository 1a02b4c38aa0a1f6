"""Queries over learned extractors, learned on even pages and tried on odd ones, and over marks that expire."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extractors
from ..sources.analogues import spec_page
from ..sources.tables import read_table
from ..streaming.marks import live_marks
from .base import query


def _taught(spark, d):
    """The texts of even pages, those of odd ones, and accepted values."""
    part = read_table(spark, d, "part")
    pages = spec_page(part).withColumn("host", F.concat(F.lit("h"), (F.col("page_id") % 4 / 2).cast("int").cast("string")))
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in (("width", F.concat(F.col("p_size").cast("string"), F.lit(" mm"))), ("kind", F.col("p_type")), ("price", price), ("nowhere", F.lit("not on the page")))]))
    truth = part.select(F.col("p_partkey").alias("page_id"), values.alias("x")).select("page_id", "x.*")
    return *[extractors.placed_texts(pages.filter(F.col("page_id") % 2 == k)) for k in (0, 1)], truth


@query(
    "learned_values",
    "SELECT p_partkey AS page_id, field, value FROM part, LATERAL (VALUES ('width', p_size || ' mm'), ('kind', p_type), ('price', CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR))) AS v(field, value) WHERE p_partkey % 2 = 1",
)
def _(spark, d):
    even, odd, truth = _taught(spark, d)
    learned = extractors.learned_extractors(even, truth.filter("page_id % 2 = 0"))
    return extractors.extracted(odd, learned)


@query(
    "extractor_quality",
    "SELECT field, count(*) AS n, CASE WHEN field = 'nowhere' THEN 0 ELSE count(*) END AS found, CASE WHEN field = 'nowhere' THEN 0 ELSE count(*) END AS right FROM part, (VALUES ('width'), ('kind'), ('price'), ('nowhere')) AS v(field) WHERE p_partkey % 2 = 1 GROUP BY field".replace("AS right", 'AS "right"'),
)
def _(spark, d):
    even, odd, truth = _taught(spark, d)
    learned = extractors.learned_extractors(even, truth.filter("page_id % 2 = 0"))
    return extractors.extractor_quality(extractors.extracted(odd, learned), truth.filter("page_id % 2 = 1"))


@query(
    "live_marks",
    """WITH m AS (SELECT user_id AS key, CAST(ts AS TIMESTAMP) AS t, CASE WHEN event_type = 'error' THEN 'clear' ELSE 'set' END AS action, event_type AS value FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t DESC, action DESC, value DESC) AS n FROM m)
    SELECT key, epoch_us(t) AS micros, value FROM r WHERE n = 1 AND action = 'set' AND t >= (SELECT max(t) FROM m) - INTERVAL 1 DAY""",
)
def _(spark, d):
    events = read_table(spark, d, "events")
    marks = events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "error", "clear").otherwise("set").alias("action"), F.col("event_type").alias("value"))
    now = marks.agg(F.unix_micros(F.max("at"))).first()[0]
    return live_marks(marks, F.timestamp_micros(F.lit(now or 0)), 24 * 3600).select("key", F.unix_micros("at").alias("micros"), "value")
