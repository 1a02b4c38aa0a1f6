"""Queries over state: health, drift, upserts, penalties, circuits, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state
from ..sources.tables import read_table
from .base import query

HEALTH = """sums AS (SELECT CAST(user_id AS VARCHAR) AS host, event_type AS stage, count(*) AS samples, count(*) FILTER (event_type <> 'error') AS successes, sum(CAST(value AS DECIMAL(18, 6))) AS quality_sum FROM events GROUP BY 1, 2),
health AS (SELECT host, stage, samples, CAST(successes AS DOUBLE) / samples AS success_rate, CAST(quality_sum AS DOUBLE) / samples AS avg_quality FROM sums),
drifted AS (SELECT *, samples >= 8 AND (success_rate < 0.45 OR avg_quality < 45) AS drift FROM health)"""


def _health(spark, d):
    return state.target_health(state.observations(read_table(spark, d, "events")))


@query("target_health", f"WITH {HEALTH} SELECT * FROM drifted")
def _(spark, d):
    return _health(spark, d)


@query("health_of_two_halves", f"WITH {HEALTH} SELECT * FROM drifted")
def _(spark, d):
    events = read_table(spark, d, "events")
    early, late = (state.health_sums(state.observations(events.filter(f"event_id % 2 = {k}"))) for k in (0, 1))
    return state.health_of(state.merge_sums(early, late))


@query(
    "drift_reasons",
    f"""WITH {HEALTH} SELECT host, stage, drift AS suspected, CASE WHEN samples < 8 THEN 'Not enough target health samples for drift detection.' WHEN drift THEN 'Target health degraded: success ' || CAST(floor(success_rate * 100 + 0.5) AS BIGINT)
    || '%, average quality ' || CAST(floor(avg_quality + 0.5) AS BIGINT) || '.' ELSE 'Target health is within expected bounds.' END AS reason FROM drifted""",
)
def _(spark, d):
    return state.drift_reason(_health(spark, d))


@query(
    "mining_decisions",
    """WITH l AS (SELECT l_orderkey AS o_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS docs FROM lineitem GROUP BY 1),
    r AS (SELECT o.o_orderkey AS item, CASE WHEN o.o_orderkey % 13 = 0 THEN 'image-only fast path' WHEN o.o_orderkey % 7 = 0 THEN 'target health degraded' WHEN o_orderstatus = 'P' THEN 'gate did not pass' WHEN o.o_orderkey % 101 < 82 AND o.o_orderkey % 2 = 0 THEN 'score below threshold'
      WHEN coalesce(n, 0) < 4 THEN 'low attribute yield' WHEN coalesce(docs, 0) = 0 THEN 'no image or datasheet' ELSE 'healthy enough' END AS reason FROM orders o LEFT JOIN l USING (o_orderkey))
    SELECT item, reason NOT IN ('image-only fast path', 'healthy enough') AS mine, reason FROM r""",
)
def _(spark, d):
    counts = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_attributes"), F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("n_documents"))
    key = F.col("o_orderkey")
    rows = read_table(spark, d, "orders").join(counts, "o_orderkey", "left").select(
        key.alias("item"), (key % 13 == 0).alias("image_only"), (key % 7 == 0).alias("drift"), (F.col("o_orderstatus") != "P").alias("gate_passed"), F.when(key % 2 == 0, key % 101).alias("score"), "n_attributes", "n_documents"
    )
    return state.mining_decisions(rows)


@query(
    "circuit_breaker_streaks",
    """WITH r AS (SELECT user_id, ts, event_id, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
    SELECT user_id, min(event_id) AS first_event, count(*) AS failures FROM r WHERE failed GROUP BY user_id, run HAVING count(*) >= 3""",
)
def _(spark, d):
    return state.failure_streaks(read_table(spark, d, "events"))


@query(
    "open_circuits",
    """WITH r AS (SELECT user_id, ts, event_id, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
    s AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS INTEGER) AS streak FROM r WHERE failed) SELECT user_id, event_id, streak, ts + INTERVAL 90 SECOND AS down_until FROM s WHERE streak >= 3""",
)
def _(spark, d):
    return state.open_circuits(read_table(spark, d, "events"))


@query(
    "host_penalties",
    """WITH RECURSIVE e AS (SELECT user_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(0 AS INTEGER) AS ms FROM e GROUP BY 1 UNION ALL SELECT e.user_id, e.n, CAST(CASE WHEN failed THEN least(CASE WHEN ms = 0 THEN 1000 ELSE ms * 2 END, 60000) WHEN ms // 2 < 250 THEN 0 ELSE ms // 2 END AS INTEGER) FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id, max_by(ms, n) AS penalty_ms FROM f GROUP BY 1""",
)
def _(spark, d):
    return state.host_penalties(read_table(spark, d, "events"))


@query(
    "upsert_endpoints",
    """WITH o AS (SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value, max(ts) AS ts, count(*) AS uses FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2), n AS (SELECT user_id, event_type, max_by(value, (ts, value)) AS value, max(ts) AS ts, count(*) AS times FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2)
    SELECT user_id, event_type, CASE WHEN n.times IS NULL THEN o.value ELSE n.value END AS value, CASE WHEN n.times IS NULL THEN o.ts ELSE n.ts END AS ts, coalesce(uses, 0) + coalesce(times, 0) AS uses FROM o FULL OUTER JOIN n USING (user_id, event_type)""",
)
def _(spark, d):
    events = read_table(spark, d, "events")
    old = events.filter("event_id % 3 = 0").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("uses"))
    changes = events.filter("event_id % 3 <> 0").select("user_id", "event_type", "value", "ts", F.lit(1).cast("long").alias("uses"))
    return state.upsert(old, changes, ["user_id", "event_type"], "ts", "uses")


@query(
    "recency_penalties",
    "SELECT o_custkey, CASE WHEN days > 90 THEN 20 WHEN days > 30 THEN 8 ELSE 0 END AS penalty FROM (SELECT o_custkey, epoch(TIMESTAMP '1998-08-01' - max(o_orderdate)) / 86400 AS days FROM orders GROUP BY 1)",
)
def _(spark, d):
    last = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    return last.select("o_custkey", state.recency_penalty(F.col("last"), F.lit("1998-08-01").cast("timestamp_ntz")).alias("penalty"))


@query("list_runs", "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def _(spark, d):
    return state.list_runs(read_table(spark, d, "orders"))


@query("pending_items", "SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS row_index, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')")
def _(spark, d):
    return state.pending_items(read_table(spark, d, "orders"), ["O", "P"])


@query(
    "cancel_pending",
    "SELECT o_orderkey AS item, CASE o_orderstatus WHEN 'P' THEN 'cancelled' ELSE o_orderstatus END AS status, CASE o_orderstatus WHEN 'P' THEN 'Cancelled by user.' ELSE o_orderpriority END AS error FROM orders",
)
def _(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.col("o_orderstatus"))
    return state.cancel_pending(read_table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), status.alias("status"), F.col("o_orderpriority").alias("error")))


@query(
    "patch_items",
    "SELECT o_orderkey AS item, CASE WHEN o_orderkey % 4 = 0 THEN 'done' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS title FROM orders",
)
def _(spark, d):
    orders = read_table(spark, d, "orders")
    items = orders.select(F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("title"))
    done = items.filter("item % 4 = 0").select("item", F.lit("status").alias("field"), F.lit("done").alias("value"))
    kept = items.filter("item % 4 = 1").select("item", F.lit("status").alias("field"), F.lit(None).cast("string").alias("value"))
    cleared = items.filter("item % 3 = 0").select("item", F.lit("title").alias("field"), F.lit(None).cast("string").alias("value"))
    return state.patch_items(items, done.union(kept).union(cleared))
