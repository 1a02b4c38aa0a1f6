"""State kept over observations: health, drift, latest wins, time to live, streaks. Batch forms of the streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Samples before drift is judged, and the least healthy success rate and quality.
DRIFT_SAMPLES, DRIFT_SUCCESS, DRIFT_QUALITY = 8, 0.45, 45.0
#: Failures in a row after which a host rests, and for how many seconds; the first, longest and least penalty in milliseconds.
DOWN_AFTER, DOWN_SECONDS = 3, 90
PENALTY_FIRST, PENALTY_MOST, PENALTY_LEAST = 1000, 60_000, 250


def health_sums(observations: DataFrame) -> DataFrame:
    """host, stage -> samples, successes, quality_sum: sums that add up over any split of the observations.

    A null quality counts as 0 and a null host or stage as the empty text. Quality is summed as a decimal of six places, so the order of rows doesn't matter.
    """
    host, stage = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("host", "stage"))
    quality = F.sum(F.coalesce(F.col("quality"), F.lit(0)).cast("decimal(18,6)")).alias("quality_sum")
    return observations.groupBy(host, stage).agg(F.count(F.lit(1)).alias("samples"), F.count(F.when(F.col("passed"), 1)).alias("successes"), quality.cast("decimal(28,6)").alias("quality_sum"))


def merge_sums(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two tables of sums as one."""
    both = old.unionByName(new).groupBy("host", "stage").agg(*[F.sum(c).alias(c) for c in ("samples", "successes", "quality_sum")])
    return both.withColumn("quality_sum", F.col("quality_sum").cast("decimal(28,6)"))


def health_of(sums: DataFrame) -> DataFrame:
    """Rates of the sums, and whether they have drifted; only groups with enough samples can drift."""
    success, quality = F.col("successes") / F.col("samples"), F.col("quality_sum").cast("double") / F.col("samples")
    drift = (F.col("samples") >= DRIFT_SAMPLES) & ((success < DRIFT_SUCCESS) | (quality < DRIFT_QUALITY))
    return sums.select("host", "stage", "samples", success.alias("success_rate"), quality.alias("avg_quality"), drift.alias("drift"))


def target_health(observations: DataFrame) -> DataFrame:
    """host, stage -> samples, success rate, mean quality, drift."""
    return health_of(health_sums(observations))


def drift_reason(health: DataFrame) -> DataFrame:
    """host, stage, suspected, reason: too few samples, degraded (with its figures) or within bounds."""
    few = F.col("samples") < DRIFT_SAMPLES
    said = F.concat(
        F.lit("Target health degraded: success "), F.floor(F.col("success_rate") * 100 + 0.5).cast("string"), F.lit("%, average quality "), F.floor(F.col("avg_quality") + 0.5).cast("string"), F.lit(".")
    )
    reason = F.when(few, "Not enough target health samples for drift detection.").when(F.col("drift"), said).otherwise("Target health is within expected bounds.")
    return health.select("host", "stage", F.col("drift").alias("suspected"), reason.alias("reason"))


def mining_decisions(items: DataFrame) -> DataFrame:
    """item, mine, reason: whether a result is worth mining further, by the first reason that holds.

    ``items``: item, image_only, drift, gate_passed, score, n_attributes, n_documents. Nulls: no drift, gate not passed, score 100.
    """
    rules = [
        (F.coalesce("image_only", F.lit(False)), False, "image-only fast path"), (F.coalesce("drift", F.lit(False)), True, "target health degraded"), (~F.coalesce("gate_passed", F.lit(False)), True, "gate did not pass"),
        (F.coalesce("score", F.lit(100)) < 82, True, "score below threshold"), (F.coalesce("n_attributes", F.lit(0)) < 4, True, "low attribute yield"), (F.coalesce("n_documents", F.lit(0)) == 0, True, "no image or datasheet"),
    ]
    mine, reason = F.when(F.lit(False), False), F.when(F.lit(False), "")
    for test, yes, said in rules:
        mine, reason = mine.when(test, yes), reason.when(test, said)
    return items.select("item", mine.otherwise(False).alias("mine"), reason.otherwise("healthy enough").alias("reason"))


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], order: str, added: str | None = None) -> DataFrame:
    """``state`` after ``changes`` (same columns, and ``order``): the last change of a key replaces its row; ``added`` counts up by the number of changes.

    Changes of equal order are told apart by their columns, the greatest wins. State rows without a change stay as they are.
    """
    kept = [c for c in state.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct(order, *[c for c in kept if c != order])).alias("new"), F.count(F.lit(1)).alias("times"))
    joined = state.select(*keys, F.struct(*kept).alias("old")).join(last, keys, "full_outer")
    columns = [F.when(F.col("new").isNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in kept if c != added]
    if added:
        columns.append((F.coalesce(F.col(f"old.{added}"), F.lit(0)) + F.coalesce(F.col("times"), F.lit(0))).alias(added))
    return joined.select(*keys, *columns).select(*state.columns)


def recency_penalty(last_success: Column, now: Column) -> Column:
    """20 points after 90 days without success, 8 after 30, none before or without a time."""
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_success.cast("timestamp"))) / 86_400_000_000
    return F.when(days > 90, 20).when(days > 30, 8).otherwise(0)


def open_circuits(events: DataFrame, least: int = DOWN_AFTER, seconds: int = DOWN_SECONDS) -> DataFrame:
    """Failures that find a host resting or put it to rest: user_id, event_id, streak, down_until.

    From the ``least``-th failure in a row on, each failure lets the host rest for ``seconds``; a success ends the run at once.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    failed = F.col("event_type") == "error"
    runs = events.withColumn("run", F.sum((~failed).cast("int")).over(order)).filter(failed)
    streak = F.row_number().over(Window.partitionBy("user_id", "run").orderBy("ts", "event_id"))
    return runs.withColumn("streak", streak).filter(F.col("streak") >= least).select("user_id", "event_id", "streak", (F.col("ts") + F.expr(f"interval {seconds} seconds")).alias("down_until"))


def host_penalties(events: DataFrame) -> DataFrame:
    """user_id, penalty_ms after all events in order: a failure doubles it (from 1 s, at most a minute), another event halves it, below 250 ms it is gone.

    A grouped fold over each user's events in order of time; the list of one user's states must fit a task.
    """
    listed = events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", (F.col("event_type") == "error").alias("failed")))).alias("all"))

    def step(ms: Column, e: Column) -> Column:
        halved = F.floor(ms / 2)
        return F.when(e["failed"], F.least(F.when(ms == 0, PENALTY_FIRST).otherwise(ms * 2), F.lit(PENALTY_MOST))).otherwise(F.when(halved < PENALTY_LEAST, 0).otherwise(halved)).cast("int")

    return listed.select("user_id", F.aggregate("all", F.lit(0), step).alias("penalty_ms"))


def observations(events: DataFrame) -> DataFrame:
    """Events as observations: the user is the host, the type the stage, an error a failure."""
    return events.select(F.col("user_id").alias("host"), F.col("event_type").alias("stage"), (F.col("event_type") != "error").alias("passed"), F.col("value").alias("quality"), "ts", "event_id")


def latest_wins(events: DataFrame) -> DataFrame:
    """The last event of each (user, type); ties go to the larger event_id."""
    last = F.max(F.struct("ts", "event_id", "value")).alias("last")
    return events.groupBy("user_id", "event_type").agg(last).select("user_id", "event_type", "last.event_id", "last.value")


def learned_top(events: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most used types of each user, counted up, with the time of the last use."""
    used = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("uses"), F.max("ts").alias("last_used"))
    order = Window.partitionBy("user_id").orderBy(F.desc("uses"), F.desc("last_used"), "event_type")
    return used.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("user_id", "rank", "event_type", "uses")


def open_after_ttl(orders: DataFrame, customers: DataFrame, cutoff: str) -> DataFrame:
    """Customers without a mark (an order) at or after ``cutoff``: what has expired may be tried again."""
    marked = orders.filter(F.col("o_orderdate") >= F.lit(cutoff).cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    return customers.join(marked, "c_custkey", "left_anti").select("c_custkey", "c_name")


def failure_streaks(events: DataFrame, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` errors of a user without another event between, in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    failed = F.col("event_type") == "error"
    runs = events.select("user_id", "ts", "event_id", failed.alias("failed"), F.sum((~failed).cast("int")).over(order).alias("run")).filter("failed")
    return runs.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("failures"), F.min("event_id").alias("first_event")).filter(F.col("failures") >= least).select("user_id", "first_event", "failures")


def recount(orders: DataFrame) -> DataFrame:
    """Counters of each run (priority) by item status."""
    status = [F.sum((F.col("o_orderstatus") == s).cast("long")).alias(n) for s, n in (("F", "found"), ("O", "open_items"), ("P", "partial"))]
    return orders.groupBy(F.col("o_orderpriority").alias("run")).agg(F.count(F.lit(1)).alias("items"), *status)


def list_runs(orders: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` latest runs, newest first; ties go to the greater key."""
    return orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(k).select("o_orderkey", "o_orderstatus", "o_orderdate")


def pending_items(orders: DataFrame, states: list[str]) -> DataFrame:
    """Items of the wanted states with their place in their run."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.filter(F.col("o_orderstatus").isin(*states)).select("o_custkey", F.row_number().over(order).alias("row_index"), "o_orderkey", "o_orderstatus")


def cancel_pending(items: DataFrame) -> DataFrame:
    """Items with the pending ones cancelled; the others stay."""
    pending = F.col("status") == "pending"
    return items.withColumns({"error": F.when(pending, "Cancelled by user.").otherwise(F.col("error")), "status": F.when(pending, "cancelled").otherwise(F.col("status"))})


def patch_items(items: DataFrame, patches: DataFrame) -> DataFrame:
    """Items with the patched fields replaced. A patch (item, field, value) sets a field, a null value clears it; status is never cleared; fields without a patch stay.

    Of several patches of a field the greatest value counts.
    """
    fields = [c for c in items.columns if c != "item"]
    one = patches.groupBy("item", "field").agg(F.max(F.struct(F.col("value").isNotNull().alias("given"), "value")).alias("p")).groupBy("item").pivot("field", fields).agg(F.first("p.value"), F.count(F.lit(1)))
    one = one.toDF("item", *[n for f in fields for n in (f"_{f}", f"_{f}_n")])
    joined = items.join(one, "item", "left")
    set_ = {f: (F.col(f"_{f}_n") > 0) & (F.col(f"_{f}").isNotNull() | F.lit(f != "status")) for f in fields}
    return joined.select("item", *[F.when(F.coalesce(set_[f], F.lit(False)), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields])
