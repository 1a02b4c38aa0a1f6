"""Marks that expire: the latest mark of each key for as long as it lives, over a table and over a stream.

Page caches, fields that were searched in vain and hosts that rest are all of this kind: a key gets a mark, a later mark or a removal
replaces it, and it ends by itself. Marks are rows of key, at, action (``set`` or ``clear``) and value. Of a key's marks the latest counts, of
equally late ones the greater by action, then by value, so replays and the order of rows change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .health import shared_folder

#: Times are kept as microseconds, which have no zone.
_STATE = "micros long, action string, value string"


def latest_marks(marks: DataFrame) -> DataFrame:
    """key, at, action, value: the latest mark of each key. Marks without a key, a time or an action go."""
    rows = marks.filter("key is not null and at is not null and action is not null")
    return rows.groupBy("key").agg(F.max(F.struct("at", "action", F.coalesce("value", F.lit("")).alias("value"))).alias("m")).select("key", "m.*")


def live_marks(marks: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """key, at, value of the keys whose latest mark is set and at most ``ttl_seconds`` old at ``now``; a mark after ``now`` lives too."""
    fresh = F.col("at") >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds))
    return latest_marks(marks).filter((F.col("action") == "set") & fresh).select("key", "at", "value")


class LatestMark(StatefulProcessor):
    """Keeps the latest mark of each key, says when it changes, and forgets it once no later row can matter to it."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("latest", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = tuple(self.state.get()) if self.state.exists() else None
        best = max(((r["micros"], r["action"], r["value"] or "") for r in rows), default=None)
        if best is None or (known is not None and best <= known):
            return
        self.state.update(best)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(best[0] // 1000 + self.ttl)
        yield Row(key=key[0], micros=best[0], action=best[1], value=best[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            micros, _, _ = self.state.get()
            self.state.clear()
            yield Row(key=key[0], micros=micros, action="expired", value="")


def mark_changes(spark: SparkSession, folder: str, name: str, ttl_seconds: int, shared: str | None = None) -> DataFrame:
    """Reads the Parquet files of marks in ``folder`` that weren't read before and returns all changes so far: key, at, action, value.

    The stream is late by as much as a mark lives, so a row that comes too late for it would be dead anyway; state lives twice as long at
    most. Each micro-batch writes its changes under its own number, so one that runs again writes the same. ``live_marks`` of the changes,
    with the latest time as now, equals that of all rows.
    """
    place = f"{shared or shared_folder(spark)}/{name}"
    schema = spark.read.parquet(folder).select("key", "at", "action", "value").schema
    marks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).filter("key is not null and at is not null and action is not null")
    timed = marks.withColumn("at", F.col("at").cast("timestamp")).withColumn("micros", F.unix_micros("at")).withWatermark("at", f"{ttl_seconds} seconds")
    kind = next(f.dataType.simpleString() for f in schema if f.name == "key")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        changes = timed.groupBy("key").transformWithState(statefulProcessor=LatestMark(ttl_seconds), outputStructType=f"key {kind}, {_STATE}", outputMode="Update", timeMode="EventTime")

        def keep(batch: DataFrame, number: int) -> None:
            batch.select("key", F.timestamp_micros("micros").alias("at"), "action", "value").write.mode("overwrite").parquet(f"{place}/changes/{number}")

        changes.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.option("recursiveFileLookup", "true").schema(f"key {kind}, at timestamp, action string, value string").parquet(f"{place}/changes")
