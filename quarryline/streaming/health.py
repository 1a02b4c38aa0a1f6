"""Streams: target health kept as running sums, and hourly counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import health_of, health_sums, merge_sums, observations


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a stream's state must outlive its machine, so there is no other by default."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        raise ValueError("name a folder that all machines share, or set spark.checkpoint.dir to one")
    return where


def health_stream(spark: SparkSession, folder: str, name: str, shared: str | None = None) -> DataFrame:
    """Adds the events in the Parquet files of ``folder`` to the health sums, until all are read; the health after them.

    Each micro-batch adds its sums to the state of the batch before and writes them under its own number, so a batch that runs
    again writes the same. The state is one row for each host and stage; only the last two states are ever read. A second call
    with the same ``name`` goes on where the first ended.
    """
    place = f"{shared or shared_folder(spark)}/{name}"
    schema = spark.read.parquet(folder).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    nothing = health_sums(observations(spark.createDataFrame([], schema)))

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        old = session.read.schema(nothing.schema).parquet(f"{place}/sums/{number - 1}") if number else nothing
        merge_sums(old, health_sums(observations(batch))).write.mode("overwrite").parquet(f"{place}/sums/{number}")

    query = events.writeStream.foreachBatch(add).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    state = spark.read.schema(nothing.schema).option("recursiveFileLookup", "false").parquet(f"{place}/sums/{last['batchId'] if last and last['numInputRows'] else _latest(spark, place)}")
    return health_of(state)


def _latest(spark: SparkSession, place: str) -> int:
    """The number of the last state under ``place``, read from its files' paths."""
    paths = spark.read.option("recursiveFileLookup", "true").parquet(f"{place}/sums").select(F.regexp_extract(F.input_file_name(), r"/sums/(\d+)/", 1).cast("int").alias("n"))
    return paths.agg(F.max("n")).first()[0]


def hourly_counts(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Events by hour and type; a stream drops what is later than ``lateness``."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("at", lateness)
    return timed.groupBy(F.window("at", "1 hour").start.alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
