"""Small helpers shared by the operators: shared storage, folds, samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where it is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="quarryline-"))
    return where or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a narrow result in the shared checkpoint folder; lost executors don't lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As :func:`cut`, but as a compressed Parquet table, for results with many rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarryline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled training rows (text, label), the same ones on every run.

    The bound is on label rows, chosen by a hash of the id; ``keep`` excludes the held-out fold.
    Labels that are null and ids that ``documents`` lacks are left out; of rows that repeat an id, one counts.
    """
    chosen = (
        labels.filter(keep & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .select("doc_id", F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(rows)
    )
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("row")).select("doc_id", "row.text", "row.label")
