"""From raw documents to packed training sequences, as stages that are each written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Each stage defines null and empty texts as its operator does; columns beyond those of ``documents`` pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import remainder, shared_dir, table
from quarryline.llm.dart_minhash import near_classes, text_digest
from quarryline.llm.packing import pack_documents
from quarryline.llm.quality_gam import fit_quality, quality_score
from quarryline.llm.queries import tokenizer_file
from quarryline.llm.suffix_index import without_repeats
from quarryline.llm.toxicity import fit_toxicity, toxicity_score


#: Texts of an Arrow batch where whole rows wait beside it for a score. Spark's default of 10,000 keeps that many texts several
#: times (rows, Arrow, Python) for each task; the passage stage finds repeats within a batch first, so it takes larger ones.
SCORED_ROWS, PASSAGE_ROWS = 1000, 2500


def _batches_of(spark: SparkSession, rows: int) -> None:
    """Sets the session's Arrow batches, as the stage's result is computed after its function has returned; ``run`` sets them back."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score is 0.7 or more; the model never reads the held-out fold's labels."""
    _batches_of(spark, SCORED_ROWS)
    model = fit_quality(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2)
    return docs.filter(quality_score(model, docs)("text") >= 0.7)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity score is below 0.5; the model never reads the held-out fold's labels."""
    _batches_of(spark, SCORED_ROWS)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return docs.filter(toxicity_score(model, docs)("text") < 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: the smallest doc_id (null comes last), then the smallest digest of the text.

    Rows that share a doc_id with different texts are different documents here, and rows without a doc_id are compared like
    others. Of rows with equal doc_id and text, the one whose other columns, written as JSON, come first stays.
    """
    _batches_of(spark, SCORED_ROWS)
    placed = docs.select("doc_id", text_digest().alias("digest")).join(near_classes(docs), "digest")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    best = placed.groupBy("class").agg(F.min(order).alias("best")).select(F.col("best.doc_id").alias("best_id"), F.col("best.digest").alias("best_digest"))
    # whole rows travel as one column, so that names of further columns can't clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("row_id"), text_digest().alias("row_digest"))
    kept = rows.join(best, (F.col("row_digest") == F.col("best_digest")) & F.col("row_id").eqNullSafe(F.col("best_id")))
    # columns of any type, maps too, have an order as text
    others = [F.col("row")[c] for c in docs.columns if c not in ("doc_id", "text")]
    order = F.coalesce(F.to_json(F.struct(*others)), F.lit("")) if others else F.lit("")
    return kept.groupBy("best_digest", "best_id").agg(F.min_by("row", order).alias("row")).select("row.*")


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 100 bytes or more that occur earlier; documents of which nothing is left go."""
    _batches_of(spark, PASSAGE_ROWS)
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 2048 tokens."""
    _batches_of(spark, SCORED_ROWS)
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("packing", packing),
]

#: Trained models, exact similarity and byte-wise matching aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's result is a table in the shared folder. The session's settings are then as before."""
    docs = table(spark, sf_dir, "documents")
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for name, stage in STAGES:
            path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
            docs = spark.read.schema(made.schema).parquet(path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)
    return docs
