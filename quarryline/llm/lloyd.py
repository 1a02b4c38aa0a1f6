"""Plain Lloyd clustering of whole vectors in integers, so every machine and every partitioning gives equal results.

Each component x becomes floor(64 * x), with x as double. A round broadcasts the centroids (k times the dimension, a bounded table),
computes squared differences per centroid in NumPy, takes the lowest index of the smallest and sums integers per partition; the partial
sums, at most k rows a partition, merge through groupBy. Only k rows of sums reach the driver, and vectors are never shuffled.

Odd rows: a vector that is null, has another number of components, or has a null or non-finite one is left out. Repeated rows and repeated
or null ids count once for each row; a null id counts as the empty text where the first centroids are drawn, and ties there go by the
components. With fewer vectors than ``k`` there are as many centroids as vectors; an empty table gives an empty result. Beyond
+-2**27 (x beyond +-2,097,152) a component stays at that bound, so that all distances fit a long. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components are multiples of one part in SCALE; |component| stays at BOUND, so 64 squared differences fit a long.
SCALE, BOUND = 64, 1 << 27
#: Rows that are compared at once; bounds the memory of a task.
ROWS = 4096


def usable(vectors: DataFrame, dimension: int, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, vector (array<double>) of the rows whose vector has ``dimension`` finite components."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("vector"))
    return rows.filter((F.size("vector") == dimension) & finite)


def quantised(vectors: pd.Series, dimension: int) -> np.ndarray:
    """Rows of integers."""
    floats = np.concatenate(vectors.to_numpy()).reshape(-1, dimension) if len(vectors) else np.zeros((0, dimension))
    return np.clip(np.floor(floats * SCALE), -BOUND, BOUND).astype(np.int64)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smallest of equals) and the squared distance to it."""
    distances = np.empty((len(centroids), len(rows)), np.int64)
    for number, centroid in enumerate(centroids):
        difference = rows - centroid
        distances[number] = np.einsum("ij,ij->i", difference, difference)
    cluster = distances.argmin(axis=0)
    return cluster, distances[cluster, np.arange(len(rows))]


def first_centroids(rows: DataFrame, k: int, dimension: int) -> np.ndarray:
    """The vectors of the ``k`` smallest sha256 of ``1:<id>``."""
    drawn = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = rows.select(drawn.alias("drawn"), "vector").orderBy("drawn", "vector").limit(k).collect()
    return quantised(pd.Series([np.array(r.vector) for r in found], dtype=object), dimension)


def _partial_sums(centroids, dimension: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, k = centroids.value, len(centroids.value)
        sums, counts = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = quantised(batch["vector"].iloc[at : at + ROWS], dimension)
                cluster, _ = nearest(rows, points)
                np.add.at(sums, cluster, rows)
                counts += np.bincount(cluster, minlength=k)
        met = np.flatnonzero(counts)
        yield pd.DataFrame({"cluster": met.astype(np.int32), "n": counts[met], "sums": list(sums[met])})

    return run


def _assignment(centroids, dimension: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                cluster, distance = nearest(quantised(part["vector"], dimension), centroids.value)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "cluster": cluster.astype(np.int32), "distance": distance})

    return run


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of their vectors; those without vectors stay."""
    if not len(centroids):
        return centroids
    dimension, sent = centroids.shape[1], rows.sparkSession.sparkContext.broadcast(centroids)
    partial = rows.select("vector").mapInPandas(_partial_sums(sent, dimension), "cluster int, n long, sums array<long>")
    cells = partial.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    merged = cells.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect()  # k * dimension rows
    after = centroids.copy()
    for cell in merged:
        after[cell["cluster"], cell["at"]] = cell["total"] // cell["n"]
    return after


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dimension: int = 64, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector; the id keeps its name."""
    spark, rows = vectors.sparkSession, usable(vectors, dimension, id_column, column)
    centroids = first_centroids(rows, k, dimension)
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    kind = dict(rows.dtypes)["id"]
    sent = spark.sparkContext.broadcast(centroids)
    assigned = rows.mapInPandas(_assignment(sent, dimension), f"id {kind}, cluster int, distance long")
    # at most k rows, and no row without a vector: a bounded side for the join and for the total
    inertias = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(r.cluster_inertia for r in inertias)
    table = spark.createDataFrame([(r.cluster, r.cluster_inertia, total, digests[r.cluster]) for r in inertias], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
