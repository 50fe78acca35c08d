"""Centroid clustering of integer vectors by partial-distance search.

Components become floor(1024 * x). The first centroids are the vectors with the smallest SHA-256 of "3:<vec_id>"; each
round assigns every vector to the nearest centroid and replaces centroids by the floor of their vectors' means. All of
it is integer arithmetic, so results do not depend on how rows are dealt to tasks.

A search adds up squared differences over the dimensions of high variance first, in steps of STEP dimensions. It starts
from the centroid that is nearest after the first step, whose distance it completes; a vector leaves another centroid as
soon as its partial sum is strictly above the best whole distance, and only survivors finish all dimensions. Ties go to
the smaller number, so a partial sum that equals the best goes on.

Vectors that are null, have another number of components, or hold a null or non-finite one take no part and have no row.
Components of 2**17 or more in size would not fit distances in 64 bits: they raise an error. Repeated rows count as often
as they occur, and each has its row. Rows with a null id are clustered as others, but serve as first centroids only where
fewer than K ids exist; of equal digests the smaller vector comes first. With fewer than K vectors there are as many
centroids as vectors. Extra columns are ignored; an empty table gives no rows. There are no texts.

A round moves K rows of sums a task; only K centroids of 64 numbers and sums of them reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

DIMENSIONS, SCALE, LARGEST = 64, 1024, 1 << 17
K, ROUNDS, SEED, STEP = 8, 10, 3, 8
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v array<int>) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    whole = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    far = F.raise_error(F.lit(f"component of {LARGEST} or more: distances would not fit in 64 bits")).cast("int")
    v = F.transform(x, lambda c: F.when(F.abs(c) < LARGEST, F.floor(c * SCALE).cast("int")).otherwise(far))
    return vectors.filter(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long"), v.alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors of the k smallest digests, in ascending order: at most k rows reach the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(digest.alias("digest"), "v").orderBy(F.asc_nulls_last("digest"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def by_variance(vectors: DataFrame, dimensions: int) -> np.ndarray:
    """Dimensions, those of highest variance first. The order steers the work, never the result."""
    row = vectors.agg(*[F.var_pop(F.col("v")[j]).alias(f"d{j}") for j in range(dimensions)]).head()
    return np.argsort([-(x or 0.0) for x in row], kind="stable")


def nearest(x: np.ndarray, centroids: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to each vector's nearest centroid, and how many squared differences that took.

    Vectors and centroids hold int64 components in the same order of dimensions.
    """
    n, d = x.shape
    k = len(centroids)
    head = ((x[:, None, :step] - centroids[None, :, :step]) ** 2).sum(2)
    cluster = head.argmin(1)
    best = head[np.arange(n), cluster] + ((x[:, step:] - centroids[cluster, step:]) ** 2).sum(1)
    guess, terms = cluster.copy(), n * k * min(step, d) + n * max(d - step, 0)
    for c in range(k):
        rows = np.flatnonzero((guess != c) & (head[:, c] <= best))
        partial = head[rows, c]
        for at in range(step, d, step):
            part = x[rows, at : at + step] - centroids[c, at : at + step]
            terms += part.size
            partial = partial + (part * part).sum(1)
            stay = partial <= best[rows]
            rows, partial = rows[stay], partial[stay]
        better = (partial < best[rows]) | (c < cluster[rows])
        rows, partial = rows[better], partial[better]
        best[rows], cluster[rows] = partial, c
    return cluster, best, terms


def _batches(batches: Iterator[pa.RecordBatch], order: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in common.slices(batches, rows=4096):
        if batch.num_rows:
            yield batch, batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)[:, order].astype(np.int64)


def _sums(centroids: np.ndarray, order: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's count and componentwise sums for each centroid: at most k rows a task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, x in _batches(batches, order):
            cluster, _, _ = nearest(x, centroids[:, order])
            counts += np.bincount(cluster, minlength=len(counts))
            for c in range(len(counts)):
                total[c, order] += x[cluster == c].sum(0)
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(has, pa.int32()), "n": counts[has], "sums": pa.array(list(total[has]), pa.list_(pa.int64()))})

    return sums


def _assigned(centroids: np.ndarray, order: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _batches(batches, order):
            cluster, distance, _ = nearest(x, centroids[:, order])
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "cluster": cluster.astype(np.int32), "distance": distance})

    return assigned


def moved(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One round: the floor of each cluster's mean; a centroid without vectors stays."""
    parts = vectors.mapInArrow(_sums(centroids, order), "cluster int, n long, sums array<long>")
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(centroids.shape[1])])
    after = centroids.copy()
    for cluster, n, *sums in whole.collect():
        after[cluster] = [s // n for s in sums]
    return after


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector after ``rounds`` rounds."""
    spark = vectors.sparkSession
    rows = common.written(integers(vectors, dimensions), "integers")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    order = by_variance(rows, dimensions)
    for _ in range(rounds):
        centroids = moved(rows, centroids, order)
    last = common.written(rows.mapInArrow(_assigned(centroids, order), "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: r.total for r in last.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, t, sum(inertia.values()), digest[c]) for c, t in inertia.items()]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
