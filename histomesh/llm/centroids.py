"""Centroid clustering of integer vectors with a LAESA pivot table.

The distances of every vector to a few fixed pivots are worked out once and stored beside it. By the
triangle inequality, a vector is at least ``|d(vector, pivot) - d(centroid, pivot)|`` away from a
centroid; the largest of these differences over the pivots is its lower bound. In every round a
vector meets the centroid of the smallest bound first; another one gets an exact integer distance only
if its bound does not exceed the best distance so far. Centroids and pivots are few numbers on the
driver; sums are made in tasks and added by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomesh.session import durable

LIMIT = 1 << 27  # components beyond are cut off there, so that a squared distance fits into a long
SLACK = 1e-9


def integer_vector(column: Column, scale: int, size: int) -> Column:
    """floor(scale * x) of every component; null unless there are ``size``, all finite."""
    value = column.cast("array<double>")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    cut = lambda x: F.least(F.greatest(F.lit(float(scale)) * x, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))
    return F.when((F.size(value) == size) & ~bad, F.transform(value, lambda x: F.floor(cut(x)).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _squares(vectors: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows to one vector."""
    apart = vectors - other
    return np.einsum("ij,ij->i", apart, apart)


def far_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the rows, each the farthest from those before it; the first is row 0."""
    chosen = [0]
    near = _squares(vectors, vectors[0])
    while len(chosen) < min(n, len(vectors)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _squares(vectors, vectors[chosen[-1]]))
    return vectors[chosen]


def nearest(vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each row (ties: the smaller number), and how
    many exact distances that took. ``table``: the rows' distances to the pivots."""
    to_pivots = np.sqrt(np.stack([_squares(centroids, p) for p in pivots], 1).astype(float))
    bound = np.zeros((len(vectors), len(centroids)))
    for p in range(len(pivots)):
        reach = table[:, p, None] + to_pivots[None, :, p]
        np.maximum(bound, np.abs(table[:, p, None] - to_pivots[None, :, p]) - SLACK * (reach + 1), out=bound)
    label = bound.argmin(1)
    best = _squares(vectors, centroids[label])
    first, visited = label.copy(), len(vectors)
    for c in range(len(centroids)):
        rows = np.flatnonzero((first != c) & (bound[:, c] <= np.sqrt(best.astype(float)) * (1 + SLACK)))
        if not len(rows):
            continue
        visited += len(rows)
        d = _squares(vectors[rows], centroids[c])
        better = (d < best[rows]) | ((d == best[rows]) & (c < label[rows]))
        best[rows[better]], label[rows[better]] = d[better], c
    return label, best, visited


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors`` (vec_id, vector) with their distances to the pivots; written once, read in every round."""
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1), width)
            table = np.sqrt(np.stack([_squares(rows, p) for p in pivots], 1).astype(float)) if len(rows) else np.zeros((0, len(pivots)))
            offsets = pa.array(np.arange(len(rows) + 1) * len(pivots), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(table.ravel()))], ["vec_id", "vector", "to_pivots"])

    return durable(vectors.select("vec_id", "vector").mapInArrow(run, "vec_id bigint, vector array<bigint>, to_pivots array<double>"))


def assign(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every stored vector."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, best, _ = nearest(_matrix(batch.column(1), width), _matrix(batch.column(2), len(pivots)), centroids, pivots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])

    return stored.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def _sums(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> tuple[dict[int, list[int]], dict[int, int]]:
    """Componentwise sums and sizes of the clusters: k rows a task, k rows to the driver."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)  # exact for 2 ** 36 rows a task
        for batch in batches:
            rows = _matrix(batch.column(1), width)
            label, _, _ = nearest(rows, _matrix(batch.column(2), len(pivots)), centroids, pivots)
            order = np.argsort(label, kind="stable")
            held, first = np.unique(label[order], return_index=True)
            if len(held):
                total[held] += np.add.reduceat(rows[order], first, axis=0)
                count[held] += np.diff(np.r_[first, len(rows)])
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = stored.mapInArrow(run, "cluster int, n bigint, total array<bigint>")
    each = [F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(width)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*each).alias("total")).collect()
    return {r.cluster: [int(Decimal(x)) for x in r.total] for r in rows}, {r.cluster: r.n for r in rows}


def cluster(
    table: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, size: int = 64, vector: str = "embedding", seed: int = 3, n_pivots: int = 16, sample: int = 256
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) per row that takes part, and the centroids.

    Rows whose ``vector`` is null, has not ``size`` components, or a null or non-finite one take no part.
    The first centroids are the ``k`` rows with the smallest SHA-256 of ``seed:vec_id`` (null ids last, ties by
    the vector), all rows if fewer; ids may repeat, every row counts. ``rounds`` times, every row joins its
    nearest centroid and a centroid with rows becomes the floor of their mean; rounds that would change
    nothing are not run. Components beyond 2 ** 27 after scaling count as that. Pivots come from
    the ``sample`` rows of smallest hash. No rows: an empty table and no centroids.
    """
    own = table.select(F.col("vec_id").cast("long").alias("vec_id"), integer_vector(F.col(vector), scale, size).alias("vector")).filter("vector is not null")
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    drawn = own.orderBy(first.asc_nulls_last(), F.col("vector")).limit(max(sample, k)).collect()
    if not drawn:
        return own.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, size), np.int64)
    sampled = np.array([r.vector for r in drawn], np.int64)
    pivots, centroids = far_pivots(sampled, n_pivots), sampled[:k]
    stored = pivot_table(own, pivots)
    for _ in range(rounds):
        totals, counts = _sums(stored, centroids, pivots)
        moved = centroids.copy()
        for c, total in totals.items():
            moved[c] = [x // counts[c] for x in total]
        if (moved == centroids).all():
            break
        centroids = moved
    return assign(stored, centroids, pivots), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia (at most 2 ** 63 - 1) and centroid_sha256 (of the components as text)."""
    assigned = durable(assigned)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row per cluster
    per, most = {r.cluster: int(r.s) for r in sums}, 2**63 - 1
    total = min(most, sum(per.values()))
    rows = [(c, min(most, s), total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in per.items()]
    known = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
