"""Clusters of integer vectors around centroids, most distances ruled out by a filter in rotated coordinates.

Vectors are scaled to integers, so distances, sums and their floors are exact and reruns agree. The rotation is that of the
principal components of all vectors. Each vector is stored with its leading rotated coordinates and the norm of the rest;
the squared distance of the leading coordinates plus the squared difference of the two norms can't exceed the squared
distance. The centroid with the least bound is measured first, in integers; so is every other whose bound, less a margin for
rounding, doesn't exceed that. The rotation only decides what is measured, never the result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.llm.common import stored
from pagegauge.llm.vectors import finite_rows, packed, unpacked

CLUSTERS = 16
ROUNDS = 3
LENGTH = 64
SCALE = 64
LEAD = 16
_PIECE = 4096


def _whole(matrix: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers whose squared distances fit into 62 bits."""
    values = np.floor(scale * matrix)
    limit = math.isqrt((1 << 62) // matrix.shape[1]) // 2
    if len(values) and np.abs(values).max() > limit:
        raise ValueError(f"components beyond {limit / scale:g} have squared distances that are no longs")
    return values.astype(np.int64)


def _moments(vectors: DataFrame, length: int, scale: int) -> np.ndarray:
    """Sums of products of the components of all vectors and of 1: a (length + 1) square. Summed in the tasks, then by row."""

    def run(batches):
        total = np.zeros((length + 1, length + 1))
        for batch in batches:
            for _, matrix in finite_rows(batch["embedding"], length):
                values = np.hstack([_whole(matrix, scale).astype(np.float64), np.ones((len(matrix), 1))])
                total += values.T @ values
        if total[-1, -1]:
            sums = pa.ListArray.from_arrays(np.arange(0, total.size + 1, length + 1, dtype=np.int32), total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(length + 1)), sums], ["i", "s"])

    rows = vectors.select("embedding").mapInArrow(run, "i bigint, s array<double>")
    sums = rows.groupBy("i").agg(F.array(*(F.sum(F.col("s")[j]) for j in range(length + 1))).alias("s")).collect()
    total = np.zeros((length + 1, length + 1))
    for row in sums:
        total[row.i] = row.s
    return total


class Rotation:
    """Leading principal coordinates around the mean, and the norm of what they leave."""

    def __init__(self, moments: np.ndarray, lead: int):
        n = moments[-1, -1]
        self.mean = moments[-1, :-1] / n
        _, axes = np.linalg.eigh(moments[:-1, :-1] / n - np.outer(self.mean, self.mean))
        self.axes = axes[:, ::-1][:, :lead].copy()

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        moved = values - self.mean
        front = moved @ self.axes
        return front, np.linalg.norm(moved - front @ self.axes.T, axis=1)


def nearest(values: np.ndarray, front: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (ties: the smallest), its squared distance, and how many distances were measured."""
    centre_front, centre_rest = rotation(centroids)
    clusters, distances, measured = [], [], 0
    for at in range(0, len(values), _PIECE):
        part, f, r = values[at : at + _PIECE], front[at : at + _PIECE], rest[at : at + _PIECE]
        bound = (r[:, None] - centre_rest) ** 2
        for j in range(f.shape[1]):
            bound += (f[:, j : j + 1] - centre_front[:, j]) ** 2
        every = np.arange(len(part))
        first = bound.argmin(axis=1)
        full = np.full(bound.shape, np.iinfo(np.int64).max)
        full[every, first] = ((part - centroids[first]) ** 2).sum(axis=1)
        size = (f**2).sum(axis=1) + r**2
        margin = 1e-9 * (1 + size[:, None] + (centre_front**2).sum(axis=1) + centre_rest**2)
        survives = bound - margin <= full[every, first][:, None]
        survives[every, first] = False
        row, centre = np.nonzero(survives)
        full[row, centre] = ((part[row] - centroids[centre]) ** 2).sum(axis=1)
        cluster = full.argmin(axis=1)
        clusters.append(cluster), distances.append(full[every, cluster])
        measured += len(part) + len(row)
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(clusters or none), np.concatenate(distances or none), measured


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpacked(batch["v"], np.int64), unpacked(batch["front"], np.float64), batch["rest"].to_numpy()


def _moved(table: DataFrame, centroids: np.ndarray, rotation: Rotation) -> np.ndarray:
    """The centroids after one round. Tasks add up their own vectors; one row per task and cluster is shuffled."""
    k, length = centroids.shape

    def run(batches):
        sums, counts = np.zeros((k, length), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            values, front, rest = _read(batch)
            if len(values):
                cluster, _, _ = nearest(values, front, rest, centroids, rotation)
                counts += np.bincount(cluster, minlength=k)
                for c in np.unique(cluster):
                    sums[c] += values[cluster == c].sum(axis=0)
        some = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(np.arange(0, len(some) * length + 1, length, dtype=np.int32), sums[some].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), lists], ["cluster", "n", "s"])

    wide = "decimal(38,0)"
    rows = table.select("v", "front", "rest").mapInArrow(run, "cluster bigint, n bigint, s array<bigint>")
    totals = rows.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[j].cast(wide)) for j in range(length))).alias("s"))
    out = centroids.copy()
    for row in totals.collect():
        # Whole numbers of any size: floor(sum / count).
        out[row.cluster] = [int(s) // row.n for s in row.s]
    return out


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, seed: str = "1", lead: int = LEAD
) -> DataFrame:
    """One row (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector of ``length`` finite components.

    Components x count as floor(scale * x). The first centroids are the vectors with the smallest hexadecimal SHA-256 of
    ``seed:vec_id``; in every round each vector goes to its nearest centroid (squared distance; ties: the smaller number) and
    each centroid that has vectors to the floor of their mean; then vectors are assigned once more. ``distance`` is
    squared, ``cluster_inertia`` and ``inertia`` its sums over the cluster and over all vectors, ``centroid_sha256`` the
    SHA-256 of the final centroid's components, joined by commas.

    Null vectors, those of another length and those with null or non-finite components have no row. Vectors without an id
    have a row and come last as first centroids; rows that share an id count each, and start in the order of their
    components; with fewer vectors than ``clusters`` there are fewer centroids. Components too large for a squared distance
    of 62 bits raise. Labels and other columns are ignored; an empty table gives no rows. What reaches the driver are
    (length + 1) squared sums and, each round, one row per centroid.
    """
    spark = vectors.sparkSession
    out = "vec_id bigint, cluster int, distance bigint"
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    moments = _moments(vectors, length, scale)
    if not moments[-1, -1]:
        return spark.createDataFrame([], out + ", cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    rotation = Rotation(moments, min(lead, length))

    def rotated(batches):
        for batch in batches:
            for rows, matrix in finite_rows(batch["embedding"], length):
                values = _whole(matrix, scale)
                front, rest = rotation(values)
                yield pa.RecordBatch.from_arrays([batch["vec_id"].take(pa.array(rows)), packed(values), packed(front), pa.array(rest)], ["vec_id", "v", "front", "rest"])

    table = stored(vectors.mapInArrow(rotated, "vec_id bigint, v binary, front binary, rest double"), "rotated")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = table.select("v", drawn.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()
    centroids = np.array([np.frombuffer(row.v, dtype=np.int64) for row in first])
    for _ in range(rounds):
        centroids = _moved(table, centroids, rotation)

    def assign(batches):
        for batch in batches:
            number, distance, _ = nearest(*_read(batch), centroids, rotation)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = stored(table.mapInArrow(assign, out), "assigned")
    sums = {row.cluster: int(row.s) for row in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per_cluster = spark.createDataFrame(
        [(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    # One row per centroid.
    return assigned.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
