"""Clusters against every distance measured in whole numbers."""

import hashlib

import numpy as np
import pytest

from pagegauge.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, distance string, v string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, clusters, rounds, length, scale=64):
    kept = [
        (i, [int(np.floor(scale * float(np.float32(x)))) for x in v])
        for i, v in rows if v is not None and len(v) == length and all(x is not None and np.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), np.array(r[1]).tobytes()))
    centres = [v for _, v in order[:clusters]]

    def assign():
        distances = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres] for _, v in kept]
        return [(min(range(len(d)), key=lambda j: (d[j], j)), min(d)) for d in distances]

    for _ in range(rounds):
        of = assign()
        for c in range(len(centres)):
            own = [v for (_, v), (number, _) in zip(kept, of) if number == c]
            if own:
                centres[c] = [sum(column) // len(own) for column in zip(*own)]
    of = assign()
    out = []
    for (i, _), (c, d) in zip(kept, of):
        digest = hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
        out.append((i, c, d, sum(e for n, e in of if n == c), sum(e for _, e in of), digest))
    return out


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_clusters_against_every_distance(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(5, 8))
    rows = [(i, (middles[i % 5] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(400)]
    # Ties, copies, a repeated id, no id, and everything that is left out.
    rows += [(400 + i, [0.0] * 8) for i in range(30)] + [(7, rows[7][1]), (None, [0.5] * 8), (None, [1.5] * 8)]
    rows += [(500, None), (501, []), (502, [1.0] * 7), (503, [1.0] * 7 + [None]), (504, [float("nan")] * 8), (505, [float("inf")] + [0.0] * 7)]
    for clusters, lead in ((6, 3), (16, 8), (3, 1)):
        same(centroids.cluster(table(spark, rows), clusters, 3, 8, lead=lead).collect(), plain(rows, clusters, 3, 8))


def test_fewer_vectors_than_clusters_one_vector_and_none(spark):
    rows = [(i, [float(i), -1.0, 0.25]) for i in range(3)]
    same(centroids.cluster(table(spark, rows), 16, 2, 3).collect(), plain(rows, 16, 2, 3))
    same(centroids.cluster(table(spark, rows[:1]), 16, 2, 3).collect(), plain(rows[:1], 16, 2, 3))
    empty = centroids.cluster(table(spark, []), 16, 2, 3)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_beyond_long_distances_raise(spark):
    with pytest.raises(Exception, match="squared distances"):
        centroids.cluster(table(spark, [(1, [1e9, 0.0])]), 2, 1, 2).collect()


def test_bounds_never_exceed_distances_and_spare_most():
    rng = np.random.default_rng(9)
    spread = np.concatenate([np.full(6, 40.0), np.full(26, 2.0)])
    values = np.floor(spread * rng.normal(size=(3000, 32))).astype(np.int64)
    centres = values[:20]
    whole = np.hstack([values, np.ones((len(values), 1))])
    rotation = centroids.Rotation(whole.T @ whole, 8)
    number, distance, measured = centroids.nearest(values, *rotation(values), centres, rotation)
    every = ((values[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert measured < 0.2 * every.size


def test_given_vectors(spark, small):
    rows = [(r.vec_id, r.embedding) for r in small("embeddings").collect()]
    same(centroids.cluster(small("embeddings")).collect(), plain(rows, 16, 3, 64))
