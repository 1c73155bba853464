"""op11: ball trees and whole runs against plain k-means, ties, large components, odd rows."""

import hashlib
import math

import numpy as np
import pytest

from sheaf.llm import clusters


def plain(rows, config):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == config.dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [max(-clusters.LARGEST, min(clusters.LARGEST, math.floor(config.scale * x))) for x in v]))
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{config.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in start[: config.k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(config.rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for i, vs in groups.items():
            centroids[i] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    return sorted(((i, *reversed(nearest(v))) for i, v in kept), key=repr), centroids


def run(spark, rows, config):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS cluster", "1 AS distance", "2 AS v", "3 AS ids")
    found, centroids = clusters.cluster_vectors(frame.repartition(3), config)
    return sorted((tuple(r) for r in found.collect()), key=repr), centroids.tolist(), found


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_against_plain_k_means(spark, spread):
    rng = np.random.default_rng(5)
    config = clusters.ClusterConfig(k=7, dim=6, rounds=4, tree_rows=64, leaf_rows=4)
    middles = rng.normal(size=(9, 6))
    rows = [(i, (middles[i % 9] + rng.normal(size=6) * spread).tolist()) for i in range(400)]
    rows += [(400, rows[0][1]), (0, rows[0][1]), (None, rows[5][1]), (None, rows[5][1]), (401, None), (402, [1.0] * 5), (403, [1.0] * 5 + [None]), (404, [1.0] * 5 + [float("nan")]), (405, [float("inf")] * 6), (406, [])]
    got, centroids, found = run(spark, rows, config)
    assert (got, centroids) == plain(rows, config)
    told = clusters.described(found, np.array(centroids)).collect()
    assert {r.inertia for r in told} == {sum(d for _, _, d in got)} and len(told) == len(got)
    for r in told:
        assert r.cluster_inertia == sum(d for _, c, d in got if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_ties_copies_and_large_components(spark):
    config = clusters.ClusterConfig(k=5, dim=2, scale=1, rounds=3, tree_rows=16, leaf_rows=2)
    grid = [(i, [float(i % 4), float(i // 4 % 4)]) for i in range(96)]
    for rows in (grid, [(i, [1.0, 1.0]) for i in range(50)], grid + [(200 + i, [3e6 * (i % 5), -1e300 if i == 3 else 2e6]) for i in range(20)]):
        assert run(spark, rows, config)[:2] == plain(rows, config)


def test_fewer_vectors_than_centroids_and_none(spark):
    config = clusters.ClusterConfig(k=40, dim=2)
    assert run(spark, [(1, [0.5, -0.5]), (2, [0.1, 0.2])], config)[:2] == plain([(1, [0.5, -0.5]), (2, [0.1, 0.2])], config)
    got, centroids, found = run(spark, [(1, None)], config)
    assert got == [] and centroids == [] and clusters.described(found, np.zeros((0, 2), int)).count() == 0


def test_balls_reach_their_rows_and_are_taken_whole():
    rng = np.random.default_rng(2)
    middles = rng.integers(-4000, 4000, (6, 8))
    x = np.concatenate([m + rng.integers(-20, 20, (300, 8)) for m in middles])
    tree = clusters.BallTree.build(np.arange(len(x)), x, 16)
    for i in range(len(tree.start)):
        own = tree.x[tree.start[i] : tree.stop[i]]
        assert (tree.total[i] == own.sum(0)).all() and np.sqrt(((own - tree.centre[i]) ** 2).sum(1)).max() <= tree.radius[i] * (1 + 1e-9)
    balls, of_balls, rows, of_rows = tree.filter(middles)
    assert (tree.stop[balls] - tree.start[balls]).sum() + len(rows) == len(x)
    assert len(rows) < len(x) / 3  # most rows are taken with their ball
    want = clusters.squared_distances(tree.x, middles).argmin(1)
    for ball, centroid in zip(balls, of_balls, strict=True):
        assert (want[tree.start[ball] : tree.stop[ball]] == centroid).all()
    assert (want[rows] == of_rows).all()
