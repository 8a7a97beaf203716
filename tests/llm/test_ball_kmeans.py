"""Operator 11 against k-means in plain Python, on small tables with ties, repeated and unusable rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvasir.llm import ball_kmeans as B


def brute(rows, k, rounds, dims, scale, salt="3"):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-B.MOST, min(B.MOST, math.floor(scale * x))) for x in v]))
    named = [r for r in kept if r[0] is not None]
    centroids = [x for _, _, x in sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), n, x) for n, (i, x) in enumerate(named))[:k]]
    if not centroids:
        return []
    for step in range(rounds + 1):
        found = [min((B.square(x, c), j) for j, c in enumerate(centroids)) for _, x in kept]
        if step < rounds:
            for j in range(len(centroids)):
                mine = [x for (_, x), (_, c) in zip(kept, found, strict=True) if c == j]
                if mine:
                    centroids[j] = [sum(d) // len(mine) for d in zip(*mine, strict=True)]
    total = sum(d for d, _ in found)
    own = {j: sum(d for d, c in found if c == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, own[c], total, sha[c]) for (i, _), (d, c) in zip(kept, found, strict=True)]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("id", F.lit(1)).repartition(3)
    return sorted(map(repr, map(tuple, B.ball_kmeans(df, **kw).collect())))


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_kmeans(spark, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, 4)) * (seed + 1)
    rows = [(n, [float(x) for x in (middle[n % 5] + rng.normal(size=4) * 0.4).round(1 if seed else 6)]) for n in range(300)]
    assert run(spark, rows, k=6, rounds=4, dims=4, scale=8) == sorted(map(repr, brute(rows, 6, 4, 4, 8)))


def test_ties_repeats_and_rows_that_do_not_count(spark):
    grid = [(n, [float(n % 3), float(n % 4)]) for n in range(60)]
    odd = [(100, None), (101, [1.0]), (102, [None, 1.0]), (103, [float("nan"), 1.0]), (104, [float("inf"), 1.0]), (None, [1.0, 2.0]), (5, [2.0, 1.0]), (5, [2.0, 1.0]), (105, [1e300, -1e300])]
    rows = grid + odd
    assert run(spark, rows, k=8, rounds=3, dims=2, scale=1) == sorted(map(repr, brute(rows, 8, 3, 2, 1)))


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5, 0.5]), (2, [-0.5, 0.25])]
    assert run(spark, rows, dims=2) == sorted(map(repr, brute(rows, 8, 10, 2, 1024)))
    assert run(spark, [], dims=2) == [] and run(spark, [(1, None)], dims=2) == []


def test_balls_leave_most_distances_out():
    """Far apart clusters are all core: one distance a vector, whatever k; and neighbours end at twice the radius."""
    rng = np.random.default_rng(1)
    centroids = (rng.permutation(64)[:, None] * np.array([1000, 0, 0])).astype(np.int64)
    own = np.repeat(np.arange(64, dtype=np.int32), 50)
    x = centroids[own] + rng.integers(-20, 21, (len(own), 3))
    near = B.neighbours(centroids.tolist(), [40] * 64)
    assert all(not n for n in near)
    cluster, _, taken = B.nearest(x, own, centroids, near)
    assert (cluster == own).all() and taken == len(x)
    _, _, taken = B.nearest(x, own, centroids, B.neighbours(centroids.tolist(), [None] * 64))
    assert taken == len(x)  # the core is seen without radii too


def test_a_moved_ball_holds_its_members():
    rng = np.random.default_rng(2)
    for _ in range(200):
        members, old = rng.integers(-50, 50, (9, 4)), rng.integers(-50, 50, 4)
        new = members.sum(axis=0) // 9
        radius = B.moved_radius(max(B.square(m.tolist(), old.tolist()) for m in members), B.square(old.tolist(), new.tolist()))
        assert all(B.square(m.tolist(), new.tolist()) <= radius**2 for m in members)
