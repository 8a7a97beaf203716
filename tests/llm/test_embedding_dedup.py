"""Operator 8 against brute force."""

import numpy as np

from kvasir.llm import embedding_dedup
from kvasir.llm.balls import Ball, link
from kvasir.llm.hnsw import Graph


def planted(n, d, groups, seed=1):
    """Random vectors with groups of near copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    at = 0
    for size, noise in groups:
        x[at : at + size] = rng.normal(size=d) + noise * rng.normal(size=(size, d))
        at += size
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_graph_recall_and_large_groups():
    x = planted(3000, 64, [(400, 0.05), (30, 0.2), (30, 0.25), (2, 0.1), (2, 0.1)])
    order = np.random.default_rng(0).permutation(len(x))
    g = Graph.build(x[order])
    assert g.audit(0.95, 0.995) >= 0.995
    again = Graph.load(g.dump(), x[order])
    got = again.within(x[order], np.full(len(x), 0.95, np.float32))
    truth = [np.flatnonzero(r >= 0.95) for r in x[order] @ x[order].T]
    assert sum(len(np.intersect1d(a, b)) for a, b in zip(truth, got, strict=True)) >= 0.99 * sum(map(len, truth))


def test_a_graph_that_has_fallen_apart_compares_all():
    x = planted(600, 16, [(2, 0.01)] * 100)
    g = Graph(x, [np.full((len(x), 24), -1)])
    assert g.audit(0.95, 0.995) == 1.0 and g.ef == 0


def test_links_of_balls_equal_brute_force():
    """Balls from tight to loose, apart and overlapping, with weights: counts, and what is joined."""
    rng = np.random.default_rng(4)
    for trial in range(60):
        centre, noise = rng.normal(size=24), rng.choice([0.01, 0.05, 0.1])
        balls, start = [], 0
        for size in rng.choice([1, 2, 40], 2):
            v = centre + rng.choice([0.0, 0.15, 0.3]) * rng.normal(size=24) + noise * rng.normal(size=(size, 24))
            balls.append((v / np.linalg.norm(v, axis=1, keepdims=True), np.arange(start, start + size), rng.integers(1, 4, size)))
            start += size
        if trial % 3 == 0:
            balls[1] = balls[0]
        a, b = (Ball(*x) for x in balls)
        weight, edges = link(a, b, 0.95)
        near = (a.exact @ b.exact.T >= 0.95) & (a.reps[:, None] != b.reps[None, :])
        assert (weight == near @ b.sizes).all()
        known = {(int(x), int(y)) for x, y in zip(*np.nonzero(a.exact @ b.exact.T >= 0.95), strict=True)}
        pairs = [(int(a.reps[i]), int(b.reps[j])) for i, j in known if a.reps[i] != b.reps[j]]
        ids = sorted({*a.reps.tolist(), *b.reps.tolist()})
        assert parts(ids, pairs) == parts(ids, edges)


def parts(ids, edges):
    of = {i: i for i in ids}
    for _ in ids:
        for x, y in edges:
            of[x] = of[y] = min(of[x], of[y])
    return of


def brute(x, ids):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    comp = ids.copy()
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], 2**60).min(axis=1))
        if (new == comp).all():
            return link.sum(axis=1), comp
        comp = new


def test_table_equals_brute_force(spark):
    x = planted(700, 32, [(60, 0.05), (12, 0.15), (12, 0.18), (2, 0.1), (3, 0.02)])
    x[650:660] = x[0]  # exact copies
    x[660] = x[5] * 3
    ids = np.arange(1000, 1000 + len(x))
    n, comp = brute(x, ids)
    odd = [(1, None), (2, [0.0] * 32), (3, [None] * 32), (4, [float("nan")] * 32), (5, [float("inf")] * 32), (6, [1.0, 2.0]), (7, []), (None, [1.0] * 32)]
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "vec_id AS id", "vec_id AS rep", "0 AS shard", "vec_id AS v")
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, min_shards=3).collect()}
    assert len(out) == len(rows)
    assert all(out[i] == (0, i, True) for i, _ in odd)
    good = sum(out[int(i)] == (int(a), int(c), bool(i == c)) for i, a, c in zip(ids, n, comp, strict=True))
    assert good == len(ids)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_query_recall_on_the_table(spark):
    from kvasir.llm.queries import op8_hnsw_near_dedup

    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows]), np.array([r["vec_id"] for r in rows])
    n, comp = brute(x, ids)
    out = {r["vec_id"]: r for r in op8_hnsw_near_dedup(spark, d).collect()}
    assert sum(out[int(i)]["n_links"] for i in ids) >= 0.99 * n.sum()
    assert np.mean([out[int(i)]["component_id"] == c for i, c in zip(ids, comp, strict=True)]) >= 0.99
