"""Vector search, string similarity joins and overlap counts: equal to comparing all, and what their plans do."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvasir.operators import cells, relational, vectors

D = "/root/testdata/sf0.01"


def clustered(n, dims=16, middles=20, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(middles, dims))
    return [(i, [float(x) for x in centre[i % middles] + rng.normal(size=dims) * 0.15]) for i in range(n)]


def plain_knn(queries, rows, k):
    ids, y = [i for i, _ in rows], np.array([v for _, v in rows])
    sim = vectors.similarities(np.array([v for _, v in queries]), y)
    return {(q, i, float(s)) for (q, _), line in zip(queries, sim, strict=True) for s, i in sorted(zip(line, ids, strict=True), key=lambda t: (-t[0], t[1]))[:k]}


def got(df):
    return {(r["q_id"], r["id"], r["similarity"]) for r in df.collect()}


def frames(spark, queries, rows):
    return spark.createDataFrame(queries, "q_id long, v array<double>"), spark.createDataFrame(rows, "id long, v array<double>").repartition(5)


def test_exact_search_in_place_and_in_blocks(spark, monkeypatch):
    rows = clustered(900) + [(900, [0.0] * 16), (901, [0.0] * 16)] + [(1000 + i, v) for i, v in clustered(30)]  # ties
    queries = rows[:40] + [(5000, [0.0] * 16)]
    q, x = frames(spark, queries, rows)
    expected = plain_knn(queries, rows, 7)
    plan = vectors.knn(q, x, 7)
    assert got(plan) == expected
    assert "CartesianProduct" not in plan._jdf.queryExecution().toString() and "NestedLoop" not in plan._jdf.queryExecution().toString()
    monkeypatch.setattr(vectors, "QUERY_VALUES", 10)
    assert got(vectors.knn(q, x, 7, block=8)) == expected
    assert vectors.knn(q.limit(0), x, 3).count() == 0 and vectors.knn(q, x.limit(0), 3).count() == 0


def test_string_ids_and_null_vectors(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("none", None)], "q_id string, v array<float>")
    x = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", None)], "id string, v array<float>")
    assert [(r["q_id"], r["id"], r["rank"]) for r in sorted(vectors.knn(q, x, 5).collect(), key=lambda r: r["rank"])] == [("q", "a", 1), ("q", "b", 2)]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = clustered(3000) + [(9000, [0.0] * 16), (9001, [1.0] * 3), (9002, None)]
    path = str(tmp_path_factory.mktemp("cells"))
    return rows, cells.build(spark.createDataFrame(rows, "id long, v array<double>"), path, cells=40, rows_per_file=40), path


def test_index_reads_few_cells_with_the_audited_recall(spark, built):
    rows, index, path = built
    rows = [r for r in rows if r[1] is not None and len(r[1]) == 16]
    assert index.rows(spark).count() == len(rows) and index.sizes.sum() + index.zeros == len(rows)
    queries = [r for r in rows if r[0] % 50 == 0]
    q, _ = frames(spark, queries, rows[:1])
    exact = spark.createDataFrame(list(plain_knn(queries, rows, 10)), "q_id long, id long, similarity double")
    found = cells.search(index, q, 10)
    recall = cells.recall_of(found, exact).agg(F.avg("recall")).first()[0]
    assert index.recall >= 0.95 and recall >= 0.9 and index.probes <= 10
    one = cells.search(index, q.limit(1), 10)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell#" in plan and "IN (" in plan and "CartesianProduct" not in plan
    assert cells.CellIndex.open(spark, path).probes == index.probes


def test_exact_index_equals_comparing_all(spark, built, monkeypatch):
    rows, index, _ = built
    rows = [r for r in rows if r[1] is not None and len(r[1]) == 16]
    queries = [r for r in rows if r[0] % 100 == 0] + [(77, [0.0] * 16), (78, [float(x) for x in range(16)])]
    q, _ = frames(spark, queries, rows[:1])
    expected = plain_knn(queries, rows, 10)
    assert got(cells.search(index, q, 10, exact=True)) == expected
    # The bound leaves most cells of clustered vectors unread.
    x = np.array([v for _, v in queries[:20]])
    sim = np.sort(vectors.similarities(x, np.array([v for _, v in rows])), axis=1)[:, -10]
    assert (cells.bounds(index, x) >= sim[:, None]).mean() < 0.3
    all_cells = len(index.centroids)
    monkeypatch.setattr(vectors, "QUERY_VALUES", 10)
    assert got(cells.search(index, q, 10, probes=all_cells)) == expected


def test_empty_index(spark, tmp_path):
    index = cells.build(spark.createDataFrame([], "id long, v array<double>"), str(tmp_path))
    q = spark.createDataFrame([(1, [1.0])], "q_id long, v array<double>")
    assert cells.search(index, q, 3).count() == 0


def plain_dice(a, b):
    a, b = ("".join(x.lower().split()) for x in (a, b))
    if a == b:
        return 1.0
    ga, gb = (Counter(x[i : i + 2] for i in range(len(x) - 1)) for x in (a, b))
    n = ga.total() + gb.total()
    return 2 * (ga & gb).total() / n if ga and gb else 0.0


def names(n, seed=4):
    """A hundred times a small vocabulary's names, with small edits; all have common endings."""
    rng = random.Random(seed)
    part = ["node", "edge", "graph", "table", "index", "query", "cache", "token", "stream", "vector", "merge", "split"]
    out = set()
    while len(out) < n:
        name = f"{rng.choice(part)} {rng.choice(part)}{rng.randrange(10**6)} service"
        if rng.random() < 0.2 and out:
            name = rng.choice(sorted(out)[:200])
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice("abcxyz") + name[at + 1 :]
        out.add(name)
    return sorted(out)


@pytest.mark.parametrize("least", [0.3, 0.7, 0.85])
def test_string_join_equals_all_pairs(spark, least):
    table = names(60) + ["aaaa", "aaa", "aa", "a", "A A", "Node  Edge", "nodeedge", ""]
    df = spark.createDataFrame([(n,) for n in table], "n string")
    found = {(r["a"], r["b"]): r["dice"] for r in relational.dice_join(df, df, "n", "n", least).collect()}
    expected = {(a, b): plain_dice(a, b) for a, b in itertools.product(table, table) if plain_dice(a, b) >= least}
    assert found.keys() == expected.keys() and all(found[p] == pytest.approx(expected[p]) for p in expected)
    pairs = df.crossJoin(df.withColumnRenamed("n", "m"))
    assert all(r["d"] == pytest.approx(plain_dice(r["n"], r["m"])) for r in pairs.select("n", "m", relational.dice(F.col("n"), F.col("m")).alias("d")).collect())


def test_string_join_has_few_candidates(spark):
    """Of 3,000 names of the same few words, one in 30 of all pairs is compared at most, and 150 a result."""
    df = spark.createDataFrame([(n,) for n in names(3000)], "n string")
    sets = relational.gram_sets(df.select(relational.cleaned(F.col("n")).alias("clean")))
    compared = relational.dice_candidates(sets, 0.85).count()
    results = relational.dice_join(df, df, "n", "n", 0.85).where("a < b").count()
    assert results > 100 and compared <= 150 * results and compared <= 3000 * 2999 / 2 / 30


SCORES = {"jaccard": (relational.jaccard, lambda j, k, m: j / (k + m - j)), "overlap": (relational.overlap_coefficient, lambda j, k, m: j / min(k, m)), "shared": (lambda s, x, y: s.cast("double"), lambda j, k, m: j)}


@pytest.mark.parametrize("kind,least,need", [("jaccard", 0.6, lambda k: F.ceil(k * 0.6)), ("overlap", 0.5, None), ("shared", 1.0, None), ("jaccard", 0.2, None)])
def test_overlap_counts_equal_all_pairs(spark, kind, least, need):
    """Sets of up to 14 items, so that some are counted and some are joined, with copies, empty and null ones."""
    rng = random.Random(7)
    sets = [(i, rng.sample("abcdefghijklmnopqrst", rng.choice([1, 2, 3, 4, 9, 10, 11, 14]))) for i in range(120)]
    sets += [(200 + i, sets[i][1]) for i in range(30)] + [(300, []), (301, None), (302, []), (303, ["a", "a", "b"])]
    df = spark.createDataFrame(sets, "k long, s array<string>")
    score, plain = SCORES[kind]
    extra = {"shared_least": need} if need else {}
    out = {r["k"]: (r["n_links"], r["best"]) for r in relational.overlap_links(df, "k", "s", score, least, **extra).collect()}
    for i, s in sets:
        mine, found = {*(s or [])}, []
        for j, t in sets:
            other = {*(t or [])}
            if i != j and mine & other and plain(len(mine & other), len(mine), len(other)) >= least:
                found.append(plain(len(mine & other), len(mine), len(other)))
        assert out[i] == (len(found), pytest.approx(max(found)) if found else None), i


def test_a_hot_item_makes_no_pairs(spark):
    """An item that all of 4,000 different sets hold: rows stay within the sets' subsets."""
    df = spark.range(4000).select(F.col("id").alias("k"), F.array(F.lit("hot"), F.concat(F.lit("x"), F.col("id").cast("string"))).alias("s"))
    out = relational.overlap_links(df, "k", "s", relational.jaccard, 0.3)
    assert out.where("n_links = 3999").count() == 4000
    classes = df.select(F.col("k").alias("class_id"), F.lit(1).cast("long").alias("n"), F.array_sort("s").alias("items"))
    parts = classes.select(F.explode(relational._subsets("items")).alias("part"), F.size("items").alias("m"))
    counts = parts.groupBy("part", "m").count()
    assert parts.join(counts, "part").count() == 3 * 4000
    assert relational._links_by_prefix(classes, relational.jaccard, 0.3, lambda k: F.lit(1)).count() == 0
