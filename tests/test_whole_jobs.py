"""Queries that had been narrowed, and steps that had been slow or large: the whole job, by comparing plainly."""

import itertools
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kvasir.operators import chunking, relational, vectors
from kvasir.sources import adapters

D = "/root/testdata/sf0.001"


def run(spark, name):
    return entry.queries()[name](spark, D)


def test_pseudo_levenshtein_takes_all_pairs_of_names(spark):
    names = {r[0] for r in spark.read.parquet(f"{D}/part.parquet").select("p_name").collect()}
    pieces = {n: "".join(n.lower().split()) for n in names}
    grams = {n: {c[i : i + 2] for i in range(len(c) - 1)} for n, c in pieces.items()}
    wanted = {(x, y) for x, y in itertools.combinations(sorted(names), 2) if grams[x] & grams[y]}
    assert {(r["a"], r["b"]) for r in run(spark, "pseudo_levenshtein").collect()} == wanted


def test_detect_semantic_links_from_its_first_threshold(spark):
    """A row for each pair of a query and another vector of confidence .6 or more, 50 a query at most."""
    sim = lambda x, y: round((sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5 + 1) / 2, 6)
    rows = {r["vec_id"]: [float(v) for v in r["embedding"]] for r in spark.read.parquet(f"{D}/embeddings.parquet").select("vec_id", "embedding").collect()}
    wanted = 0
    for q in rows:
        if q % 50 == 0:
            wanted += min(50, sum(i != q and sim(rows[q], rows[i]) >= 0.6 for i in rows))
    assert run(spark, "detect_semantic").count() == wanted > 0


def test_detect_semantic_takes_every_vector_as_a_source(spark, monkeypatch):
    """The pairs of all vectors by comparing plainly; the same where vectors stream past blocks of sources."""
    found = spark.read.parquet(f"{D}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in found]), np.array([r["embedding"] for r in found], dtype=np.float64)
    sim = vectors.similarities(x, x)
    wanted = set()
    for i, row in zip(ids.tolist(), sim, strict=True):
        near = sorted((-s, j) for s, j in zip(row.tolist(), ids.tolist(), strict=True) if j != i and s >= 0.6)[:50]
        wanted |= {(i, j, -s) for s, j in near}
    got = lambda: sorted((r["source_id"], r["target_id"]) for r in run(spark, "detect_semantic").collect())
    assert len({i for i, _, _ in wanted if i % 50}) > 0
    assert got() == sorted((i, j) for i, j, _ in wanted)
    monkeypatch.setattr(vectors, "QUERY_VALUES", 10)
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 100)
    assert got() == sorted((i, j) for i, j, _ in wanted)


def test_documented_pairs_come_once_and_are_not_grouped(spark, monkeypatch):
    """Repeated memories and nodes, null paths, one large path in many groups; the same as grouping all pairs."""
    monkeypatch.setattr(relational, "PAIRS_A_GROUP", 50)
    refs = [(f"m{i}", f"n{i % 9}", None if i % 11 == 0 else f"f{i % 3}") for i in range(60)] + [("m1", "n1", "f1"), ("m1", "n2", "f2"), ("m2", None, "f0")]
    nodes = [(f"p{i}", f"n{i % 13}", "module" if i % 4 == 0 else "class", f"f{i % 3}") for i in range(50)] + [("p1", "n1", "class", "f1"), ("p1", "n9", "class", "f2"), ("p7", "n1", "class", None)]
    wanted: dict = {}
    for m, name, path in refs:
        named = min((i for i, n, _, _ in nodes if n == name), default=None)
        for i, _, kind, at in nodes:
            if path is not None and path == at and kind != "module":
                wanted[m, i] = max(wanted.get((m, i), 0), 0.75)
        if named:
            wanted[m, named] = 0.9
    df = relational.documented(spark.createDataFrame(refs, "memory_id string, name string, file_path string"), spark.createDataFrame(nodes, "id string, name string, type string, file_path string"))
    assert sorted((r["memory_id"], r["node_id"], r["confidence"]) for r in df.collect()) == sorted((m, i, c) for (m, i), c in wanted.items())


def test_documented_pairs_are_made_after_their_join(spark, monkeypatch):
    """One path of many memories and nodes: what is sent to the join grows with both, not with a path's pairs; each pair comes once."""
    monkeypatch.setattr(relational, "PAIRS_A_GROUP", 3000)
    monkeypatch.setattr(relational, "NODES_A_ROW", 70)
    refs = spark.range(400).select(F.concat(F.lit("m"), "id").alias("memory_id"), F.lit("n3").alias("name"), F.lit("f").alias("file_path"))
    nodes = spark.range(300).select(F.concat(F.lit("p"), "id").alias("id"), F.concat(F.lit("n"), "id").alias("name"), F.lit("class").alias("type"), F.lit("f").alias("file_path"))
    df = relational.documented(refs, nodes)
    rows = df.collect()
    assert len(rows) == len({(r["memory_id"], r["node_id"]) for r in rows}) == 400 * 300
    assert {r["memory_id"] for r in rows if r["confidence"] == 0.9 and r["node_id"] == "p3"} == {f"m{i}" for i in range(400)}
    assert sum(r["confidence"] == 0.9 for r in rows) == 400
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join")]
    assert "Generate explode(node_ids" in top and plan.count("explode(node_ids") == 1  # no second pass where each memory is given once


def test_dice_counts_bigrams_as_often_as_they_come(spark):
    names = ["aaaa", "aaa b", "AAAAB", "abab ab", "bababa", "a", "", "night", "nacht", None]
    rows = [(x, y) for x in names for y in names]

    def plain(x, y):
        if x is None or y is None:
            return None
        x, y = "".join(x.lower().split()), "".join(y.lower().split())
        g, h = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (x, y))
        return 1.0 if x == y else 0.0 if not g or not h else 2.0 * (g & h).total() / (g.total() + h.total())

    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", relational.dice(F.col("a"), F.col("b")).alias("d"))
    assert sorted((str(r["a"]), str(r["b"]), str(r["d"])) for r in df.collect()) == sorted((str(x), str(y), str(plain(x, y))) for x, y in rows)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 4  # each name is cleaned once


def test_ranges_are_cut_by_as_many_halvings_as_their_end_has_digits(spark):
    ranges = [(0, f"s{i}", i * 7 % 40, i * 7 % 40 + i % 25) for i in range(300)] + [(0, "far", 0, 2**39 - 1)]
    occ = [(0, i, i) for i in range(80)]
    df = chunking.innermost(spark.createDataFrame(occ, "doc long, occ long, line long"), spark.createDataFrame(ranges, "doc long, symbol string, begin long, end long"))
    wanted = [(i, min((e - b, s) for _, s, b, e in ranges if b <= i <= e)[1]) for _, i, _ in occ]
    assert sorted((r["occ"], r["symbol"]) for r in df.collect()) == wanted
    steps = spark.range(1).select(F.size(chunking.dyadic(F.lit(0), F.lit(100))).alias("n"), F.length(F.bin(F.lit(101))).alias("digits")).first()
    assert steps["n"] <= 2 * steps["digits"]


def test_edges_are_dealt_out_by_their_lines_and_made_distinct_as_numbers(spark, monkeypatch):
    once = sorted(map(tuple, adapters.code_edges(spark, D).collect()))
    monkeypatch.setattr(adapters, "LINES_A_TASK", 100)
    df = adapters.code_edges(spark, D)
    lines = spark.read.parquet(f"{D}/lineitem.parquet").count()
    assert sorted(map(tuple, df.collect())) == once and len(set(once)) == len(once)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert f", {1 + lines // 100}), REPARTITION_BY_NUM" in plan
    assert "concat(" not in plan[plan.rindex("HashAggregate(") :]  # names are made after the duplicates are gone


def test_cooccurring_pairs_are_counted_in_tasks_by_their_lines(spark, monkeypatch):
    """The same first pairs as by counting plainly, whose names' order isn't that of the numbers (e10 before e9)."""
    monkeypatch.setattr(adapters, "LINES_A_TASK", 1000)
    rows = spark.read.parquet(f"{D}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    orders: dict = {}
    for r in rows:
        orders.setdefault(r["l_orderkey"], set()).add(f"e{r['l_partkey']}")
    count = Counter(p for es in orders.values() if 2 <= len(es) <= 8 for p in itertools.combinations(sorted(es), 2))
    wanted = sorted(((a, b, c) for (a, b), c in count.items()), key=lambda p: (-p[2], p[0], p[1]))[:64]
    df = run(spark, "cooccurrence")
    assert [(r["a"], r["b"], r["strength"]) for r in df.collect()] == [(a, b, min(10, 2 + c)) for a, b, c in wanted]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert all(f", {1 + n // 1000}), REPARTITION_BY_NUM" in plan for n in (len(rows), 4 * len(rows)))
