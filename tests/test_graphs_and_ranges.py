"""Leiden's communities and innermost ranges, held to what they promise and to brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvasir.operators import chunking, graph


def adjacency(spark, edges):
    return graph.adjacency(spark.createDataFrame(edges, "x string, y string, weight double"))


def planted(groups, size, inside, across, seed):
    rng = random.Random(seed)
    names = [[f"g{g:02d}n{i:02d}" for i in range(size)] for g in range(groups)]
    edges = []
    for a, b in itertools.combinations([n for g in names for n in g], 2):
        if rng.random() < (inside if a[:3] == b[:3] else across):
            edges.append((a, b, 1.0))
    return names, edges


def of(df):
    groups: dict[str, set[str]] = {}
    for r in df.collect():
        groups.setdefault(r["community"], set()).add(r["id"])
    return groups


def plain_modularity(edges, groups, resolution=1.0):
    where = {n: c for c, g in groups.items() for n in g}
    total = sum(w for _, _, w in edges)
    inside = sum(w for a, b, w in edges if where[a] == where[b]) / total
    degree = {c: 0.0 for c in groups}
    for a, b, w in edges:
        degree[where[a]] += w
        degree[where[b]] += w
    return inside - resolution * sum((k / (2 * total)) ** 2 for k in degree.values())


def connected(edges, group):
    group, seen = set(group), set()
    todo = [min(group)]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += [b if a == n else a for a, b, _ in edges if n in (a, b) and {a, b} <= group]
    return seen == group


def sequential(edges, resolution=1.0):
    """Local moving one node after another until none gains: what a single-machine run reaches."""
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    near = {n: {} for n in nodes}
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
    k = {n: sum(near[n].values()) for n in nodes}
    total, label = sum(k.values()), {n: n for n in nodes}
    size = dict(k)
    moved = True
    while moved:
        moved = False
        for n in nodes:
            own = label[n]
            links: dict[str, float] = {own: 0.0}
            for m, w in near[n].items():
                links[label[m]] = links.get(label[m], 0.0) + w
            gain = {c: w - resolution * k[n] * (size[c] - (k[n] if c == own else 0)) / total for c, w in links.items()}
            best = max(gain, key=lambda c: (gain[c], c == own, c))
            if gain[best] > gain[own] + 1e-9:
                size[own] -= k[n]
                size[best] += k[n]
                label[n], moved = best, True
    groups: dict[str, set[str]] = {}
    for n, c in label.items():
        groups.setdefault(c, set()).add(n)
    return groups


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_groups_are_found_and_connected(spark, seed):
    names, edges = planted(5, 12, 0.6, 0.03, seed)
    got = of(graph.communities(adjacency(spark, edges)))
    assert sorted(map(sorted, got.values())) == sorted(names)
    assert all(connected(edges, g) for g in got.values())
    assert all(c == min(g) for c, g in got.items())


def test_sparse_random_graph_is_as_good_as_moving_one_by_one(spark):
    """No planted groups: connected communities, at no less modularity than sequential moving reaches, every node once."""
    rng = random.Random(5)
    nodes = [f"n{i:03d}" for i in range(120)]
    edges = sorted({(*sorted(rng.sample(nodes, 2)), 1.0) for _ in range(220)})
    got = of(graph.communities(adjacency(spark, edges)))
    assert sorted(n for g in got.values() for n in g) == sorted({n for a, b, _ in edges for n in (a, b)})
    assert all(connected(edges, g) for g in got.values())
    assert plain_modularity(edges, got) >= plain_modularity(edges, sequential(edges)) - 0.005


def test_communities_take_few_small_jobs(spark, monkeypatch):
    """A graph without groups, on which rounds of joins over all its nodes hadn't ended after 100 seconds."""
    rng = random.Random(8)
    edges = sorted({(*sorted(rng.sample([f"n{i:03d}" for i in range(300)], 2)), 1.0) for _ in range(2400)})
    tables, staged = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df: tables.append(1) or staged(df))
    got = of(graph.communities(adjacency(spark, edges)))
    assert all(connected(edges, g) for g in got.values())
    assert plain_modularity(edges, got) >= plain_modularity(edges, sequential(edges)) - 0.005
    assert len(tables) <= 90


def test_several_blocks_move_and_refine_as_well_as_one(spark, monkeypatch):
    """Blocks of few links: several blocks move at once, and communities of more links are refined by rounds."""
    monkeypatch.setattr(graph, "BLOCK", 100)
    names, edges = planted(3, 16, 0.9, 0.03, 4)
    got = of(graph.communities(adjacency(spark, edges)))
    assert sorted(map(sorted, got.values())) == sorted(names)
    assert all(connected(edges, g) for g in got.values())


def islands(count):
    """Planted groups in separate components, one of them (of all the groups of the first seed) larger than 300 links."""
    edges = [(f"s{seed}{a}", f"s{seed}{b}", w) for seed in range(count) for a, b, w in planted(3 + 5 * (seed == 0), 6, 0.95, 0.02, seed)[1]]
    return edges + [(f"s0g{g:02d}n00", f"s0g{g + 1:02d}n00", 1.0) for g in range(7)]


def test_components_are_searched_whole_and_in_few_tasks(spark, monkeypatch):
    """A graph of several blocks whose components are no larger than one takes no rounds; the result is the same as in one task."""
    edges = [e for e in islands(7) if not e[0].startswith("s0")]
    one = of(graph.communities(adjacency(spark, edges)))
    monkeypatch.setattr(graph, "BLOCK", 200)
    assert 2 * len(edges) > graph.BLOCK

    def rounds(*_):
        raise AssertionError("moved by rounds")

    monkeypatch.setattr(graph, "_moved", rounds)
    got = of(graph.communities(adjacency(spark, edges)))
    assert got == one and all(connected(edges, g) for g in got.values())


def test_a_component_of_many_links_is_moved_by_rounds_beside_small_ones(spark, monkeypatch):
    edges = islands(3)
    one = of(graph.communities(adjacency(spark, edges)))
    monkeypatch.setattr(graph, "BLOCK", 200)
    got = of(graph.communities(adjacency(spark, edges)))
    assert sorted(n for g in got.values() for n in g) == sorted(n for g in one.values() for n in g)
    assert all(connected(edges, g) for g in got.values()) and all(c == min(g) for c, g in got.items())
    assert {c for c in got if not c.startswith("s0")} == {c for c in one if not c.startswith("s0")}
    assert plain_modularity(edges, got) >= plain_modularity(edges, one) - 0.005


def test_hierarchy_reads_its_links_once_and_searches_components_whole(spark, monkeypatch):
    edges = [e for e in islands(5) if not e[0].startswith("s0")]
    rows, seen = graph.adjacency(spark.createDataFrame(edges, "x string, y string, weight double")).toPandas(), spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    monkeypatch.setattr(graph, "BLOCK", 200)
    monkeypatch.setattr(graph, "_moved", None)
    adj = spark.createDataFrame(rows).mapInPandas(count, "id string, neighbour string, weight double")
    got = graph.hierarchy(adj, (1.0, 0.5)).collect()
    assert seen.value == len(rows) > graph.BLOCK
    fine, coarse = ({r["id"]: r["community"] for r in got if r["level"] == level} for level in (0, 1))
    assert fine.keys() == coarse.keys() == set(rows["id"])
    assert all(len({coarse[i] for i in fine if fine[i] == c}) == 1 for c in set(fine.values()))


def test_hierarchy_levels_are_nested(spark):
    names, edges = planted(8, 6, 0.9, 0.0, 3)
    edges += [(names[g][0], names[g + 1][0], 1.0) for g in range(0, 8, 2)] + [(names[g][1], names[g + 1][1], 1.0) for g in range(0, 8, 2)]
    rows = graph.hierarchy(adjacency(spark, edges), (1.0, 0.1)).collect()
    fine, coarse = ({r["id"]: r["community"] for r in rows if r["level"] == level} for level in (0, 1))
    assert len(set(fine.values())) == 8 and len(set(coarse.values())) == 4
    assert all(len({coarse[i] for i in fine if fine[i] == c}) == 1 for c in fine.values())
    assert all(r["parent"] in set(fine.values()) for r in rows if r["level"] == 1)


def test_moves_apart_touch_no_community_twice(spark):
    rng = np.random.default_rng(1)
    moves = [(f"v{i}", f"c{a}", f"c{b}", float(g)) for i, (a, b, g) in enumerate(zip(rng.integers(0, 30, 200), rng.integers(30, 60, 200), rng.random(200), strict=True))]
    got = graph._apart(spark.createDataFrame(moves, "id string, community string, to string, more double")).collect()
    touched = [c for r in got for c in (r["community"], r["to"])]
    assert len(touched) == len(set(touched)) > 0
    assert max(moves, key=lambda m: m[3])[0] in {r["id"] for r in got}


def test_dyadic_pieces_cover_a_range_once(spark):
    pairs = [(a, b) for a in range(0, 40, 3) for b in range(a, 60, 7)] + [(0, 0), (0, 2**35), (7, 2**35 + 1)]
    df = spark.createDataFrame(pairs, "b long, e long")
    for r in df.select("b", "e", chunking.dyadic(F.col("b"), F.col("e")).alias("p")).collect():
        spans = sorted((p["place"] << p["power"], (p["place"] + 1) << p["power"]) for p in r["p"])
        assert spans[0][0] == r["b"] and spans[-1][1] == r["e"] + 1 and all(x[1] == y[0] for x, y in itertools.pairwise(spans))
        assert len(spans) <= 2 * max(1, (r["e"] - r["b"] + 1).bit_length())


def test_innermost_equals_brute_force(spark):
    rng = random.Random(2)
    ranges = [(rng.randrange(3), f"s{i:03d}", b, b + rng.choice([0, 1, 5, 40, 300])) for i in range(150) for b in [rng.randrange(300)]]
    ranges += ranges[:5] + [(0, "turned", 9, 3), (None, "none", 0, 9), (0, "open", 5, None), (1, "early", -5, 4)]
    occ = [(rng.randrange(4), n, rng.randrange(400)) for n in range(300)] + [(0, 900, None), (None, 901, 3), (1, 902, 0), (2, 0, 5)]
    got = chunking.innermost(spark.createDataFrame(occ, "doc long, occ long, line long"), spark.createDataFrame(ranges, "doc long, symbol string, begin long, end long"))
    expected = []
    for doc, n, line in occ:
        held = [(e - b if b >= 0 else e - b, s) for d, s, b, e in ranges if None not in (doc, line, d, b, e) and d == doc and b <= line <= e]
        if held:
            expected.append((doc, n, line, min(held)[1]))
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_one_document_of_many_ranges_stays_linear(spark):
    """4,000 ranges and 4,000 lines of one document meet in at most 24 rows each, not in 16 million."""
    ranges = spark.range(4000).select(F.lit(1).alias("doc"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("symbol"), (F.col("id") * 7 % 4000).alias("begin"), (F.col("id") * 7 % 4000 + 1 + F.col("id") % 900).alias("end"))
    pieces = ranges.select(F.explode(chunking.dyadic(F.col("begin"), F.col("end"))).alias("p")).groupBy("p.power", "p.place").count()
    assert pieces.count() <= 2 * 5000 and pieces.select("power").distinct().count() <= 12


def test_pair_distances_equal_breadth_first_search(spark):
    rng = random.Random(8)
    steps = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(110)})
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)] + [(3, 3), (99, 3), (3, 99)]
    near: dict[int, set[int]] = {}
    for x, y in steps:
        near.setdefault(x, set()).add(y)
    for depth in (1, 4, 5):
        expected = set()
        for a, b in pairs:
            seen, front = {a}, {a}
            for d in range(depth + 1):
                if b in front:
                    expected.add((a, b, d))
                    break
                front = {y for x in front for y in near.get(x, ())} - seen
                seen |= front
        got = graph.pair_distances(spark.createDataFrame(steps, "x long, y long"), spark.createDataFrame(pairs, "start long, target long"), depth)
        assert {tuple(r) for r in got.collect()} == expected
