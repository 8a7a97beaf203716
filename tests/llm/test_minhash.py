"""Operator 9 and the components helper, against brute force."""

import random

import numpy as np

from kvasir.llm import components as cc
from kvasir.llm import minhash


def brute(rows):
    """{id: (set size, component)} by comparing all pairs."""
    sets = {i: minhash.shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "key", "rep", "bands", "a", "b"):
        df = df.withColumn(name, df["doc_id"])
    out = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    expected = brute(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == expected
    assert all(r["kept"] == (i == r["component_id"]) for i, r in out.items())


def test_shingles_by_definition():
    assert minhash.shingle_set("A b\x0bC\td e F") == {b"a b c d e", b"b c d e f"}
    assert minhash.shingle_set("É x") == {"É x".encode()}
    assert minhash.shingle_set(None) == minhash.shingle_set(" \n") == frozenset()
    signer = minhash.Signer()
    for t in ["a b c", "a b c d e f g", "", "x " * 40]:
        assert len(signer.shingles(t)) == len(minhash.shingle_set(t))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    rows, n = [], 0
    for _ in range(25):  # families of edited copies, some of them far from each other
        base = rng.choices(words, k=rng.choice([4, 6, 30, 120]))
        for _ in range(rng.choice([1, 2, 6, 15])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "One Two"), (n + 4, "one\ttwo"), (n + 5, "x " * 30000)]
    check(spark, rows)


def test_large_families_just_under_the_threshold(spark):
    """Copies of one lost text, each with edits of its own, are mostly apart; pairs of them that share edits are linked."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for k in range(90):
        t = list(base)
        for at in rng.sample(range(150), 2 if k % 3 == 0 else 5):
            t[at] = f"own{k}_{at}"
        if k % 3 == 0:  # a third shares edits with others, in subfamilies of many sizes
            for at in random.Random(k % 27).sample(range(150), 6):
                t[at] = f"shared{k % 27}_{at}"
        rows.append((k, " ".join(t)))
    expected = brute(rows)
    assert 2 < len({c for _, c in expected.values()}) < 90
    check(spark, rows)


def test_ids_with_several_texts_and_string_ids(spark):
    one, other = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    df = spark.createDataFrame([("a", one), ("a", other), ("b", other + " end"), ("c", "z"), ("c", "z")], "doc_id string, text string")
    out = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert out == [("a", 56, "a", True), ("a", 56, "a", True), ("b", 57, "a", False), ("c", 1, "c", True), ("c", 1, "c", True)]


def test_chains_and_empty_tables(spark):
    """A chain whose ends differ is one component through links that no hub has."""
    words = [f"c{i}" for i in range(400)]
    rows = [(k, " ".join(words[k * 6 : k * 6 + 120])) for k in range(30)]
    check(spark, rows)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (3, "a b")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in minhash.near_duplicates(nulls).collect()) == [(-1, -1, True), (3, 3, True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (300, 100), (5, 5), (7, 3)] + [(1000, k) for k in range(1001, 1200)]
    out = {r["id"]: r["component"] for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 1 for i in range(1, 61)) and all(out[i] == 100 for i in (100, 200, 300)) and all(out[i] == 1000 for i in range(1000, 1200))
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited_family(n):
    """Copies of one text of 200 words, each with 7 of 16 places replaced by one of two words."""
    rng = random.Random(11)
    places = [6 + 12 * i for i in range(16)]
    rows = []
    for k in range(n):
        t = [f"t{i}" for i in range(200)]
        for at in rng.sample(places, 7):
            t[at] = f"e{at}_{rng.randrange(2)}"
        rows.append((k, " ".join(t)))
    return rows


def test_common_edits_in_many_combinations_make_few_rows(spark, monkeypatch):
    """The rows of all levels together stay below all pairs, though each document is in a family of every band, and shrink."""
    made, whole = [], minhash._divided

    def counted(rows, stage, n):
        links, smaller = whole(rows, stage, n)
        made.append(smaller.count())
        return links, smaller

    monkeypatch.setattr(minhash, "_divided", counted)
    rows = edited_family(300)
    check(spark, rows)
    assert sum(made) <= 300 * 299 / 2 and all(y <= x / 4 for x, y in zip(made, made[1:], strict=False))


def parts_of_one_text(n):
    """Copies of one lost text, each without some of its 12 lines and half of them with a word changed; some are linked."""
    rng = random.Random(13)
    lines = [[f"t{k}x{i}" for i in range(12)] for k in range(12)]
    rows = []
    for k in range(n):
        t = [w for line in sorted(rng.sample(range(12), rng.choice([7, 8, 9]))) for w in lines[line]]
        if k % 2:
            t[rng.randrange(len(t))] = f"own{k}"
        rows.append((k, " ".join(t)))
    return rows


def test_families_are_compared_in_blocks_without_dividing(spark, monkeypatch):
    """Division made subfamilies whose edits grew far faster than the documents; a member's edits now go once to each block."""

    def divided(*_):
        raise AssertionError("a family of one block was divided")

    monkeypatch.setattr(minhash, "_divided", divided)
    rows = parts_of_one_text(160)
    assert 20 < len({c for _, c in brute(rows).values()}) < 160
    check(spark, rows)
    monkeypatch.setattr(minhash, "BLOCK", 20)
    check(spark, rows)


def test_families_of_too_many_blocks_are_divided(spark, monkeypatch):
    calls, whole = [], minhash._divided
    monkeypatch.setattr(minhash, "_divided", lambda *x: calls.append(1) or whole(*x))
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "BLOCKS", 3)
    check(spark, edited_family(150))
    assert calls


def test_common_edits_of_two_sides_equal_counting(monkeypatch):
    rng = random.Random(17)
    weights = np.array([rng.randrange(1, 9) for _ in range(300)])
    sides = [[{x for x in range(300) if rng.random() < (0.5 if x < 40 else 0.02)} for _ in range(n)] for n in (70, 50)]
    expected = [[sum(weights[x] for x in a & b) for b in sides[1]] for a in sides[0]]
    flat = [tuple(np.array(c) for c in zip(*[(k, x) for k, s in enumerate(side) for x in sorted(s)], strict=True)) for side in sides]
    assert minhash._common(*flat, weights, 70, 50).tolist() == expected
    monkeypatch.setattr(minhash, "AT_ONCE", 7)
    monkeypatch.setattr(minhash, "COLUMNS", 3)
    assert minhash._common(*flat, weights, 70, 50).tolist() == expected
    none = (np.zeros(0, int), np.zeros(0, int))
    assert minhash._common(flat[0], none, weights, 70, 3).sum() == 0 == minhash._common(none, none, weights, 0, 0).size
