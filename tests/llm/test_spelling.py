"""Operator 13 against plain Python that compares all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kvasir.llm import spelling as S

UPPER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, least_length=6, least_n=5, every=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_n}
    form, n_near = {}, {}
    for w, k in words.items():
        met = [(-words[x], x) for x in words if near(w, x)]
        n_near[w] = len(met)
        best = min(met, default=None)
        form[w] = best[1] if best and -best[0] >= 5 * k else None
    out = []
    for w, k in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, k, n_near[w], form[w], words[form[w]] if form[w] else None, root))
    return sorted(map(repr, out))


def run(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x")).repartition(3)
    return sorted(repr(tuple(r)) for r in S.group_variants(docs, **kw).select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_equals_all_pairs(spark):
    """Few letters and many repeats, so that words have runs of equal letters, many neighbours, and chains of forms."""
    rng = np.random.default_rng(3)
    pool = ["".join(rng.choice(list("aabé"), rng.integers(3, 6))) for _ in range(60)]
    share = 1 / np.arange(1, 61) ** 1.5
    rows = [(d, " ".join(rng.choice(pool, 300, p=share / share.sum()))) for d in range(40)]
    kw = {"least_length": 3, "least_n": 2, "every": 7}
    expected = brute(rows, **kw)
    assert run(spark, rows, **kw) == expected and len(expected) > 60
    assert sum("None" not in r for r in expected) > 10


def test_chain_of_forms_ends_at_the_last(spark):
    words = {"planets": 1000, "planetz": 200, "planezz": 40, "plamezz": 8, "planet": 180, "garden": 9, "gardem": 9, "gardenn": 9}
    rows = [(1, " ".join(w for w, k in words.items() for _ in range(k)))]
    assert run(spark, rows) == brute(rows)
    out = {r.word: r for r in S.group_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out["plamezz"].root == "planets" and out["plamezz"].form == "planezz" and out["planet"].form == "planets"
    assert out["garden"].form is None and out["garden"].n_near == 2 and out["garden"].root == "garden"


def test_nulls_repeats_signs_case_and_long_runs(spark):
    long = "ab" * 1500
    rows = [
        (1, None), (2, ""), (None, "Àmesangl AMESANGL amesangl " * 5), (3, "×÷ÿÀàb1×÷ÿÀàc " * 6), (3, "×÷ÿÀàb " * 6),
        (4, f"{long} " * 5 + f"{long}x " * 30), (5, "Āmesangl word_with_parts große \U0001f600letters\U0001f600letters " * 9), (5, "Āmesangl word_with_parts große \U0001f600letters\U0001f600letters " * 9),
    ]
    assert run(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [(1, "a b c")]) == []


def test_keys_hold_links_only(spark):
    """Without verifying, the join emits no more than the links: work grows with the result, not with keys' squares."""
    words = [(f"{a}{b}{c}stem{d}", 5) for a in "abcdef" for b in "abcdef" for c in "abc" for d in "xyz"] + [("aaastemxx", 5), ("aastemx", 5)]
    df = spark.createDataFrame(words, "word string, n long")
    made = S.deletions(df)
    same_place = made.alias("a").join(made.alias("b"), ["key", "at"]).where("a.word <> b.word").count()
    by_length = sum(near(a, b) for a, _ in words for b, _ in words if len(a) == len(b))
    assert same_place == by_length
    assert S.links(df).count() == sum(near(a, b) for a, _ in words for b, _ in words)
