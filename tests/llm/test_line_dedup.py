"""Operator 6 against brute force over all runs of lines."""

import random

from kvasir.llm import line_dedup


def brute(rows, min_words):
    """{(doc, text): text without later copies}: every run of enough words with an earlier copy goes."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    first, gone = {}, set()
    for i, t in docs:
        lines = t.split("\n")
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= min_words:
                    if first.setdefault(tuple(lines[a:b]), (i, t, a)) != (i, t, a):
                        gone |= {(i, t, k) for k in range(a, b)}
    return {(i, t): "\n".join(x for k, x in enumerate(t.split("\n")) if (i, t, k) not in gone) for i, t in docs}


def check(spark, rows, min_words=10):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("doc", "th", "pos", "rank", "row", "begins", "doc_"):
        df = df.withColumn(name, df["doc_id"])
    out = line_dedup.dedup_lines(df, min_words=min_words).collect()
    expected = brute(rows, min_words)
    given = {i: t for i, t in rows}
    assert len(out) == len(rows) and out[0].asDict().keys() == set(df.columns)
    assert all((r["text"] or "") == expected[r["doc_id"], given[r["doc_id"]] or ""] for r in out)
    assert all(r["text"] is None for r in out if given[r["doc_id"]] is None)
    return out


def test_random_tables_equal_brute_force(spark):
    rng = random.Random(11)
    for n_words in (3, 7, 10):
        pool = [" ".join(rng.choices("abcdefgh", k=rng.choice([0, 1, 2, 3, 5]))) for _ in range(14)]
        block = rng.choices(pool, k=9)
        rows = []
        for i in range(24):
            lines = rng.choices(pool, k=rng.randrange(1, 9))
            if rng.random() < 0.6:
                a = rng.randrange(6)
                at = rng.randrange(len(lines))
                lines[at:at] = block[a : a + rng.randrange(2, 9)]
            rows.append((i, "\n".join(lines)))
        check(spark, rows, n_words)


def test_cases(spark):
    long = "\n".join(f"line number {i} of a very long document with many words in it" for i in range(700))
    hot = "a licence line of ten words that very many documents hold"
    rows = [(i, f"{hot}\nown line of {i} here") for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, long), (54, long + "\nlast"), (55, f"{hot}\n{hot}\n{hot}"), (56, "one two\nthree"), (57, "one two\nthree")]
    out = {r["doc_id"]: r["text"] for r in check(spark, rows)}
    assert out[0].startswith(hot) and out[1] == "own line of 1 here" and out[54] == "last" and out[55] == "" and out[57] == "one two\nthree"
    # Repeated rows are one document; null ids come first.
    again = spark.createDataFrame([(None, hot), (1, hot), (1, hot), (2, "x")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(again).collect()) == [(0, hot), (1, ""), (1, ""), (2, "x")]
    assert line_dedup.dedup_lines(again.limit(0)).count() == 0
