"""The rules of entity extraction, one by one."""

from kvasir.operators import extraction

CASES = {
    1: ("Use PostgreSQL, postgresql and Go.", {("TECHNOLOGY", "PostgreSQL", 0.6), ("TECHNOLOGY", "Go", 0.6)}),
    2: ("at Acme Widget Corp and Google", {("ORGANIZATION", "Acme Widget", 0.5), ("ORGANIZATION", "Google", 0.5), ("OTHER", "Acme Widget Corp", 0.3)}),
    3: ("done. Jane Smith left. And then Jane Smith said so", {("PERSON", "Jane Smith", 0.3)}),
    4: ("the Strategy Document, the Todo and Monday", {("CONCEPT", "Strategy Document", 0.3)}),
    5: ("Bo and Ann and Anna", {("OTHER", "Anna", 0.3)}),
    6: ("Alpha Beta Gamma Delta Epsilon", {("OTHER", "Alpha Beta Gamma Delta", 0.3), ("OTHER", "Epsilon", 0.3)}),
    7: ("", set()),
    8: (None, set()),
    9: ("Deploy with github actions" + " x" * 60 + " Anna", {("TECHNOLOGY", "github actions", 0.6), ("OTHER", "Anna", 0.3)}),
    10: ("why? Maybe! Perhaps", set()),
}


def test_entities(spark):
    rows = spark.createDataFrame([(k, x) for k, (x, _) in CASES.items()], "k int, s string")
    got = {k: set() for k in CASES}
    for r in extraction.entities(rows, "k", "s").collect():
        got[r["k"]].add((r["kind"], r["name"], r["confidence"]))
    assert got == {k: e for k, (_, e) in CASES.items()}


def test_entities_of_sentences(spark):
    rows = spark.createDataFrame([("a", "We like Redis. Then redis and Docker, Bo said. Jane Smith left")], "id string, s string")
    assert {(r["sentence"], r["alias"]) for r in extraction.by_sentence(rows, "id", "s").collect()} == {(0, "redis"), (1, "redis"), (1, "docker")}
