"""Closed-form cases of the operators, computed by hand."""

import math
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kvasir.functions import budget, text
from kvasir.operators import chunking, graph, metrics, relational, retrieval, scoring, vectors

NOW = 1704067200
DAY = 86400


def memory(**over):
    base = dict(
        id="m", type="note", title="T", content="C", importance=0.5, tags=["test"], related_files=["src/a.ts", "src/b.ts"], created_at=NOW - 7 * DAY, accessed_at=NOW - DAY, access_count=10, decay_rate=None, last_refreshed_at=None
    )
    return base | over


SCHEMA = (
    "id string, type string, title string, content string, importance double, tags array<string>, related_files array<string>, created_at long, accessed_at long, access_count long, decay_rate double, last_refreshed_at long"
)


def frame(spark, *rows):
    return spark.createDataFrame([Row(**memory(**r)) for r in rows], SCHEMA)


def one(df, column):
    return df.select(column.alias("x")).first()["x"]


def lit(spark, column):
    return one(spark.range(1), column)


def test_recency(spark):
    assert lit(spark, scoring.recency_exponential(F.lit(30.0), 30)) == pytest.approx(0.5)
    assert lit(spark, scoring.recency_exponential(F.lit(30.0), 0)) == 0
    assert lit(spark, scoring.recency_linear(F.lit(50.0), 100)) == 0.5
    steps = [(7, 0.8), (30, 0.5)]
    assert [lit(spark, scoring.recency_step(F.lit(d), steps)) for d in (1.0, 7.0, 29.0, 90.0)] == [1.0, 0.8, 0.8, 0.5]
    assert lit(spark, scoring.recency_step(F.lit(1.0), [])) == 0


def test_frequency(spark):
    assert lit(spark, scoring.frequency_log(F.lit(9), 99)) == pytest.approx(0.5)
    assert lit(spark, scoring.frequency_log(F.lit(0), 99)) == 0.5
    assert lit(spark, scoring.frequency_linear(F.lit(25), 100)) == 0.25
    assert lit(spark, scoring.frequency_sigmoid(F.lit(50), 100)) == pytest.approx(0.5)


def test_non_finite_values(spark):
    assert lit(spark, scoring.semantic_score(F.lit(float("nan")))) == 0
    assert lit(spark, scoring.confidence_score(F.lit(float("inf")))) == 0.5
    assert lit(spark, scoring.semantic_score(F.lit(1.5))) == 1


def test_decayed_confidence(spark):
    old = dict(importance=0.8, created_at=NOW - 90 * DAY, accessed_at=NOW - 90 * DAY)
    decay = scoring.decayed_confidence(scoring.Decay(), NOW)
    assert one(frame(spark, old), decay) == pytest.approx(0.4)
    assert one(frame(spark, old | {"decay_rate": 0.0}), decay) == 0.8
    assert one(frame(spark, old | {"type": "architecture"}), decay) == 0.8
    assert one(frame(spark, old | {"tags": ["PINNED"]}), decay) == 0.8
    floor = scoring.decayed_confidence(scoring.Decay(floor=0.5), NOW)
    assert one(frame(spark, dict(importance=0.3, created_at=0, accessed_at=0)), floor) == 0.3
    assert one(frame(spark, old | {"last_refreshed_at": NOW}), decay) == 0.8


def test_weights_and_boosts(spark):
    assert scoring.Weights(0, 0, 0, 0).normalised() == scoring.Weights(0.25, 0.25, 0.25, 0.25)
    assert scoring.Weights(2, 1, 1, 0).normalised() == scoring.Weights(0.5, 0.25, 0.25, 0)
    m = frame(spark, {})
    score, _ = scoring.boosted(F.lit(0.9), [scoring.Boost("a", "recency", 30, 3.0)], NOW)
    assert one(m, score) == 2.0
    score, names = scoring.boosted(F.lit(-0.5), [scoring.Boost("a", "importance", 0.9, 3.0)], NOW)
    assert one(m, score) == -0.5 and one(m, names) == []
    both = scoring.Boost("t", "tags", ("TEST", "other"), 1.5, True)
    assert one(m, scoring.boosted(F.lit(1.0), [both], NOW)[1]) == []
    with pytest.raises(ValueError):
        scoring.boosted(F.lit(1.0), [scoring.Boost("x", "nothing", 1, 2.0)], NOW)


def test_staleness(spark):
    m = frame(spark, dict(created_at=NOW - 90 * DAY, accessed_at=NOW - 90 * DAY))
    assert one(m, scoring.time_decay_signal(NOW)) == 0.5
    assert one(frame(spark, {}), scoring.time_decay_signal(NOW)) is None
    changes = spark.createDataFrame([("./SRC/a.ts", NOW), ("src/b.ts", 0)], "file string, last_change long")
    r = scoring.git_change_signal(m, changes).first()
    assert (r["changed"], r["total"], r["score"]) == (1, 2, 0.75)
    rel = spark.createDataFrame([], "source_id string, target_id string, type string")
    row = scoring.staleness(m, rel, spark.createDataFrame([], changes.schema), NOW).first()
    assert (row["composite"], row["action"]) == (0.5, "review")
    sup = spark.createDataFrame([("x", "m", "supersedes")], rel.schema)
    assert scoring.staleness(m, sup, changes, NOW).first()["action"] == "archive"


def test_similarities(spark):
    j = relational.set_jaccard(F.array(F.lit("a"), F.lit("B")), F.array(F.lit("b"), F.lit("c")))
    assert lit(spark, j) == pytest.approx(1 / 3)
    assert lit(spark, relational.set_jaccard(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0
    sets = spark.createDataFrame([("x", ["a"]), ("y", ["a", "b", "c"]), ("z", ["q"])], "k string, s array<string>")
    best = {r["k"]: (r["n_links"], r["best"]) for r in relational.overlap_links(sets, "k", "s", relational.overlap_coefficient, 1e-9).collect()}
    assert best == {"x": (1, 1.0), "y": (1, 1.0), "z": (0, None)}
    names = spark.createDataFrame([("healed",), ("sealed",), ("h ealed",)], "n string")
    dice = {(r["a"], r["b"]): r["dice"] for r in relational.dice_join(names, names, "n", "n", 0.5).collect()}
    assert dice["healed", "sealed"] == pytest.approx(0.8) and dice["healed", "h ealed"] == 1


def test_band_join_equals_brute_force(spark):
    at = [0, 3, 9, 10, 11, 25, 34, 35]
    rows = spark.createDataFrame(list(enumerate(at)), "k long, t long")
    got = {r["k"]: (r["n_links"], r["gap"]) for r in relational.band_links(rows, "k", "t", 10).collect()}
    gaps = {i: [abs(at[i] - at[j]) for j in range(len(at)) if j != i and abs(at[i] - at[j]) < 10] for i in range(len(at))}
    assert got == {i: (len(g), min(g, default=None)) for i, g in gaps.items()}


def test_overlap_links_equal_brute_force(spark):
    sets = {1: ["a", "b"], 2: ["b", "a"], 3: ["a", "c"], 4: ["d"], 5: [], 6: ["c"], 7: ["a", "b"]}
    rows = spark.createDataFrame(list(sets.items()), "k long, s array<string>")
    out = {r["k"]: (r["class_id"], r["n_links"], r["best"]) for r in relational.overlap_links(rows, "k", "s", relational.jaccard, 0.3).collect()}
    for k, mine in sets.items():
        others = [len({*mine} & {*s}) / len({*mine} | {*s}) for j, s in sets.items() if j != k and {*mine} & {*s}]
        others = [x for x in others if x >= 0.3]
        assert out[k] == (min(j for j, s in sets.items() if sorted(s) == sorted(mine)), len(others), max(others, default=None))


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", float(x)) for x in range(1, 6)], "g string, x double")
    near = {r["g"]: (r["p50"], r["p95"]) for r in metrics.nearest_rank(df, ["g"], "x", {"p50": 50, "p95": 95}).collect()}
    assert near == {"a": (2, 4), "b": (3, 5)}
    q = {r["g"]: (r["p50"], r["p95"]) for r in metrics.quantile_sorted(df, ["g"], "x", {"p50": 0.5, "p95": 0.95}).collect()}
    assert q == {"a": (2.5, 4), "b": (3, 5)}


def test_percentiles_equal_sorting(spark):
    rng = __import__("random").Random(7)
    rows = [(g, rng.choice([float(rng.randint(0, 900)), 5.0])) for g in ("hot", "hot", "hot", None, "few") for _ in range(400)] + [("one", 3.0), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    near = {r["g"]: tuple(r)[1:] for r in metrics.nearest_rank(df, ["g"], "x", {"p1": 1, "p50": 50, "p90": 90, "p99": 99}).collect()}
    mean = {r["g"]: r["p50"] for r in metrics.quantile_sorted(df, ["g"], "x", {"p50": 0.5}).collect()}
    for g in {g for g, _ in rows}:
        xs = sorted(x for h, x in rows if h == g)
        assert near[g] == tuple(xs[max(1, math.ceil(p * len(xs) / 100)) - 1] for p in (1, 50, 90, 99))
        half = len(xs) // 2
        assert mean[g] == (xs[half] if len(xs) % 2 else (xs[half - 1] + xs[half]) / 2)
    assert metrics.nearest_rank(df.limit(0), ["g"], "x", {"p50": 50}).count() == 0


def test_expertise(spark):
    def factor(*counts):
        rows = [("d", f"{i}@x", i, 1000) for i, n in enumerate(counts) for _ in range(n)]
        df = spark.createDataFrame(rows, "dir string, author_email string, n int, ts_s long")
        r = metrics.bus_factor(metrics.expertise(df)).first()
        return r["bus_factor"], r["risky"]

    assert [factor(100), factor(80, 20), factor(79, 21), factor(40, 35, 25), factor(96, 4)] == [(1, True), (2, True), (2, False), (3, False), (1, True)]
    entries = spark.createDataFrame([("a", 2, True, 10), ("b", 2, False, 10)], "dir string, bus_factor long, risky boolean, last_commit long")
    assert metrics.health(entries, 5).first()["health"] == 60
    assert metrics.health(entries.limit(0), 5).first()["health"] == 100


def test_reviewers(spark):
    own = spark.createDataFrame([("f", "a@x", 6, 1, 0, 60), ("f", "b@x", 4, 0, 0, 40)], "file string, author_email string, commits long, recent long, last_commit long, pct long")
    out = {r["author_email"]: r for r in metrics.reviewers(own, spark.createDataFrame([("f",)], "file string")).collect()}
    a = out["a@x"]
    assert (a["expertise_pct"], a["relevance"], a["category"]) == (60, 0.98, "required") and out["b@x"]["category"] == "optional"


def test_modularity_and_communities(spark):
    edges = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6)]
    adj = graph.adjacency(spark.createDataFrame([(*e, 1.0) for e in edges], "x long, y long, weight double"))
    c = graph.communities(adj)
    groups = {}
    for r in c.collect():
        groups.setdefault(r["community"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5, 6]]
    assert graph.modularity(adj, c).first()["modularity"] == pytest.approx(0.5)
    alone = adj.select("id", F.col("id").alias("community")).distinct()
    assert graph.modularity(adj, alone).first()["modularity"] < 0
    assert {r["level"] for r in graph.hierarchy(adj, (1.0, 0.5)).collect()} == {0, 1}


def test_traversals(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("x", "a")], "from_node string, to_node string")
    start = spark.createDataFrame([("a",)], "id string")
    out = {r["id"]: r["depth"] for r in graph.bfs(graph.directed(e, "out"), start, 3).collect()}
    assert out == {"a": 0, "b": 1, "c": 1}
    back = {r["id"]: r["depth"] for r in graph.bfs(graph.directed(e, "in"), start, 1).collect()}
    assert back == {"a": 0, "c": 1, "x": 1}
    paths = {r["id"]: r["path"] for r in graph.shortest_paths(graph.directed(e, "out"), start, 3).collect()}
    assert paths == {"a": "a", "b": "a>b", "c": "a>c"}
    nodes = spark.createDataFrame([(i,) for i in range(20)], "id long")
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(12, 11)], "x long, y long")
    comp = {r["id"]: r["component"] for r in graph.connected_components(nodes, chain).collect()}
    assert all(comp[i] == 0 for i in range(10)) and comp[12] == 11 and comp[15] == 15


def candidates(spark, rows, route, rag, kag, graphrag):
    return spark.createDataFrame([(1, i, s, r, t, route, rag, kag, graphrag) for i, s, r, t in rows], "query_id long, id string, source string, relevance double, terms array<string>, route string, rag double, kag double, graphrag double")


def order(df):
    return [r["id"] for r in sorted(retrieval.rerank(df).collect(), key=lambda r: r["rank"])]


def test_reranking(spark):
    code = [("rag-1", "rag", 1.0, ["auth", "token"]), ("rag-2", "rag", 0.95, ["auth", "strategy"]), ("kag-1", "kag", 0.9, ["validate", "token"]), ("kag-2", "kag", 0.88, ["caller", "impact"])]
    assert order(candidates(spark, code, "code", 0.25, 0.75, 0.0))[0].startswith("kag")
    mem = [("rag-1", "rag", 0.88, ["decision", "history"]), ("kag-1", "kag", 0.9, ["validate", "caller"])]
    assert order(candidates(spark, mem, "memory", 0.9, 0.1, 0.0))[0] == "rag-1"
    new = [("rag-1", "rag", 0.9, ["auth", "token"]), ("rag-2", "rag", 0.88, ["auth", "token"]), ("rag-3", "rag", 0.87, ["refresh", "rotation"])]
    assert order(candidates(spark, new, "memory", 1.0, 0.0, 0.0))[:2] == ["rag-1", "rag-3"]
    assert retrieval.shares(0, 0, 0) == {"rag": 0.5, "kag": 0.25, "graphrag": 0.25}


def test_budget_is_never_exceeded_and_skips(spark):
    r = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40), (2, 1, 200)], "query_id long, rank long, tokens long")
    got = {(x["query_id"], x["rank"]): x["included"] for x in retrieval.within_budget(r, 100).collect()}
    assert got == {(1, 1): True, (1, 2): False, (1, 3): True, (2, 1): False}


def test_budget_allocation(spark):
    got = {c: lit(spark, x) for c, x in budget.allocate(F.lit(1000), budget.RATIOS["balanced"]).items()}
    assert got == {"system": 100, "context": 600, "user": 200, "response": 100}
    got = {c: lit(spark, x) for c, x in budget.allocate(F.lit(1000), budget.RATIOS["balanced"], {"system": 300}, {"context": 500}).items()}
    assert sum(got.values()) == 1000 and got["system"] >= 300 and got["context"] <= 500


def test_vectors(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "q_id long, v array<double>")
    x = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, [2.0, 0.0])], "id long, v array<double>")
    got = [(r["id"], r["similarity"]) for r in sorted(vectors.knn(q, x, 5).collect(), key=lambda r: r["rank"])]
    assert got == [(1, 1.0), (5, 1.0), (2, 0.5), (4, 0.5), (3, 0.0)]
    assert lit(spark, vectors.truncate_normalise(F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0)), 2)) == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="differ in length"):
        lit(spark, vectors.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))


def test_text(spark):
    assert lit(spark, text.commit_category(F.lit("chore: bump"))) is None
    assert lit(spark, text.commit_category(F.lit("fix(x)!: y"))) == "solution"
    assert lit(spark, text.route(F.lit("why does foo(bar) break"))) == "hybrid"
    assert lit(spark, text.slug(F.lit("  Big  Data! "))) == "big-data"
    assert lit(spark, text.issues(F.lit("closes #3, PROJ-12"))) == ["#3", "#PROJ-12"]
    assert lit(spark, text.entity_alias(F.lit('"Auth_Service"/v2.0'))) == "auth service v2 0"


def test_markdown_sections(spark):
    df = spark.createDataFrame([(1, "---\nt: 1\n# no\n---\nintro\n# A\nx\n```\n# code\n```\n## B\ny\n### C\n## D\n# E")], "k int, m string")
    rows = sorted(chunking.markdown_sections(df, "k", "m").collect(), key=lambda r: r["start_line"])
    assert [(r["start_line"], r["end_line"], r["headers"]) for r in rows] == [(1, 5, []), (6, 10, ["A"]), (11, 12, ["A", "B"]), (13, 13, ["A", "B", "C"]), (14, 14, ["A", "D"]), (15, 15, ["E"])]
    assert "\n".join(r["content"] for r in rows) == df.first()["m"]


def test_line_chunks_concatenate(spark):
    body = "\n".join(f"word{i} " * (i % 7) for i in range(60))
    df = spark.createDataFrame([(1, body)], "k int, m string")
    rows = sorted(chunking.pack_lines(df, "k", "m", 20).collect(), key=lambda r: r["chunk"])
    assert "\n".join(r["content"] for r in rows) == body and all(r["tokens"] <= 20 for r in rows)


def _split_by_hand(section, most):
    """Line by line: a list of (text, tokens) parts."""
    count = lambda t: len(re.findall(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]", t))
    units, fence = [], None
    for line in section.split("\n"):
        mark = re.match(r"\s*(```|~~~)", line)
        if fence is not None:
            fence.append(line)
            if mark:
                units.append("\n".join(fence))
                fence = None
        elif mark:
            fence = [line]
        else:
            units.append(line)
    units += ["\n".join(fence)] if fence else []
    parts, held = [], []
    for u in units:
        single = count(u) > most
        if held and (single or sum(map(count, held)) + count(u) > most):
            parts.append("\n".join(held))
            held = []
        if single and not re.match(r"\s*(```|~~~)", u):
            tokens = re.findall(r"\s*(?:[A-Za-z0-9_]+|[^\sA-Za-z0-9_])", u)
            parts += ["".join(tokens[i : i + most]) for i in range(0, len(tokens), most)]
        elif single:
            parts.append(u)
        else:
            held.append(u)
    return parts + (["\n".join(held)] if held else [])


def test_markdown_chunks(spark):
    fence, long_fence = "```\na b\n# c\n```", "```\n" + "x y z\n" * 9 + "```"
    body = "\n".join(["# A", "one two", "## B", "w1 w2 w3 w4", fence, "", "l " * 33, "end, of it", long_fence, "last", "more words on the line", "again some more words", "~~~", "not closed"])
    df = spark.createDataFrame([(1, body), (2, "short"), (3, ""), (4, None)], "k int, m string")
    rows = sorted(chunking.markdown_chunks(df, "k", "m", 12).collect(), key=lambda r: (r["k"], r["chunk"]))
    assert [(r["content"], r["headers"]) for r in rows if r["k"] == 2] == [("short", [])] and {r["k"] for r in rows} == {1, 2}
    mine = [r for r in rows if r["k"] == 1]
    expected = _split_by_hand(body.split("\n", 2)[2], 12)
    context = "<!-- Context: A > B -->\n"
    assert [r["content"] for r in mine] == ["# A\none two", expected[0], *[context + x for x in expected[1:]]]
    assert all(r["tokens"] <= 12 or "```" in r["content"] for r in mine) and [r["chunk"] for r in mine] == list(range(len(mine)))


def test_definitions_are_split(spark):
    box = "class Box:\n    size = 1\n    def area(self, x):\n        if x(1):\n            return x\n    async def run(self):\n        return 1"
    body = "import os\n" + box + "\ndef long():\n" + "\n".join(f"    a{i} = b + c" for i in range(12))
    files = spark.createDataFrame([("f.py", body)], "file string, code string")
    out = chunking.split_definitions(chunking.code_chunks(files, "file", "code"), "file", 15)
    rows = sorted(out.collect(), key=lambda r: r["start_line"])
    assert [(r["kind"], r["name"], r["parent"]) for r in rows[:4]] == [("import", "", None), ("class", "Box", None), ("method", "area", "Box"), ("method", "run", "Box")]
    assert {(r["kind"], r["name"]) for r in rows[4:]} == {("def_partial", "long")} and len(rows) > 6
    assert "\n".join(r["content"] for r in rows) == body


def test_enclosing_range(spark):
    occ = spark.createDataFrame([("d", 1, 5), ("d", 2, 50), ("e", 3, 5)], "doc string, occ long, line long")
    ranges = spark.createDataFrame([("d", "outer", 0, 20), ("d", "inner", 4, 6), ("d", "other", 30, 40)], "doc string, symbol string, begin long, end long")
    assert {r["occ"]: r["symbol"] for r in chunking.innermost(occ, ranges).collect()} == {1: "inner"}


def test_graph_build(spark):
    from kvasir.operators import graphrag
    from kvasir.plans.projects import SENTENCES

    notes = spark.createDataFrame([(f"m{n}", text) for n, text in enumerate(SENTENCES, 1)], "id string, content string")
    made = graphrag.build(notes)
    found = {r["alias"]: (r["kind"], r["mentions"]) for r in made["entities"].collect()}
    assert found["postgresql"] == ("TECHNOLOGY", 2) and found["acme"][0] == "ORGANIZATION" and found["jane smith"] == ("PERSON", 2)
    rel = {(r["x"], r["y"]): r["strength"] for r in made["relationships"].collect()}
    assert rel["postgresql", "redis"] == 4 and ("jane smith", "redis") not in rel
    of = {r["id"]: r["community"] for r in made["communities"].collect()}
    assert of["postgresql"] == of["redis"] != of["docker"] == of["kubernetes"]
    again = graphrag.build(notes, made["links"].select("id").union(spark.createDataFrame([("m4",)], "id string")))
    assert all(t.count() == 0 for t in again.values())


def test_cache_queries_of_any_script(spark):
    q = spark.createDataFrame([("  Привет,  Мир! ",), ("你好？",), ("?!",), ("(a-b)",)], "q string")
    from kvasir.functions import text

    assert [r[0] for r in q.select(text.cache_query(q["q"])).collect()] == ["привет, мир", "你好？", "?!", "a-b"]


def test_stable_json(spark):
    given = {
        '{"b":{"z":1,"a":[{"y":2,"x":1},3]}, "a" : null}': '{"a":null,"b":{"a":[{"x":1,"y":2},3],"z":1}}', '{"n":1.0,"s":"2.0, \\"3.0","d":-0.50,"m":-7.0}': '{"d":-0.5,"m":-7,"n":1,"s":"2.0, \\"3.0"}',
        "[]": "[]", '"x"': '"x"', "": None, "{bad": None, None: None, '{"a":1,"a":2}': None,
    }
    rows = spark.createDataFrame([(k,) for k in given], "s string")
    assert {r["s"]: r["j"] for r in rows.select("s", text.stable_json(F.col("s")).alias("j")).collect()} == given


def test_code_references(spark):
    given = "x" * 60 + " uses `run`, `parse.Query`, `Box`, `a_b`, `src/a` no, in src/api/handler.ts with\nAuthService and Interface"
    row = spark.createDataFrame([(given,)], "s string").select(text.code_references(F.col("s")).alias("r")).first()["r"]
    got = [(r["source"], r["kind"], r["name"]) for r in row]
    assert got == [("backtick", "function", "run"), ("backtick", "file", "parse.Query"), ("backtick", "class", "Box"), ("backtick", "generic", "a_b"), ("path", "file", "src/api/handler.ts"), ("name", "class", "AuthService")]
    assert row[0]["context"].startswith("...xxx") and row[0]["context"].endswith("...") and "`run`" in row[0]["context"]
    assert row[5]["context"].endswith("with AuthService and Interface")


def test_pr_summary(spark):
    rows = [(1, "feat(ui): a", 2), (1, "Feat: b", 1), (1, "fix: c", 1), (1, "docs: d", 1), (2, "update things", 3), (2, "feat!: e", 4), (3, None, 1)]
    got = {r["k"]: r["summary"] for r in metrics.pr_summary(spark.createDataFrame(rows, "k int, m string, f int"), "k", "m", "f").collect()}
    assert got == {
        1: "Adds 2 new feature(s). Fixes 1 bug(s). Updates documentation.", 2: "This PR includes 2 commit(s) affecting 7 file(s).", 3: "This PR includes 1 commit(s) affecting 1 file(s).",
    }


def test_truncate_tokens(spark):
    given = {"a b, c": "a b,", "  x": "  x", "": "", "one two_2  ": "one two_2", None: None}
    rows = spark.createDataFrame([(k,) for k in given], "s string")
    assert {r["s"]: r["t"] for r in rows.select("s", text.truncate_tokens(F.col("s"), 3).alias("t")).collect()} == given


def test_candidates_known_across_layers(spark):
    cand = spark.createDataFrame([("m", "n", "documents"), ("m", "n", "addresses"), ("m", "o", "documents")], "memory_id string, node_id string, type string")
    assert {tuple(r) for r in relational.without_same(cand, cand.limit(1), cand.columns).collect()} == {("m", "n", "addresses"), ("m", "o", "documents")}


def test_code_summaries(spark):
    cases = [
        ("typescript", "/**\n * Adds *two*.\n */\nexport function add() {}", "function", "add", ("Adds two.", "docstring", 0.9, True)), ("python", 'def f():\n  """ Doc """\n', "function", "f", ("Doc", "docstring", 0.9, False)),
        ("python", "x = 1 # note\n", "other", "x", ("note", "comment", 0.7, False)), ("go", "// One\n\n// two\nfunc f() {}\n// no", "function", "f", ("One two", "docstring", 0.9, False)), ("rust", "/// A\n//! b\npub fn f() {}", "function", "f", ("A b", "docstring", 0.9, True)),
        ("typescript", "class Box {}", "class", "Box", ("Class Box", "signature", 0.5, True)), ("sql", "", "other", None, ("Code unit anonymous", "signature", 0.5, True)), ("javascript", "\n\n\n// late", "function", "g", ("Function g", "signature", 0.5, True)),
    ]
    rows = spark.createDataFrame([(n, *c[:4]) for n, c in enumerate(cases)], "n int, language string, code string, kind string, name string")
    got = rows.select("n", text.code_summary(F.col("code"), F.col("language"), F.col("kind"), F.col("name")).alias("s")).orderBy("n").collect()
    assert [tuple(r["s"]) for r in got] == [c[4] for c in cases]
