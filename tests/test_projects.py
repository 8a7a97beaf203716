"""Tags, stacks and SCIP indexes on small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from kvasir.operators import projects
from kvasir.sources import scip


def test_tags(spark):
    tags = projects.taxonomy(spark)
    assert tags.count() == 76
    rows = spark.createDataFrame([(1, " TS "), (2, "Node.JS"), (3, "My Own Tag!"), (4, None), (5, "  "), (6, "c#")], "k int, tag string")
    got = {r["k"]: r["canonical"] for r in projects.normalise(rows, "tag", tags).collect()}
    assert got == {1: "typescript", 2: "nodejs", 3: "my-own-tag", 4: None, 5: None, 6: "csharp"}
    strict = {r["k"]: r["canonical"] for r in projects.normalise(rows, "tag", tags, strict=True).collect()}
    assert strict == got | {3: None}
    lists = spark.createDataFrame([(1, ["k8s", "Kube", "x y", "kubernetes", "auth"]), (2, []), (3, None)], "k int, t array<string>")
    assert {r["k"]: r["tags"] for r in projects.normalise_list(lists, "k", "t", tags).collect()} == {1: ["kubernetes", "x-y", "authentication"], 2: [], 3: []}


def test_tag_suggestions(spark):
    asked = spark.createDataFrame([("Python",), ("k8s",), ("typscript",), ("metrix",), ("",), (None,)], "q string")
    got = {}
    for r in projects.suggest(asked, "q", projects.taxonomy(spark)).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["canonical"], r["score"]))
    best = {q: min(v) for q, v in got.items()}
    assert best["python"] == (1, "python", 1.0) and best["k8s"] == (1, "kubernetes", 0.99)
    assert best["typscript"][1] == "typescript" and best["typscript"][2] == pytest.approx(2 * 7 / 17)
    # "metrix" has four of its five pairs in the alias "metrics", of six: less 5 in 100 as an alias.
    assert best["metrix"][1:] == ("monitoring", pytest.approx(0.95 * 2 * 4 / 11))
    assert set(got) == {"python", "k8s", "typscript", "metrix"}


def test_stack(spark):
    deps = spark.createDataFrame([("a", "react"), ("a", "next"), ("a", "drizzle-orm"), ("a", "jest"), ("a", "vitest"), ("b", "express"), ("b", "pg"), ("c", "left-pad")], "project string, dep string")
    files = spark.createDataFrame([("a", "src/app"), ("a", "drizzle.config.ts"), ("a", "yarn.lock"), ("a", "bun.lock"), ("c", "deno.json")], "project string, path string")
    got = {(r["project"], r["part"]): r["name"] for r in projects.stack(deps, files).collect()}
    assert got == {
        ("a", "framework"): "Next.js (App Router)", ("a", "database"): "Drizzle (configured)", ("a", "testing"): "Vitest", ("a", "runtime"): "Bun",
        ("b", "framework"): "Express", ("b", "database"): "PostgreSQL", ("c", "runtime"): "Deno",
    }


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else b"".join(map(varint, value)) if isinstance(value, list) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def symbol(name, kind=0, docs=(), display="", relations=()):
    out = field(1, name) + b"".join(field(3, d) for d in docs) + b"".join(field(4, field(1, s) + field(n, 1)) for s, n in relations)
    return out + (field(5, kind) if kind else b"") + (field(6, display) if display else b"")


def occurrence(name, span, roles=0, around=None):
    return field(1, span) + field(2, name) + (field(3, roles) if roles else b"") + (field(7, around) if around else b"")


@pytest.fixture
def index(tmp_path):
    box, run, shape, helper, size = "npm x 1 `a.ts`/Box#", "npm x 1 `a.ts`/Box#run().", "npm x 1 `a.ts`/Shape#", "npm x 1 `b.ts`/helper0().", "npm x 1 `a.ts`/Box#size."
    a = field(1, "a.ts") + field(4, "TypeScript") + b"".join(field(3, s) for s in (
        symbol(box, docs=["class Box"], relations=[(shape, 3), (helper, 2)]), symbol(run, kind=26, display="run"), symbol(shape, kind=21), symbol(size, docs=["(property) size: number"]),
    ))
    a += b"".join(field(2, o) for o in (
        occurrence(box, [0, 6, 9], 1, [0, 0, 20, 1]), occurrence(run, [300, 2, 5], 1, [4, 0, 300, 3]), occurrence(shape, [30, 1, 6], 1), occurrence(helper, [7, 1, 4]), occurrence(helper, [2, 1, 4], 2), occurrence(shape, [0, 20, 25]), occurrence(run, [5, 1, 3]), occurrence("gone", [6, 1, 2]),
    ))
    b = field(1, "b.ts") + field(3, symbol(helper)) + field(2, occurrence(helper, [0, 1, 2, 3, 4], 1))
    meta = field(1, field(2, field(1, "tool"))) + varint(15 << 3 | 1) + bytes(8) + varint(16 << 3 | 5) + bytes(4)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "index.scip").write_bytes(meta + field(2, a) + field(2, b) + field(3, symbol("outer")))
    return tmp_path


def test_scip_index_to_graph(spark, index):
    docs = scip.read(spark, str(index))
    assert sorted((r["path"], r["language"]) for r in docs.collect()) == [("a.ts", "TypeScript"), ("b.ts", "")]
    nodes, edges = scip.code_graph(scip.symbols(docs), scip.occurrences(docs))
    got = {r["id"]: (r["start_line"], r["end_line"], r["signature"]) for r in nodes.collect()}
    assert got == {"a.ts:class:Box": (1, 21, None), "a.ts:function:run": (301, 301, "run"), "a.ts:interface:Shape": (31, 31, None), "b.ts:function:helper": (1, 3, None)}
    assert {(r["from_node"], r["to_node"], r["edge_type"]) for r in edges.collect()} == {
        ("a.ts:class:Box", "a.ts:interface:Shape", "implements"), ("a.ts:class:Box", "b.ts:function:helper", "references"), ("a.ts:class:Box", "b.ts:function:helper", "calls"), ("a.ts:class:Box", "b.ts:function:helper", "imports"),
        ("a.ts:class:Box", "a.ts:interface:Shape", "calls"), ("a.ts:class:Box", "a.ts:function:run", "calls"),
    }


def test_scip_bad_and_no_files(spark, tmp_path):
    (tmp_path / "bad.scip").write_bytes(field(2, "x" * 50)[:20])
    with pytest.raises(Exception, match=r"bad\.scip is no SCIP index"):
        scip.read(spark, str(tmp_path)).collect()
    (tmp_path / "none").mkdir()
    assert scip.read(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "none" / "empty.scip").write_bytes(b"")
    assert scip.read(spark, str(tmp_path / "none")).where(F.col("path").isNotNull()).count() == 0
