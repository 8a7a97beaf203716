"""Sources, sinks, the catalog, the embedding cache and the streaming jobs."""

import json

from pyspark.sql import functions as F

from kvasir.operators import relational
from kvasir.sources import files
from kvasir.streaming import jobs


def test_discovery_and_contents(spark, tmp_path):
    for name in ("src/a.ts", "src/b.py", "node_modules/x.ts", "src/c.d.ts", "README.md"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"// {name}")
    found = {r["path"].rsplit("/", 2)[-2] + "/" + r["path"].rsplit("/", 1)[-1] for r in files.discover(spark, str(tmp_path)).collect()}
    assert found == {"src/a.ts", "src/b.py"}
    assert files.read_markdown(spark, str(tmp_path)).first()["content"] == "// README.md"
    assert files.contents(spark, str(tmp_path / "src"), ("py",)).first()["content"] == "// src/b.py"


def test_history_and_export(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"unixMs": 2, "p50": 1.5}\nnot json\n{"unixMs": 1, "p50": 2.5}\n')
    rows = files.read_history(spark, str(tmp_path / "h.jsonl"), "unixMs long, p50 double").collect()
    assert [r["unixMs"] for r in rows] == [1, 2]
    files.export_json({"memories": spark.range(3)}, str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out/memories").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(x["id"] for x in lines) == [0, 1, 2]


def test_catalog(spark, tmp_path):
    c = files.Catalog(spark, str(tmp_path / "c"))
    rows = lambda *r: spark.createDataFrame(r, "k long, v string")
    c.upsert("t", rows((1, "a"), (2, "b")), ["k"])
    c.upsert("t", rows((2, "B"), (3, "c")), ["k"])
    c.delete("t", rows((1, "")).select("k"))
    assert {(r["k"], r["v"]) for r in c.table("t").collect()} == {(2, "B"), (3, "c")}
    # Opened again, the table is there, and a change adds to it.
    again = files.Catalog(spark, str(tmp_path / "c"))
    again.upsert("t", rows((4, "d")), ["k"])
    assert c.table("t").count() == 3


def test_restore_conflicts(spark):
    rows = lambda *r: spark.createDataFrame(r, "k long, v string")
    old, new = rows((1, "a"), (2, "b")), rows((2, "B"), (3, "c"))
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(relational.restore(old, new, "k", "skip")) == {(1, "a"), (2, "b"), (3, "c")}
    assert as_set(relational.restore(old, new, "k", "overwrite")) == {(1, "a"), (2, "B"), (3, "c")}
    assert as_set(relational.restore(old, new, "k", "error")) == {(2, "B")}


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("one two",), ("three",), ("three",)], "content string")
    cached = texts.where("content = 'three'").dropDuplicates().select(F.sha2("content", 256).alias("content_hash"), F.lit("m").alias("model"), F.array(F.lit(9.0).cast("float")).alias("embedding"))
    out = files.embed_missing(texts, cached, files.hash_embedder(8), "m").collect()
    assert len(out) == 2 and sorted(len(r["embedding"]) for r in out) == [1, 8]
    v = next(r["embedding"] for r in out if len(r["embedding"]) == 8)
    assert abs(sum(x * x for x in v) - 1) < 1e-6


def test_stream_windows_and_late_rows(spark, tmp_path):
    def put(n, rows):
        spark.createDataFrame(rows, "at string, variant_id string, latency_ms double").select(F.to_timestamp("at").alias("ts"), "variant_id", "latency_ms").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))

    put(1, [("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 11:00:00", "a", 3.0)])
    put(2, [("2024-01-03 00:00:00", "a", 5.0)])
    put(3, [("2024-01-03 01:00:00", "a", 5.0)])
    put(4, [("2024-01-01 12:00:00", "a", 9.0), ("2024-01-05 00:00:00", "b", 1.0)])
    schema = spark.read.parquet(str(tmp_path / "in/1")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = jobs.metrics_by_window(stream).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = {str(r["window_start"])[:10]: (r["samples"], r["avg_latency"]) for r in spark.table("late").collect()}
    assert out["2024-01-01"] == (2, 2.0)  # the late sample came after the watermark


def test_incremental_scan(spark, tmp_path):
    c = files.Catalog(spark, str(tmp_path / "c"))
    scan = jobs.incremental_scan(c)
    rows = lambda *r: spark.createDataFrame(r, "path string, hash string")
    scan(rows(("a", "1"), ("b", "1")), 0)
    scan(rows(("a", "2"), ("c", "1")), 1)
    got = {(r["batch"], r["path"], r["change"]) for r in c.table("file_hashes_changes").collect()}
    assert got == {(0, "a", "added"), (0, "b", "added"), (1, "a", "modified"), (1, "b", "deleted"), (1, "c", "added")}
    assert {(r["path"], r["hash"]) for r in c.table("file_hashes").collect()} == {("a", "2"), ("c", "1")}
