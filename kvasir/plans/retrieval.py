"""Queries over retrieval (R1-R13), chunking (T1-T5), code graphs (G18, G19), sources (S4-S7, C1) and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from kvasir.functions import text as t
from kvasir.operators import chunking as c
from kvasir.operators import relational as r
from kvasir.operators import retrieval as x
from kvasir.operators import vectors as v
from kvasir.plans.registry import query
from kvasir.plans.relational import more
from kvasir.plans.scoring import r6
from kvasir.sources import adapters as a
from kvasir.sources import files as s
from kvasir.sources.adapters import with_
from kvasir.streaming import jobs
from kvasir.session import shared_dir

_TOK = "CAST(length(content) AS BIGINT) // 4"


def _candidates(spark, d):
    """Twelve memories a query by type, spread over the sources."""
    k = F.substring("id", 5, 20).cast("long")
    m = a.memories(spark, d).where("length(content) > 0").withColumn("query_id", k % 25).withColumn("relevance", F.round(F.col("importance") * (F.lit(1.0) - (k % 7).cast("double") / 20), 6))
    top = v.top_k(m, ["query_id"], 12, F.desc("relevance"), F.asc("id")).drop("rank")
    terms = F.array(F.lower(F.col("tags")[0]), F.lower(F.col("tags")[1]), F.col("type"))
    shares = [F.lit(y).alias(n) for n, y in zip(x.SOURCES, t.ROUTES["hybrid"][:3], strict=True)]
    return top.select("query_id", "id", a.pick(k % 3, list(x.SOURCES)).alias("source"), "relevance", terms.alias("terms"), F.lit("hybrid").alias("route"), *shares, "title", "content", (F.length("content") / 4).cast("long").alias("tokens"))


@query("rerank")
def _(spark, d):
    return x.rerank(_candidates(spark, d).drop("title", "content", "tokens"))


def _chosen(spark, d):
    cand = _candidates(spark, d)
    ranked = x.rerank(cand.drop("title", "content", "tokens")).join(cand.select("query_id", "id", "relevance", "title", "content", "tokens"), ["query_id", "id"])
    return x.within_budget(ranked, 3800)


@query("select_within_budget")
def _(spark, d):
    w = Window.partitionBy("query_id").orderBy(*x.section_order())
    return _chosen(spark, d).where("included").withColumn("place", F.row_number().over(w).cast("long")).select("query_id", "place", "id", "source", "tokens")


@query("evidence")
def _(spark, d):
    reason = F.when(F.col("included"), F.concat(F.lit("selected at rank "), F.col("rank").cast("string"))).otherwise("over budget")
    return _chosen(spark, d).select("query_id", "id", "rank", "score", "included", reason.alias("reason"))


@query("context_markdown")
def _(spark, d):
    return x.markdown(_chosen(spark, d).where("included").withColumn("query", F.concat(F.lit("query "), F.col("query_id").cast("string"))))


_MD = "'**' || title || '** (' || type || ')' || chr(10) || CASE WHEN length(content) > 300 THEN content[1:300] || '...' ELSE content END || chr(10) || '*Tags: ' || array_to_string(tags, ', ') || ' | Importance: ' || CAST(floor(importance * 100 + 0.5) AS BIGINT) || '%*'"


@query("rag_sections", with_("memories", f"SELECT id, {_MD} AS section FROM memories WHERE type = 'note'"))
def _(spark, d):
    return a.memories(spark, d).where("type = 'note'").select("id", x.format_memory().alias("section"))


@query("kag_sections", with_("code_nodes code_edges", "SELECT n.id, count(*) FILTER (edge_type = 'calls') AS calls, count(*) FILTER (edge_type = 'implements') AS implementations, CAST(CASE WHEN count(*) FILTER (edge_type = 'calls') > 0 THEN 0.8 WHEN count(*) FILTER (edge_type = 'implements') > 0 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS relevance FROM code_nodes n JOIN code_edges e ON e.from_node = n.id WHERE n.type <> 'module' GROUP BY n.id"))
def _(spark, d):
    n = a.code_nodes(spark, d).where("type <> 'module'").select("id")
    g = a.code_edges(spark, d).join(n, F.col("from_node") == F.col("id")).groupBy("id").agg(F.count_if(F.col("edge_type") == "calls").alias("calls"), F.count_if(F.col("edge_type") == "implements").alias("implementations"))
    return g.withColumn("relevance", F.when(F.col("calls") > 0, 0.8).when(F.col("implementations") > 0, 0.7).otherwise(0.5))


@query("graphrag_sections", with_("entities code_edges entity_relationships entity_memories", "SELECT e.entity_id, coalesce(string_agg(DISTINCT r.other, ',' ORDER BY r.other) FILTER (r.k <= 8), '') AS related, count(DISTINCT m.memory_id) AS memories FROM (SELECT * FROM entities WHERE mentions >= 20) e LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY strength DESC, other) AS k FROM (SELECT source AS id, target AS other, strength FROM entity_relationships UNION ALL SELECT target, source, strength FROM entity_relationships)) r ON r.id = e.entity_id LEFT JOIN entity_memories m ON m.entity_id = e.entity_id GROUP BY e.entity_id"))
def _(spark, d):
    e = a.entities(spark, d).where("mentions >= 20").select("entity_id")
    rel = a.entity_relationships(spark, d)
    both = rel.select(F.col("source").alias("entity_id"), F.col("target").alias("other"), "strength").union(rel.select("target", "source", "strength"))
    near = v.top_k(both, ["entity_id"], 8, F.desc("strength"), F.asc("other")).groupBy("entity_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("other"))).alias("related"))
    mem = a.entity_memories(spark, d).groupBy("entity_id").agg(F.countDistinct("memory_id").alias("memories"))
    return e.join(near, "entity_id", "left").join(mem, "entity_id", "left").select("entity_id", F.coalesce("related", F.lit("")).alias("related"), F.coalesce("memories", F.lit(0)).alias("memories"))


_HINTS, _TERMS = ["brand#12", "small", "eco"], ["standard", "eco"]


def _hint_sql():
    out, low = [], "lower(file_path)"
    for h in _HINTS:
        name = f"(n = '{h}' OR starts_with(n, '{h}.') OR starts_with(n, '{h}-') OR starts_with(n, '{h}_'))"
        part = f"(contains({low}, '/{h}/') OR contains({low}, '/{h}.') OR ends_with({low}, '/{h}'))"
        out.append((f"CASE WHEN {name} THEN {max(10, min(20, len(h) + 7))} WHEN {part} THEN {max(8, min(18, len(h) + 5))} WHEN contains({low}, '{h}') THEN {max(3, min(10, len(h) // 2))} ELSE 0 END", len(h)))
    score = " + ".join(p for p, _ in out)
    hits = " + ".join(f"CASE WHEN ({p}) > 0 THEN 1 ELSE 0 END" for p, _ in out)
    longest = "greatest(" + ", ".join(f"CASE WHEN ({p}) > 0 THEN {n} ELSE 0 END" for p, n in out) + ")"
    terms = " + ".join(f"CASE WHEN contains({low}, '{w}') THEN 1 ELSE 0 END" for w in _TERMS if len(w) >= 4)
    return f"SELECT file_path, CAST({hits} AS BIGINT) AS hint_matches, round(CAST({score} AS DOUBLE) + 2.5 * ({terms}) + least(3.0::DOUBLE, node_count * 0.1) + least(4.0::DOUBLE, {longest} * 0.15), 6) AS score FROM p WHERE ({hits}) > 0"


@query("file_lookup", more("code_nodes", f"p AS (SELECT file_path, lower(string_split(file_path, '/')[-1]) AS n, count(*) AS node_count FROM code_nodes GROUP BY file_path) {_hint_sql()}"))
def _(spark, d):
    p = a.code_nodes(spark, d).where(r.lookup_path(F.col("file_path"))).groupBy("file_path").agg(F.count(F.lit(1)).alias("node_count"))
    return x.hint_scores(p, _HINTS, _TERMS).select("file_path", "hint_matches", "score")


@query("context_cache", "SELECT user_id, count(*) AS requests, count(*) FILTER (gap <= 300) AS hits FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) / 1e6 AS gap FROM events) GROUP BY user_id")
def _(spark, d):
    """Hits of a cache whose entries live 300 seconds, by user, over the event log."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (us - F.lag(us).over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))) / 1e6
    return a.read(spark, d, "events").withColumn("gap", gap).groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("gap") <= 300).alias("hits"))


# --- chunking ----------------------------------------------------------------------------------------

@query("chunk_markdown")
def _(spark, d):
    """Each document under a heading of its language, in sections of at most 64 tokens."""
    docs = a.read(spark, d, "documents").select("doc_id", F.concat(F.lit("# "), F.coalesce("lang", F.lit("?")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("m"))
    return c.markdown_chunks(docs, "doc_id", "m", 64)


@query("chunk_documents_as_markdown")
def _(spark, d):
    return c.markdown_sections(a.read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "section", "start_line", "end_line", F.length("content").alias("size"))


@query("chunk_code_fallback")
def _(spark, d):
    return c.pack_lines(a.read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", 512).select("doc_id", "chunk", "start_line", "end_line", "tokens")


_RANGES = "rg AS (SELECT l_orderkey % 500 AS doc, 's' || l_linenumber || '_' || l_partkey AS symbol, l_partkey % 100 AS b, l_partkey % 100 + l_suppkey % 40 AS e FROM lineitem), oc AS (SELECT DISTINCT o_orderkey % 500 AS doc, o_orderkey AS occ, o_custkey % 140 AS line FROM orders)"


@query("scip_enclosing", f"WITH {_RANGES} SELECT doc, occ, line, symbol FROM (SELECT oc.*, symbol, row_number() OVER (PARTITION BY oc.doc, occ ORDER BY e - b, symbol) AS k FROM oc JOIN rg ON rg.doc = oc.doc AND line BETWEEN b AND e) WHERE k = 1")
def _(spark, d):
    """Occurrences to the innermost symbol around them."""
    line = a.read(spark, d, "lineitem")
    ranges = line.select((F.col("l_orderkey") % 500).alias("doc"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string")).alias("symbol"), (F.col("l_partkey") % 100).alias("begin"), (F.col("l_partkey") % 100 + F.col("l_suppkey") % 40).alias("end"))
    occ = a.read(spark, d, "orders").select((F.col("o_orderkey") % 500).alias("doc"), F.col("o_orderkey").alias("occ"), (F.col("o_custkey") % 140).alias("line")).distinct()
    return c.innermost(occ, ranges)


# --- sources -----------------------------------------------------------------------------------------

@query("file_discovery")
def _(spark, d):
    return s.discover(spark, d, ("parquet",)).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


@query("hash_embedding")
def _(spark, d):
    return a.read(spark, d, "documents").select("doc_id", s.hash_embedder(16)("text").alias("embedding"))


# --- streams, run to the end of what is there -----------------------------------------------------------


def _events(spark, d):
    schema = a.read(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("variant_id"), F.col("value").cast("double").alias("latency_ms"), "user_id", "event_id")


def _run(spark, stream, mode):
    """The stream's whole result: a batch's rows are written under its number, so one that is done again replaces itself."""
    path = f"{shared_dir(spark)}/kvasir-stream-{uuid.uuid4().hex}"
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{path}/rows")
    if mode == "complete":  # each batch has all rows
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch", "left_semi")  # one row
    return rows.drop("batch")


@query("stream_metric_windows", "SELECT CAST(date_trunc('day', ts) AS VARCHAR)[1:10] AS day, event_type AS variant_id, count(*) AS samples, round(avg(value), 6) AS avg_latency, round(max(value), 6) AS max_latency FROM events GROUP BY 1, 2")
def _(spark, d):
    out = _run(spark, jobs.metrics_by_window(_events(spark, d)), "complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "variant_id", "samples", "avg_latency", "max_latency")


@query("stream_cache_misses", """WITH RECURSIVE m(user_id, ts) AS (SELECT user_id, min(ts) FROM events GROUP BY 1 UNION ALL SELECT m.user_id, min(e.ts) FROM m JOIN events e ON e.user_id = m.user_id AND e.ts >= m.ts + INTERVAL 5 MINUTE GROUP BY m.user_id, m.ts)
SELECT user_id, epoch_us(ts) AS ts_us FROM m""")
def _(spark, d):
    return _run(spark, jobs.cache_misses(_events(spark, d), "user_id"), "append").select("user_id", F.unix_micros("ts").alias("ts_us"))


@query("stream_debounce")
def _(spark, d):
    e = _events(spark, d).select("ts", F.col("variant_id").alias("path"))
    return _run(spark, jobs.sessions(e, "10 minutes"), "append")
