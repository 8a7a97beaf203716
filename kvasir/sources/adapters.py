"""Adapter views: the plain tables seen as memories, code graph, relations, metrics and commits.

Each adapter is a DataFrame function; ``SQL`` has the same view as a DuckDB common table expression.
A memory's title is its text's first sentence. Memory time stamps are relative to NOW, so no result depends on the clock.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1704067200  # 2024-01-01 UTC, in seconds


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(key: Column, values: list) -> Column:
    """The key-th of the values (the last for any other key)."""
    head = reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), list(enumerate(values[:-1]))[1:], F.when(key == 0, F.lit(values[0])))
    return head.otherwise(F.lit(values[-1]))


def memory_id(key: Column) -> Column:
    return F.concat(F.lit("mem_"), key.cast("string"))


def memories(spark: SparkSession, sf_dir: str, ids: list[str] | None = None) -> DataFrame:
    """All memories, or those of ``ids``, which are looked up by the stored key so that the scans are filtered."""
    d, q = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    if ids is not None:
        keys = [int(i[4:]) for i in ids if re.fullmatch("mem_(0|[1-9][0-9]{0,17})", i)]
        d, q = d.where(F.col("doc_id").isin(keys)), q.where(F.col("doc_id").isin(keys))
    k = F.col("doc_id")
    day = lambda n, per: (F.lit(NOW) - (k % n) * per).cast("long")
    return d.join(q, "doc_id", "left").select(
        memory_id(k).alias("id"),
        pick(k % 5, ["decision", "solution", "pattern", "architecture", "note"]).alias("type"),
        F.regexp_extract("text", r"^[^.\n]*", 0).alias("title"),
        F.col("text").alias("content"),
        F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.3).otherwise(0.5).alias("importance"),
        F.array("lang", "source").alias("tags"),
        F.array(F.format_string("src/%s/f%s.ts", "source", (k % 17).cast("string")), F.format_string("src/%s/g%s.ts", "lang", (k % 5).cast("string"))).alias("related_files"),
        day(400, 86400).alias("created_at"),
        day(400, 43200).alias("accessed_at"),
        (F.col("n_chars") % 120).cast("long").alias("access_count"),
        (k % 11 == 0).alias("needs_review"),
        F.when(k % 13 == 0, 0.0).when(k % 7 == 0, 2.0).alias("decay_rate"),
        F.when(k % 9 == 0, day(60, 86400)).alias("last_refreshed_at"),
    )


def code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
        pick(F.col("p_size") % 4, ["function", "class", "interface", "module"]).alias("type"),
        F.col("p_name").alias("name"),
        F.concat_ws("/", F.lit("src"), "p_brand", F.concat("p_type", F.lit(".ts"))).alias("file_path"),
    )


#: Lines that a task joins to edges.
LINES_A_TASK = 1_000_000


def dealt(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """The table by ``key`` in tasks of about LINES_A_TASK of its ``rows``, where the session's number would make them larger."""
    tasks = 1 + rows // LINES_A_TASK
    return df.repartition(tasks, *key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in an order; made distinct as numbers, which are smaller than their names.

    The tasks grow with the lines (which the files' footers count), where the session's number would make them large.
    """
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    rows = line.count()
    nxt = line.select("l_orderkey", F.col("l_partkey").alias("to_part"), (F.col("l_linenumber") - 1).alias("l_linenumber"))
    node = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    k = F.col("l_linenumber") % 4
    on = ["l_orderkey", "l_linenumber"]
    pairs = dealt(line, rows, *on).join(dealt(nxt, rows, *on), on).where("l_partkey <> to_part").select("l_partkey", "to_part", F.when(k.isin(0, 1, 2), k).otherwise(3).alias("kind"))
    pairs = dealt(pairs, rows, "l_partkey", "to_part", "kind").distinct()
    return pairs.select(node("l_partkey").alias("from_node"), node("to_part").alias("to_node"), pick(F.col("kind"), ["calls", "imports", "implements", "extends"]).alias("edge_type"))


def memory_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id")
    n = d.agg(F.count(F.lit(1)).alias("n"))  # one row
    k = F.explode(F.array(F.lit(1), F.lit(2))).alias("k")
    target = (F.col("doc_id") * 3 + 7 * F.col("k")) % F.col("n")
    return (
        d.select("doc_id", k)
        .crossJoin(F.broadcast(n))
        .where((F.col("doc_id") % 3 != 0) & (target != F.col("doc_id")))
        .select(
            memory_id(F.col("doc_id")).alias("source_id"),
            memory_id(target).alias("target_id"),
            pick((F.col("doc_id") + F.col("k")) % 6, ["references", "implements", "extends", "related_to", "supersedes", "requires"]).alias("type"),
            ((F.col("doc_id") % 10 + F.col("k")).cast("double") / 12).alias("weight"),
        )
    )


def ab_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.lit("exp1").alias("experiment_id"),
        F.col("event_type").alias("variant_id"),
        F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 16).alias("session_hash"),
        F.col("value").cast("double").alias("latency_ms"),
        (F.col("event_id") % 20).cast("long").alias("result_count"),
        F.when(F.col("event_id") % 10 != 0, (F.col("event_id") % 100).cast("double") / 100).alias("top_score"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    brand = F.substring("p_brand", 7, 10)
    owner = F.col("o_custkey") % 100 < brand.cast("int") * 4
    return (
        o.join(line, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(p, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_orderkey").alias("commit_id"),
            F.when(owner, F.concat(F.lit("owner"), brand, F.lit("@example.com"))).otherwise(F.concat(F.lit("dev"), (F.col("o_custkey") % 23).cast("string"), F.lit("@example.com"))).alias("author_email"),
            F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts_s"),
            F.concat(F.lit("src/"), F.col("p_brand")).alias("dir"),
            F.concat_ws("/", F.lit("src"), "p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit(".ts"))).alias("file"),
        )
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as entities: mentions are their order lines."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("mentions"))
    kinds = ["PERSON", "ORGANIZATION", "TECHNOLOGY", "CONCEPT", "LOCATION", "EVENT", "PRODUCT", "OTHER"]
    return p.join(lines, "p_partkey", "left").select(
        F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("entity_id"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("name"),
        pick(F.col("p_size") % 8, kinds).alias("entity_type"),
        F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions"),
        ((F.col("p_size") % 10).cast("double") / 10).alias("confidence"),
    )


def entity_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that follow each other in an order, with a strength of 2 and the number of times, 10 at most."""
    e = code_edges(spark, sf_dir)
    a, b = F.expr("cast(substring(from_node, 2) as bigint)"), F.expr("cast(substring(to_node, 2) as bigint)")
    pair = e.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    node = lambda c: F.concat(F.lit("e"), F.col(c).cast("string"))
    return pair.select(node("x").alias("source"), node("y").alias("target"), F.lit("related_to").alias("rel_type"), F.least(F.lit(10), F.col("n") * 3 + F.col("x") % 6).cast("long").alias("strength"))


def entity_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity p and memory d are linked when an order line says so: part p in order d (modulo the memories)."""
    n = read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    line = read(spark, sf_dir, "lineitem")
    return (
        line.crossJoin(F.broadcast(n))
        .select("l_partkey", (F.col("l_orderkey") % F.col("n")).alias("doc"))
        .distinct()
        .select(F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("entity_id"), memory_id(F.col("doc")).alias("memory_id"))
    )


#: The adapters as DuckDB common table expressions.
SQL = {
    "memories": f"""memories AS (SELECT 'mem_' || d.doc_id AS id, d.doc_id,
  CASE d.doc_id % 5 WHEN 0 THEN 'decision' WHEN 1 THEN 'solution' WHEN 2 THEN 'pattern' WHEN 3 THEN 'architecture' ELSE 'note' END AS type,
  regexp_extract(d.text, '^[^.\\n]*') AS title, d.text AS content, CAST(CASE WHEN l.quality = 1 THEN 0.9 WHEN l.quality = 0 THEN 0.3 ELSE 0.5 END AS DOUBLE) AS importance,
  [d.lang, d.source] AS tags, ['src/' || d.source || '/f' || (d.doc_id % 17) || '.ts', 'src/' || d.lang || '/g' || (d.doc_id % 5) || '.ts'] AS related_files,
  CAST({NOW} - (d.doc_id % 400) * 86400 AS BIGINT) AS created_at, CAST({NOW} - (d.doc_id % 400) * 43200 AS BIGINT) AS accessed_at, CAST(d.n_chars % 120 AS BIGINT) AS access_count,
  d.doc_id % 11 = 0 AS needs_review, CAST(CASE WHEN d.doc_id % 13 = 0 THEN 0 WHEN d.doc_id % 7 = 0 THEN 2 END AS DOUBLE) AS decay_rate,
  CASE WHEN d.doc_id % 9 = 0 THEN CAST({NOW} - (d.doc_id % 60) * 86400 AS BIGINT) END AS last_refreshed_at
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "code_nodes": """code_nodes AS (SELECT 'p' || p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'interface' ELSE 'module' END AS type,
  p_name AS name, 'src/' || p_brand || '/' || p_type || '.ts' AS file_path FROM part)""",
    "code_edges": """code_edges AS (SELECT DISTINCT 'p' || a.l_partkey AS from_node, 'p' || b.l_partkey AS to_node,
  CASE a.l_linenumber % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'imports' WHEN 2 THEN 'implements' ELSE 'extends' END AS edge_type
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)""",
    "memory_relations": """memory_relations AS (SELECT 'mem_' || d.doc_id AS source_id, 'mem_' || ((d.doc_id * 3 + 7 * v.k) % n.n) AS target_id,
  CASE (d.doc_id + v.k) % 6 WHEN 0 THEN 'references' WHEN 1 THEN 'implements' WHEN 2 THEN 'extends' WHEN 3 THEN 'related_to' WHEN 4 THEN 'supersedes' ELSE 'requires' END AS type,
  CAST(d.doc_id % 10 + v.k AS DOUBLE) / 12 AS weight
  FROM documents d CROSS JOIN (SELECT count(*) AS n FROM documents) n CROSS JOIN (VALUES (1), (2)) v(k) WHERE d.doc_id % 3 <> 0 AND (d.doc_id * 3 + 7 * v.k) % n.n <> d.doc_id)""",
    "ab_metrics": """ab_metrics AS (SELECT 'exp1' AS experiment_id, event_type AS variant_id, substring(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS session_hash, CAST(value AS DOUBLE) AS latency_ms,
  CAST(event_id % 20 AS BIGINT) AS result_count, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) / 100 END AS top_score, epoch_us(ts) AS ts_us FROM events)""",
    "commits": """commits AS (SELECT o.o_orderkey AS commit_id,
  CASE WHEN o.o_custkey % 100 < CAST(substring(p.p_brand, 7) AS INT) * 4 THEN 'owner' || substring(p.p_brand, 7) || '@example.com' ELSE 'dev' || (o.o_custkey % 23) || '@example.com' END AS author_email,
  CAST(epoch(o.o_orderdate) AS BIGINT) AS ts_s, 'src/' || p.p_brand AS dir, 'src/' || p.p_brand || '/' || p.p_partkey || '.ts' AS file
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey)""",
    "entities": """entities AS (SELECT 'e' || p.p_partkey AS entity_id, p.p_name || ' ' || p.p_partkey AS name,
  CASE p.p_size % 8 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORGANIZATION' WHEN 2 THEN 'TECHNOLOGY' WHEN 3 THEN 'CONCEPT' WHEN 4 THEN 'LOCATION' WHEN 5 THEN 'EVENT' WHEN 6 THEN 'PRODUCT' ELSE 'OTHER' END AS entity_type,
  CAST(coalesce(n.n, 0) AS BIGINT) AS mentions, CAST(p.p_size % 10 AS DOUBLE) / 10 AS confidence
  FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) n ON n.l_partkey = p.p_partkey)""",
    "entity_relationships": """entity_relationships AS (SELECT 'e' || x AS source, 'e' || y AS target, 'related_to' AS rel_type, CAST(least(10, n * 3 + x % 6) AS BIGINT) AS strength
  FROM (SELECT least(CAST(from_node[2:] AS BIGINT), CAST(to_node[2:] AS BIGINT)) AS x, greatest(CAST(from_node[2:] AS BIGINT), CAST(to_node[2:] AS BIGINT)) AS y, count(*) AS n FROM code_edges GROUP BY 1, 2))""",
    "entity_memories": """entity_memories AS (SELECT DISTINCT 'e' || l_partkey AS entity_id, 'mem_' || (l_orderkey % n.n) AS memory_id FROM lineitem CROSS JOIN (SELECT count(*) AS n FROM documents) n)""",
}


def with_(names: str, body: str) -> str:
    """The query ``body`` over the named adapters; entity_relationships needs code_edges before it."""
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body
