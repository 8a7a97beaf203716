"""Queries over aggregations (A1-A28) and git analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kvasir.operators import metrics as m
from kvasir.operators import vectors as v
from kvasir.plans.registry import query
from kvasir.plans.relational import more
from kvasir.plans.scoring import r6
from kvasir.sources import adapters as a
from kvasir.sources.adapters import with_

AB, C = "ab_metrics", "commits"
RECENT = 900000000


@query("ab_metrics", with_(AB, "SELECT variant_id, count(*) AS samples, round(avg(latency_ms), 6) AS avg_latency, round(avg(result_count), 6) AS avg_results, round(coalesce(avg(top_score), 0), 6) AS avg_top_score, min(ts_us) AS first_us, max(ts_us) AS last_us FROM ab_metrics WHERE ts_us >= 1704500000000000 GROUP BY variant_id"))
def _(spark, d):
    s = a.ab_metrics(spark, d).where("ts_us >= 1704500000000000")
    return s.groupBy("variant_id").agg(F.count(F.lit(1)).alias("samples"), r6(F.avg("latency_ms"), "avg_latency"), r6(F.avg("result_count"), "avg_results"), r6(F.coalesce(F.avg("top_score"), F.lit(0.0)), "avg_top_score"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def _qs(p):
    i = f"round(n * {p}::DOUBLE, 9)"
    return f"round(CASE WHEN {i} <> floor({i}) THEN xs[CAST(least(n, ceil({i})) AS INT)] WHEN n % 2 = 0 THEN (xs[CAST(greatest(1, {i}) AS INT)] + xs[CAST(least(n, {i} + 1) AS INT)]) / 2 ELSE xs[CAST(least(n, {i} + 1) AS INT)] END, 6)"


@query("latency_percentiles", with_(AB, f"SELECT variant_id, {_qs(0.5)} AS p50, {_qs(0.95)} AS p95, {_qs(0.99)} AS p99 FROM (SELECT variant_id, count(*) AS n, list_sort(list(latency_ms)) AS xs FROM ab_metrics GROUP BY variant_id)"))
def _(spark, d):
    p = m.quantile_sorted(a.ab_metrics(spark, d), ["variant_id"], "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return p.select("variant_id", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


_NR = "xs[CAST(greatest(1, ceil({p} / 100.0::DOUBLE * n)) AS INT)]"


@query("nearest_rank_percentile", with_(AB, f"SELECT session_hash, round({_NR.format(p=50)}, 6) AS p50, round({_NR.format(p=90)}, 6) AS p90 FROM (SELECT session_hash, count(*) AS n, list_sort(list(latency_ms)) AS xs FROM ab_metrics GROUP BY session_hash)"))
def _(spark, d):
    p = m.nearest_rank(a.ab_metrics(spark, d), ["session_hash"], "latency_ms", {"p50": 50, "p90": 90})
    return p.select("session_hash", r6(F.col("p50"), "p50"), r6(F.col("p90"), "p90"))


_LS = ", ".join(["round(min(latency_ms), 2) AS min", "round(max(latency_ms), 2) AS max", "round(avg(latency_ms), 2) AS avg"] + [f"round({_NR.format(p=p).replace('xs', 'list_sort(list(latency_ms))').replace('n)', 'count(*))')}, 2) AS p{p}" for p in (50, 95, 99)])


@query("latency_summary_by_route", with_(AB, f"SELECT variant_id, {_LS} FROM ab_metrics GROUP BY variant_id"))
def _(spark, d):
    return m.latency_summary(a.ab_metrics(spark, d), ["variant_id"], "latency_ms")


@query("latency_summary_overall", with_(AB, f"SELECT {_LS} FROM ab_metrics"))
def _(spark, d):
    return m.latency_summary(a.ab_metrics(spark, d).withColumn("every", F.lit(1)), ["every"], "latency_ms").drop("every")


@query("graph_counts", with_("code_nodes code_edges", "SELECT 'nodes' AS what, type AS kind, count(*) AS n FROM code_nodes GROUP BY type UNION ALL SELECT 'edges', edge_type, count(*) FROM code_edges GROUP BY edge_type UNION ALL SELECT 'nodes', 'total', count(*) FROM code_nodes UNION ALL SELECT 'edges', 'total', count(*) FROM code_edges"))
def _(spark, d):
    def count(df, what, by):
        g = df.rollup(by).agg(F.count(F.lit(1)).alias("n"))
        return g.select(F.lit(what).alias("what"), F.coalesce(by, F.lit("total")).alias("kind"), "n")

    return count(a.code_nodes(spark, d), "nodes", "type").union(count(a.code_edges(spark, d), "edges", "edge_type"))


@query("entity_type_distribution", with_("entities", "SELECT entity_type, count(*) AS n FROM entities GROUP BY entity_type"))
def _(spark, d):
    return a.entities(spark, d).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity_type")


@query("graphrag_stats", with_("entities code_edges entity_relationships entity_memories", "SELECT 'entities' AS name, count(*) AS n FROM entities UNION ALL SELECT 'relationships', count(*) FROM entity_relationships UNION ALL SELECT 'links', count(*) FROM entity_memories UNION ALL SELECT 'memories', count(DISTINCT memory_id) FROM entity_memories"))
def _(spark, d):
    one = lambda df, name, n=F.count(F.lit(1)): df.agg(n.alias("n")).select(F.lit(name).alias("name"), "n")
    links = a.entity_memories(spark, d)
    return one(a.entities(spark, d), "entities").union(one(a.entity_relationships(spark, d), "relationships")).union(one(links, "links")).union(one(links, "memories", F.countDistinct("memory_id")))


@query("top_entities", with_("entities code_edges entity_relationships", "SELECT entity_id, name, mentions, coalesce(degree, 0) AS degree FROM entities LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM entity_relationships UNION ALL SELECT target FROM entity_relationships) GROUP BY id) g ON g.id = entity_id ORDER BY mentions DESC, entity_id LIMIT 20"))
def _(spark, d):
    rel = a.entity_relationships(spark, d)
    degree = rel.select(F.explode(F.array("source", "target")).alias("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"))
    top = a.entities(spark, d).orderBy(F.desc("mentions"), "entity_id").limit(20)
    return top.join(degree, "entity_id", "left").select("entity_id", "name", "mentions", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("tag_category_counts", "SELECT CASE WHEN starts_with(tag, 'src') THEN 'source' ELSE 'language' END AS category, count(DISTINCT tag) AS tags, count(*) AS uses FROM (SELECT unnest([lang, source]) AS tag FROM documents) GROUP BY 1")
def _(spark, d):
    t = a.read(spark, d, "documents").select(F.explode(F.array("lang", "source")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy(F.when(F.startswith("tag", F.lit("src")), "source").otherwise("language").alias("category")).agg(F.count(F.lit(1)).alias("tags"), F.sum("n").alias("uses"))


_EX = "ex AS (SELECT *, CAST(floor(100.0::DOUBLE * touches / sum(touches) OVER (PARTITION BY dir) + 0.5) AS BIGINT) AS pct, row_number() OVER (PARTITION BY dir ORDER BY touches DESC, author_email) AS rank FROM (SELECT dir, author_email, count(*) AS touches, max(ts_s) AS last_commit FROM commits GROUP BY ALL))"
_BF = "bf AS (SELECT dir, greatest(1, count(*) FILTER (pct >= 5)) AS bus_factor, max(pct) AS top_pct, max(pct) >= 80 AS risky, max(last_commit) AS last_commit FROM ex GROUP BY dir)"


@query("expertise_per_dir", more(C, f"{_EX} SELECT * FROM ex"))
def _(spark, d):
    return m.expertise(a.commits(spark, d))


@query("bus_factor", more(C, f"{_EX}, {_BF} SELECT * FROM bf"))
def _(spark, d):
    return m.bus_factor(m.expertise(a.commits(spark, d)))


@query("health_score", more(C, f"""{_EX}, {_BF}, h AS (SELECT count(*) AS dirs, count(*) FILTER (risky) AS risky, count(*) FILTER (last_commit < {RECENT}) AS stale, avg(bus_factor) AS bf FROM bf)
SELECT CAST(greatest(0, floor(CASE WHEN bf < 3 THEN s - (3 - bf) * 15 ELSE least(100, s + 10) END + 0.5)) AS BIGINT) AS health, dirs, risky, stale, round(bf, 6) AS avg_bus_factor FROM (SELECT *, 100 - least(30, 50.0::DOUBLE * risky / dirs) - least(20, 30.0::DOUBLE * stale / dirs) AS s FROM h)"""))
def _(spark, d):
    return m.health(m.bus_factor(m.expertise(a.commits(spark, d))), RECENT)


@query("primary_secondary_expert", more(C, f"{_EX} SELECT dir, max(author_email) FILTER (rank = 1) AS primary_expert, coalesce(string_agg(author_email, ',' ORDER BY rank) FILTER (rank BETWEEN 2 AND 4), '') AS secondary FROM ex GROUP BY dir"))
def _(spark, d):
    e = m.expertise(a.commits(spark, d)).where("rank <= 4").groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("rank", "author_email"))).alias("top"))
    names = F.transform("top", lambda s: s["author_email"])
    return e.select("dir", names[0].alias("primary_expert"), F.concat_ws(",", F.slice(names, 2, 3)).alias("secondary"))


@query("expert_sort", more(C, f"{_EX}, {_BF} SELECT dir, risky, bus_factor, row_number() OVER (ORDER BY risky DESC, bus_factor, dir) AS place FROM bf"))
def _(spark, d):
    b = m.bus_factor(m.expertise(a.commits(spark, d)))  # a row a directory
    return b.select("dir", "risky", "bus_factor", F.row_number().over(Window.orderBy(F.desc("risky"), "bus_factor", "dir")).cast("long").alias("place"))


@query("recommendations", more(C, f"{_EX}, {_BF} SELECT dir, CASE WHEN risky THEN 'high' WHEN bus_factor <= 2 THEN 'medium' ELSE 'low' END AS priority FROM bf ORDER BY CASE WHEN risky THEN 0 WHEN bus_factor <= 2 THEN 1 ELSE 2 END, dir LIMIT 10"))
def _(spark, d):
    b = m.bus_factor(m.expertise(a.commits(spark, d)))
    rank = F.when(F.col("risky"), 0).when(F.col("bus_factor") <= 2, 1).otherwise(2)
    return b.orderBy(rank, "dir").limit(10).select("dir", a.pick(rank, ["high", "medium", "low"]).alias("priority"))


_OWN = f"ow AS (SELECT *, CAST(floor(100.0::DOUBLE * commits / sum(commits) OVER (PARTITION BY file) + 0.5) AS BIGINT) AS pct FROM (SELECT file, author_email, count(*) AS commits, count(*) FILTER (ts_s >= {RECENT}) AS recent, max(ts_s) AS last_commit FROM commits WHERE author_email NOT IN ('dev0@example.com', 'owner25@example.com') GROUP BY ALL))"


def _owned(spark, d):
    return m.ownership(a.commits(spark, d), ["dev0@example.com", "owner25@example.com"], RECENT)


@query("file_ownership", more(C, f"{_OWN} SELECT * FROM ow"))
def _(spark, d):
    return _owned(spark, d)


_FILES = "fl AS (SELECT DISTINCT file FROM commits WHERE dir IN ('src/Brand#11', 'src/Brand#24') AND length(file) % 2 = 0)"


@query("reviewer_rollup", more(C, f"""{_OWN}, {_FILES}, n AS (SELECT count(*) AS total FROM fl), g AS (SELECT author_email, avg(pct) AS own, count(*) AS held, sum(recent) AS recent FROM ow JOIN fl USING (file) GROUP BY author_email),
s AS (SELECT author_email, own, held / total::DOUBLE AS coverage, CAST(floor(own * (held / total::DOUBLE) + 0.5) AS BIGINT) AS expertise_pct, round(0.7 * (held / total::DOUBLE) + 0.3 * own / 100 + CASE WHEN recent > 0 THEN 0.1 ELSE 0 END, 6) AS relevance FROM g CROSS JOIN n),
k AS (SELECT *, CASE WHEN own >= 50 AND coverage > 0.3 THEN 'required' ELSE 'optional' END AS category FROM s)
SELECT author_email, expertise_pct, relevance, category FROM k QUALIFY row_number() OVER (PARTITION BY category ORDER BY expertise_pct DESC, relevance DESC, author_email) <= CASE WHEN category = 'required' THEN 3 ELSE 5 END"""))
def _(spark, d):
    files = a.commits(spark, d).where("dir IN ('src/Brand#11', 'src/Brand#24') AND length(file) % 2 = 0").select("file").distinct()
    return m.reviewers(_owned(spark, d), files, 5)


@query("diff_stats", "SELECT l_orderkey AS commit_id, CAST(sum(l_quantity) AS DOUBLE) AS additions, round(sum(l_quantity * l_discount), 6) AS deletions, count(DISTINCT l_partkey) AS files FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    return a.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("commit_id")).agg(F.sum("l_quantity").cast("double").alias("additions"), r6(F.sum(F.col("l_quantity") * F.col("l_discount")), "deletions"), F.countDistinct("l_partkey").alias("files"))


@query("file_last_change", with_(C, "SELECT lower(file) AS file, max(ts_s) AS last_change FROM commits GROUP BY 1"))
def _(spark, d):
    return a.commits(spark, d).groupBy(F.lower("file").alias("file")).agg(F.max("ts_s").alias("last_change"))


@query("keyword_frequency_tags", "WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents), g AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) > 3 AND word NOT IN ('this', 'that', 'with', 'from', 'have', 'were', 'their', 'they') GROUP BY ALL) SELECT doc_id, word, round(least(n / 10.0::DOUBLE, 0.8), 6) AS confidence, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS k FROM g) WHERE k <= 5")
def _(spark, d):
    stop = ["this", "that", "with", "from", "have", "were", "their", "they"]
    w = a.read(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word") > 3).where(~F.col("word").isin(stop))
    g = w.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return v.top_k(g, ["doc_id"], 5, F.desc("n"), F.asc("word")).select("doc_id", "word", r6(F.least(F.col("n") / 10.0, F.lit(0.8)), "confidence"), "rank")


@query("entity_merge_rollup", with_("entities", "SELECT lower(regexp_replace(name, ' [0-9]+$', '')) AS canonical, CAST(sum(mentions) AS BIGINT) AS mentions, round(max(confidence), 6) AS confidence, arg_max(entity_id, (confidence, entity_id)) AS description_from FROM entities GROUP BY 1"))
def _(spark, d):
    e = a.entities(spark, d).withColumn("canonical", F.lower(F.regexp_replace("name", " [0-9]+$", "")))
    return e.groupBy("canonical").agg(F.sum("mentions").alias("mentions"), r6(F.max("confidence"), "confidence"), F.max_by("entity_id", F.struct("confidence", "entity_id")).alias("description_from"))


_CO = "s AS (SELECT l_orderkey AS sentence, list_sort(list(DISTINCT 'e' || l_partkey)) AS es FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) BETWEEN 2 AND 8)"


@query("cooccurrence", f"WITH {_CO}, x AS (SELECT sentence, unnest(es) AS e FROM s), p AS (SELECT a.e AS a, b.e AS b, count(*) AS c FROM x a JOIN x b ON a.sentence = b.sentence AND a.e < b.e GROUP BY ALL) SELECT a, b, CAST(least(10, 2 + c) AS BIGINT) AS strength, round(least(0.9::DOUBLE, 0.5 + 0.1 * c), 6) AS confidence FROM p ORDER BY c DESC, a, b LIMIT 64")
def _(spark, d):
    """Pairs within sentences (here: orders) of 2 to 8 entities, whose number bounds the pairs of each.

    Pairs are counted as numbers, which are smaller than names, in tasks by the number of lines; a pair's names are in order.
    """
    line = a.read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    rows, name = line.count(), lambda x: F.concat(F.lit("e"), x.cast("string"))
    s = a.dealt(line, rows, "l_orderkey").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("es")).where("size(es) BETWEEN 2 AND 8")
    pairs = F.flatten(F.transform("es", lambda x: F.transform(F.filter("es", lambda y: name(y) > name(x)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    # An order of n parts makes n (n - 1) / 2 pairs; four a line are more than orders of up to eight make.
    p = a.dealt(s.select(F.explode(pairs).alias("p")).select("p.a", "p.b"), 4 * rows, "a", "b")
    g = p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).select(name(F.col("a")).alias("a"), name(F.col("b")).alias("b"), "c")
    g = g.orderBy(F.desc("c"), "a", "b").limit(64)
    return g.select("a", "b", F.least(F.lit(10), 2 + F.col("c")).cast("long").alias("strength"), r6(F.least(F.lit(0.9), 0.5 + 0.1 * F.col("c")), "confidence"))


@query("mode_parent", "SELECT label, parent FROM (SELECT label, label % 3 + vec_id % 2 AS parent, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, label % 3 + vec_id % 2) AS k FROM embeddings GROUP BY label, label % 3 + vec_id % 2) WHERE k = 1")
def _(spark, d):
    g = a.read(spark, d, "embeddings").withColumn("parent", F.col("label") % 3 + F.col("vec_id") % 2).groupBy("label", "parent").agg(F.count(F.lit(1)).alias("n"))
    return v.top_k(g, ["label"], 1, F.desc("n"), F.asc("parent")).select("label", "parent")


_VR = "q AS (SELECT CASE event_id % 3 WHEN 0 THEN 'memory' WHEN 1 THEN 'code' ELSE 'hybrid' END AS mode, value, CAST(event_id % 20 AS DOUBLE) / 20 AS recall FROM events), sm AS (SELECT mode, round(avg(value), 6) AS latency, round(avg(recall), 6) AS recall FROM q GROUP BY mode)"


@query("value_report", f"WITH {_VR} SELECT x.mode, y.mode AS baseline, round(x.recall - y.recall, 6) AS recall_lift, round(x.latency / greatest(y.latency, 0.01), 6) AS latency_ratio FROM sm x JOIN sm y ON x.mode <> y.mode")
def _(spark, d):
    e = a.read(spark, d, "events").select(a.pick(F.col("event_id") % 3, ["memory", "code", "hybrid"]).alias("mode"), "value", ((F.col("event_id") % 20).cast("double") / 20).alias("recall"))
    s = e.groupBy("mode").agg(r6(F.avg("value"), "latency"), r6(F.avg("recall"), "recall"))  # three rows
    o = s.select(F.col("mode").alias("baseline"), F.col("latency").alias("l2"), F.col("recall").alias("r2"))
    return s.join(o, F.col("mode") != F.col("baseline")).select("mode", "baseline", r6(F.col("recall") - F.col("r2"), "recall_lift"), r6(F.col("latency") / F.greatest("l2", F.lit(0.01)), "latency_ratio"))


_GATE = """g AS (SELECT conv_id, list_sort(list(DISTINCT turn)) AS expected FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id), t AS (SELECT conv_id, list_sort(list(DISTINCT turn)) AS got FROM conversations WHERE length(text) % 3 <> 0 AND turn < 5 GROUP BY conv_id)"""


@query("quality_gate", f"WITH {_GATE}, z AS (SELECT c.conv_id, coalesce(expected, []) AS e, coalesce(got, []) AS r FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g USING (conv_id) LEFT JOIN t USING (conv_id)) SELECT conv_id, round(CASE WHEN len(e) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(e, r)) / len(e)::DOUBLE END, 6) AS recall, round(len(list_intersect(e, r)) / 5.0::DOUBLE, 6) AS precision_at_5, CASE WHEN len(e) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(e, r)) / len(e)::DOUBLE END >= 0.5 AND len(list_intersect(e, r)) / 5.0::DOUBLE >= 0.2 AS passed FROM z")
def _(spark, d):
    c = a.read(spark, d, "conversations")
    e = c.groupBy("conv_id").agg(F.collect_set(F.when(F.col("turn") % 2 == 0, F.col("turn"))).alias("e"), F.collect_set(F.when((F.length("text") % 3 != 0) & (F.col("turn") < 5), F.col("turn"))).alias("r"))
    both = F.size(F.array_intersect("e", "r"))
    recall, precision = F.when(F.size("e") == 0, 1.0).otherwise(both / F.size("e")), both / 5.0
    return e.select("conv_id", r6(recall, "recall"), r6(precision, "precision_at_5"), ((recall >= 0.5) & (precision >= 0.2)).alias("passed"))


@query("changelog_rollup", "SELECT kind, count(*) AS commits, string_agg(DISTINCT author, ',' ORDER BY author) AS contributors FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' WHEN 2 THEN 'docs' ELSE 'other' END AS kind, 'dev' || (o_custkey % 23) AS author FROM orders) GROUP BY kind")
def _(spark, d):
    o = a.read(spark, d, "orders").select(a.pick(F.col("o_orderkey") % 4, ["feat", "fix", "docs", "other"]).alias("kind"), F.concat(F.lit("dev"), (F.col("o_custkey") % 23).cast("string")).alias("author"))
    return o.groupBy("kind").agg(F.count(F.lit(1)).alias("commits"), F.concat_ws(",", F.array_sort(F.collect_set("author"))).alias("contributors"))


@query("community_report", with_("entities", "SELECT c AS community, 'Community of ' || n || ' entities: ' || names AS title, main_type, CAST(total AS BIGINT) AS mentions FROM (SELECT c, count(*) AS n, string_agg(name, ', ' ORDER BY k) FILTER (k <= 5) AS names, sum(mentions) AS total FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY mentions DESC, entity_id) AS k FROM (SELECT *, CAST(entity_id[2:] AS BIGINT) % 12 AS c FROM entities)) GROUP BY c) JOIN (SELECT c, entity_type AS main_type FROM (SELECT CAST(entity_id[2:] AS BIGINT) % 12 AS c, entity_type, row_number() OVER (PARTITION BY CAST(entity_id[2:] AS BIGINT) % 12 ORDER BY count(*) DESC, entity_type) AS k FROM entities GROUP BY 1, 2) WHERE k = 1) USING (c)"))
def _(spark, d):
    e = a.entities(spark, d).withColumn("c", F.substring("entity_id", 2, 20).cast("long") % 12)
    size = e.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("mentions").alias("mentions"))
    top = v.top_k(e, ["c"], 5, F.desc("mentions"), F.asc("entity_id")).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("t"))
    kind = v.top_k(e.groupBy("c", "entity_type").agg(F.count(F.lit(1)).alias("k")), ["c"], 1, F.desc("k"), F.asc("entity_type")).select("c", F.col("entity_type").alias("main_type"))
    title = F.concat(F.lit("Community of "), F.col("n").cast("string"), F.lit(" entities: "), F.concat_ws(", ", F.transform("t", lambda s: s["name"])))
    return size.join(top, "c").join(kind, "c").select(F.col("c").alias("community"), title.alias("title"), "main_type", "mentions")


@query("community_level_stats", "SELECT CAST(label % 3 AS INT) AS level, count(DISTINCT label) AS communities, round(count(*) / count(DISTINCT label)::DOUBLE, 6) AS avg_size FROM embeddings GROUP BY 1")
def _(spark, d):
    g = a.read(spark, d, "embeddings").groupBy((F.col("label") % 3).cast("int").alias("level"), "label").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("level").agg(F.count(F.lit(1)).alias("communities"), r6(F.avg("n"), "avg_size"))


_HIST = "h AS (SELECT event_type AS branch, CAST(ts AS DATE) AS day, count(*) AS n, list_sort(list(value)) AS xs FROM events GROUP BY ALL), p AS (SELECT branch, day, xs[CAST(greatest(1, ceil(0.5::DOUBLE * n)) AS INT)] AS p50, xs[CAST(greatest(1, ceil(0.95::DOUBLE * n)) AS INT)] AS p95 FROM h)"


@query("history_compare", f"WITH {_HIST} SELECT branch, strftime(day, '%Y-%m-%d') AS day, round(p50 - q50, 6) AS p50_delta, round(p95 / greatest(q95, 0.01), 6) AS p95_ratio FROM (SELECT *, lag(p50) OVER (PARTITION BY branch ORDER BY day) AS q50, lag(p95) OVER (PARTITION BY branch ORDER BY day) AS q95 FROM p) WHERE q50 IS NOT NULL")
def _(spark, d):
    e = a.read(spark, d, "events").select(F.col("event_type").alias("branch"), F.to_date("ts").alias("day"), "value")
    p = m.nearest_rank(e, ["branch", "day"], "value", {"p50": 50, "p95": 95})
    w = Window.partitionBy("branch").orderBy("day")
    p = p.withColumn("q50", F.lag("p50").over(w)).withColumn("q95", F.lag("p95").over(w)).where("q50 IS NOT NULL")
    return p.select("branch", F.date_format("day", "yyyy-MM-dd").alias("day"), r6(F.col("p50") - F.col("q50"), "p50_delta"), r6(F.col("p95") / F.greatest("q95", F.lit(0.01)), "p95_ratio"))
