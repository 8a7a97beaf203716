"""Queries over graphs (G1-G17) and the graph side of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.functions import text as t
from kvasir.operators import graph as g
from kvasir.operators import vectors as v
from kvasir.plans.registry import query
from kvasir.plans.relational import more
from kvasir.plans.scoring import r6
from kvasir.session import staged
from kvasir.sources import adapters as a
from kvasir.sources.adapters import with_

R, E, N = "memory_relations", "code_edges", "code_nodes"


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def walk(steps: str, start: str, depth: int) -> str:
    """Common table expressions: st (x, y) and sn (id, depth)."""
    return f"st AS ({steps}), wk(id, d) AS (SELECT '{start}', 0 UNION SELECT st.y, wk.d + 1 FROM wk JOIN st ON st.x = wk.id WHERE wk.d < {depth}), sn AS (SELECT id, CAST(min(d) AS INT) AS depth FROM wk GROUP BY id)"


_BOTH_R = "SELECT source_id AS x, target_id AS y FROM memory_relations UNION SELECT target_id, source_id FROM memory_relations"


@query("traverse_graph", more(R, f"{walk(_BOTH_R, 'mem_1', 3)} SELECT id, depth FROM sn"))
def _(spark, d):
    steps = g.directed(a.memory_relations(spark, d), "both", "source_id", "target_id")
    return g.bfs(steps, ids(spark, "mem_1"), 3).select("id", "depth")


@query("traverse_graph_typed", more(R, f"{walk(_BOTH_R.replace(' UNION', ''' WHERE type IN ('references', 'extends', 'requires') UNION''') + ''' WHERE type IN ('references', 'extends', 'requires')''', 'mem_4', 3)} SELECT id, depth FROM sn"))
def _(spark, d):
    rel = a.memory_relations(spark, d).where("type IN ('references', 'extends', 'requires')")
    return g.bfs(g.directed(rel, "both", "source_id", "target_id"), ids(spark, "mem_4"), 3).select("id", "depth")


@query("bfs_outgoing", more(R, f"{walk('SELECT source_id AS x, target_id AS y FROM memory_relations', 'mem_1', 2)} SELECT id, depth FROM sn"))
def _(spark, d):
    return g.bfs(g.directed(a.memory_relations(spark, d), "out", "source_id", "target_id"), ids(spark, "mem_1"), 2).select("id", "depth")


_PATH = "pt(id, d, path) AS (SELECT 'mem_1', 0, 'mem_1' UNION ALL SELECT r.target_id, pt.d + 1, pt.path || '>' || r.target_id FROM pt JOIN memory_relations r ON r.source_id = pt.id WHERE pt.d < 4 AND NOT contains('>' || pt.path || '>', '>' || r.target_id || '>')), bp AS (SELECT id, CAST(d AS INT) AS depth, path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, path) AS k FROM pt) WHERE k = 1)"


def _paths(spark, d):
    return g.shortest_paths(g.directed(a.memory_relations(spark, d), "out", "source_id", "target_id"), ids(spark, "mem_1"), 4)


@query("find_path", more(R, f"{_PATH} SELECT * FROM bp"))
def _(spark, d):
    return _paths(spark, d).select("id", "depth", "path")


@query("related_memories", more(R, f"{_PATH}, {walk(_BOTH_R, 'mem_1', 2)} SELECT sn.id, sn.depth, bp.path FROM sn JOIN bp USING (id) WHERE sn.id <> 'mem_1'"))
def _(spark, d):
    near = g.bfs(g.directed(a.memory_relations(spark, d), "both", "source_id", "target_id"), ids(spark, "mem_1"), 2)
    return near.where("id <> 'mem_1'").select("id", "depth").join(_paths(spark, d).select("id", "path"), "id")


def _edges(spark, d, *kinds):
    return a.code_edges(spark, d).where(F.col("edge_type").isin(*kinds)) if kinds else a.code_edges(spark, d)


_CALLS = {"out": "SELECT from_node AS x, to_node AS y FROM code_edges WHERE edge_type = 'calls'", "in": "SELECT to_node AS x, from_node AS y FROM code_edges WHERE edge_type = 'calls'"}
_CALLS["both"] = f"{_CALLS['out']} UNION {_CALLS['in']}"
_START = "p12"

for _dir in ("out", "in", "both"):

    @query(f"call_graph_{_dir}", more(E, f"{walk(_CALLS[_dir], _START, 3)} SELECT id, depth FROM sn"))
    def _(spark, d, direction=_dir):
        return g.bfs(g.directed(_edges(spark, d, "calls"), direction), ids(spark, _START), 3).select("id", "depth")


@query("call_graph_edges", more(E, f"{walk(_CALLS['both'], _START, 2)} SELECT DISTINCT from_node, to_node FROM code_edges WHERE edge_type = 'calls' AND (from_node IN (SELECT id FROM sn) OR to_node IN (SELECT id FROM sn))"))
def _(spark, d):
    """Q11: edges with an end in a visited node, also those that leave the last layer."""
    e = _edges(spark, d, "calls")
    seen = g.bfs(g.directed(e, "both"), ids(spark, _START), 2).select("id")
    touching = lambda c: e.join(seen, e[c] == seen["id"], "left_semi").select("from_node", "to_node")
    return touching("from_node").union(touching("to_node")).distinct()


for _dir, _sql in (("imports", "SELECT from_node AS x, to_node AS y FROM code_edges WHERE edge_type = 'imports'"), ("imported_by", "SELECT to_node AS x, from_node AS y FROM code_edges WHERE edge_type = 'imports'"), ("both", "SELECT from_node AS x, to_node AS y FROM code_edges WHERE edge_type = 'imports' UNION SELECT to_node, from_node FROM code_edges WHERE edge_type = 'imports'")):

    @query(f"dependency_tree_{_dir}", more(E, f"{walk(_sql, 'p20', 3)} SELECT id, depth FROM sn"))
    def _(spark, d, direction={"imports": "out", "imported_by": "in", "both": "both"}[_dir]):
        return g.bfs(g.directed(_edges(spark, d, "imports"), direction), ids(spark, "p20"), 3).select("id", "depth")


@query("impact_analysis", more(E, f"{walk('SELECT to_node AS x, from_node AS y FROM code_edges', 'p33', 3)} SELECT sn.id, depth, CASE WHEN depth = 1 THEN 'high' WHEN depth = 2 THEN 'medium' ELSE 'low' END AS severity FROM sn WHERE depth > 0"))
def _(spark, d):
    e = _edges(spark, d)
    seen = g.bfs(g.directed(e, "in"), ids(spark, "p33"), 3).where("depth > 0")
    kinds = e.where("to_node = 'p33'").groupBy(F.col("from_node").alias("id")).agg(F.collect_set("edge_type").alias("kinds"))
    return seen.join(kinds, "id", "left").select("id", "depth", g.severity().alias("severity"))


@query("find_implementations", with_(f"{N} {E}", "SELECT to_node AS interface_id, count(*) AS n, string_agg(from_node, ',' ORDER BY from_node) AS implementers FROM code_edges WHERE edge_type = 'implements' AND to_node IN (SELECT id FROM code_nodes WHERE type = 'interface') GROUP BY to_node"))
def _(spark, d):
    i = a.code_nodes(spark, d).where("type = 'interface'").select(F.col("id").alias("to_node"))
    e = _edges(spark, d, "implements").join(i, "to_node", "left_semi")
    return e.groupBy(F.col("to_node").alias("interface_id")).agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.array_sort(F.collect_list("from_node"))).alias("implementers"))


_SPARSE = "sp AS (SELECT DISTINCT CAST(from_node[2:] AS BIGINT) AS x, CAST(to_node[2:] AS BIGINT) AS y FROM code_edges WHERE edge_type = 'extends'), nd AS (SELECT x AS id FROM sp UNION SELECT y FROM sp), bo AS (SELECT x, y FROM sp UNION SELECT y, x FROM sp)"


def _sparse(spark, d):
    e = _edges(spark, d, "extends").select(F.expr("cast(substring(from_node, 2) as bigint) x"), F.expr("cast(substring(to_node, 2) as bigint) y")).distinct()
    return e.select(F.explode(F.array("x", "y")).alias("id")).distinct(), e


@query("traverse_many_starts", more(R, f"st AS ({_BOTH_R}), wk(start, id, d) AS (SELECT DISTINCT x, x, 0 FROM st WHERE CAST(x[5:] AS BIGINT) % 50 = 0 UNION SELECT wk.start, st.y, wk.d + 1 FROM wk JOIN st ON st.x = wk.id WHERE wk.d < 2) SELECT start, id, CAST(min(d) AS INT) AS depth FROM wk GROUP BY start, id"))
def _(spark, d):
    """G1 from every memory whose number 50 divides, all at once."""
    steps = staged(g.directed(a.memory_relations(spark, d), "both", "source_id", "target_id"))
    starts = steps.where(F.substring("x", 5, 20).cast("long") % 50 == 0).select(F.col("x").alias("id")).distinct()
    return g.bfs(steps, starts, 2)


@query("pair_distances", more(R, f"st AS ({_BOTH_R}), pr AS (SELECT DISTINCT x AS start, 'mem_' || ((CAST(x[5:] AS BIGINT) * 7 + 3) % (SELECT count(*) FROM documents)) AS target FROM st WHERE CAST(x[5:] AS BIGINT) % 50 = 0), wk(start, id, d) AS (SELECT DISTINCT start, start, 0 FROM pr UNION SELECT wk.start, st.y, wk.d + 1 FROM wk JOIN st ON st.x = wk.id WHERE wk.d < 4) SELECT pr.start, target, CAST(min(d) AS INT) AS distance FROM pr JOIN wk ON wk.start = pr.start AND wk.id = target GROUP BY pr.start, target"))
def _(spark, d):
    """G3 for many pairs: their distances within four steps, searched from both ends."""
    n = a.read(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))  # one row
    steps = staged(g.directed(a.memory_relations(spark, d), "both", "source_id", "target_id"))
    k = F.substring("x", 5, 20).cast("long")
    pairs = steps.where(k % 50 == 0).select("x").distinct().crossJoin(F.broadcast(n)).select(F.col("x").alias("start"), a.memory_id((k * 7 + 3) % F.col("n")).alias("target"))
    return g.pair_distances(steps, pairs, 4)


@query("connected_components", more(E, f"{_SPARSE}, re(id, root) AS (SELECT id, id FROM nd UNION SELECT bo.y, re.root FROM re JOIN bo ON bo.x = re.id WHERE re.root < bo.y) SELECT id, min(root) AS component FROM re GROUP BY id"))
def _(spark, d):
    return g.connected_components(*_sparse(spark, d))


@query("graph_stats", more(E, f"{_SPARSE}, re(id, root) AS (SELECT id, id FROM nd UNION SELECT bo.y, re.root FROM re JOIN bo ON bo.x = re.id WHERE re.root < bo.y), cp AS (SELECT id, min(root) AS c FROM re GROUP BY id) SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM bo) // 2 AS edges, round((SELECT count(*) FROM bo) / (SELECT count(*) FROM nd)::DOUBLE, 6) AS avg_degree, (SELECT count(DISTINCT c) FROM cp) AS components"))
def _(spark, d):
    nodes, edges = _sparse(spark, d)
    both = edges.union(edges.select("y", "x")).distinct()
    one = nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(both.agg(F.count(F.lit(1)).alias("ends"))).crossJoin(g.connected_components(nodes, edges).agg(F.countDistinct("component").alias("components")))
    return one.select("nodes", F.expr("ends div 2").alias("edges"), r6(F.col("ends") / F.col("nodes"), "avg_degree"), "components")


_ADJ = "aj AS (SELECT id, neighbour, CAST(max(w) AS DOUBLE) AS weight FROM (SELECT source AS id, target AS neighbour, strength AS w FROM entity_relationships UNION ALL SELECT target, source, strength FROM entity_relationships) WHERE id <> neighbour GROUP BY ALL)"
ER = "code_edges entity_relationships"


def _rel(spark, d):
    return a.entity_relationships(spark, d).select(F.col("source").alias("x"), F.col("target").alias("y"), F.col("strength").cast("double").alias("weight"), "strength")


@query("adjacency_list", more(ER, f"{_ADJ} SELECT * FROM aj"))
def _(spark, d):
    return g.adjacency(_rel(spark, d))


@query("modularity", more(ER, f"{_ADJ}, cm AS (SELECT DISTINCT id, CAST(id[2:] AS BIGINT) % 5 AS c FROM aj), pr AS (SELECT x.c, sum(CASE WHEN x.c = y.c THEN weight ELSE 0 END) AS i, sum(weight) AS k FROM aj JOIN cm x ON x.id = aj.id JOIN cm y ON y.id = aj.neighbour GROUP BY x.c) SELECT round(sum(i / w - 1.0 * (k / w) * (k / w)), 6) AS modularity FROM pr CROSS JOIN (SELECT sum(weight) AS w FROM aj)"))
def _(spark, d):
    adj = g.adjacency(_rel(spark, d))
    c = adj.select("id").distinct().withColumn("community", F.expr("cast(substring(id, 2) as bigint) % 5"))
    return g.modularity(adj, c).select(r6(F.col("modularity"), "modularity"))


@query("communities")
def _(spark, d):
    """One row a node; tests hold the result's modularity against singletons and planted groups."""
    return g.communities(g.adjacency(_rel(spark, d)))


@query("community_hierarchy")
def _(spark, d):
    return g.hierarchy(g.adjacency(_rel(spark, d)), (1.0, 0.5))


_SEARCH = """ed AS (SELECT source AS x, target AS y, strength FROM entity_relationships WHERE strength >= 3 UNION ALL SELECT target, source, strength FROM entity_relationships WHERE strength >= 3),
sd AS (SELECT entity_id AS id, 1.0::DOUBLE AS score FROM entities WHERE entity_id IN ('e5', 'e9', 'e40')),
l1 AS (SELECT y AS id, max(score * (strength / 10.0::DOUBLE) * 0.8) AS score FROM sd JOIN ed ON ed.x = sd.id WHERE y NOT IN (SELECT id FROM sd) GROUP BY y),
l2 AS (SELECT y AS id, max(score * (strength / 10.0::DOUBLE) * 0.64) AS score FROM l1 JOIN ed ON ed.x = l1.id WHERE y NOT IN (SELECT id FROM sd) AND y NOT IN (SELECT id FROM l1) GROUP BY y)"""


@query("local_search", more(f"entities {ER}", f"{_SEARCH} SELECT id, 0 AS depth, round(score, 6) AS score FROM sd UNION ALL SELECT id, 1, round(score, 6) FROM l1 UNION ALL SELECT id, 2, round(score, 6) FROM l2"))
def _(spark, d):
    seeds = a.entities(spark, d).where("entity_id IN ('e5', 'e9', 'e40')").select(F.col("entity_id").alias("id"), F.lit(1.0).alias("score"))
    return g.local_search(_rel(spark, d), seeds, 2, 3).select("id", "depth", r6(F.col("score"), "score"))


@query("global_search", "SELECT c AS report, n, rating, round(least(1.0::DOUBLE, n / 100.0::DOUBLE) * 0.5 + coalesce(rating, 5) / 10.0::DOUBLE * 0.5, 6) AS score FROM (SELECT CAST(label AS BIGINT) AS c, count(*) AS n, CASE WHEN label % 4 = 0 THEN NULL ELSE label % 11 END AS rating FROM embeddings GROUP BY label) ORDER BY score DESC, c LIMIT 5")
def _(spark, d):
    e = a.read(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rating = F.when(F.col("label") % 4 != 0, F.col("label") % 11)
    score = F.least(F.lit(1.0), F.col("n") / 100.0) * 0.5 + F.coalesce(rating, F.lit(5)) / 10.0 * 0.5
    return e.select(F.col("label").cast("long").alias("report"), "n", rating.alias("rating"), r6(score, "score")).orderBy(F.desc("score"), "report").limit(5)


@query("drift_search")
def _(spark, d):
    """Up to three rounds; each searches locally from the entities nearest to the query, then moves the query to the mean of what it found, until it moves no further than .9 in cosine."""
    e = a.read(spark, d, "embeddings").select(a.memory_id(F.col("vec_id")).alias("id"), F.col("embedding").alias("v"))
    ent = e.withColumn("id", F.regexp_replace("id", "mem_", "e"))
    q = ent.where("id = 'e0'").select(F.lit(0).alias("q_id"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    rel, found = _rel(spark, d), None
    for _ in range(3):
        near = v.knn(q, ent, 5)
        found = g.local_search(rel, near.select("id", F.col("similarity").alias("score")), 2, 2)
        mean = found.join(ent, "id").orderBy(F.desc("score"), "id").limit(5).select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
        nxt = mean.groupBy(F.lit(0).alias("q_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))  # one row
        moved = staged(nxt.join(q.select("q_id", F.col("v").alias("old")), "q_id").select("q_id", "v", v.cosine(F.col("v"), F.col("old")).alias("c")))
        q = moved.select("q_id", "v")
        if not moved.where("c < 0.9").head(1):
            break
    return found.select("id", "depth", r6(F.col("score"), "score"))


@query("neighbor_expansion", more(f"{N} {E}", "u AS (SELECT from_node AS x, to_node AS y FROM code_edges UNION SELECT to_node, from_node FROM code_edges), anc AS (SELECT id, file_path FROM code_nodes WHERE file_path LIKE 'src/Brand#2%'), nb AS (SELECT n.file_path, count(*) AS edges, count(DISTINCT n.id) AS nodes FROM anc JOIN u ON u.x = anc.id JOIN code_nodes n ON n.id = u.y WHERE n.file_path NOT IN (SELECT file_path FROM anc) GROUP BY n.file_path) SELECT file_path, edges, nodes, round(least(6.0::DOUBLE, 0.8 * edges) + least(3.0::DOUBLE, 0.4 * nodes), 6) AS boost FROM nb"))
def _(spark, d):
    n = a.code_nodes(spark, d)
    anchors = n.where(F.col("file_path").startswith("src/Brand#2"))
    reached = anchors.select(F.col("id").alias("x")).join(g.directed(a.code_edges(spark, d), "both"), "x").join(n.select(F.col("id").alias("y"), "file_path"), "y")
    nb = reached.join(anchors.select("file_path").distinct(), "file_path", "left_anti").groupBy("file_path").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("y").alias("nodes"))
    return nb.withColumn("boost", F.round(F.least(F.lit(6.0), 0.8 * F.col("edges")) + F.least(F.lit(3.0), 0.4 * F.col("nodes")), 6))


@query("hybrid_entity_search", with_("entities", "SELECT entity_id, round(score, 6) AS score FROM (SELECT coalesce(x.entity_id, l.entity_id) AS entity_id, CASE WHEN coalesce(v, 0) > 0 AND coalesce(s, 0) > 0 THEN least(1.0::DOUBLE, 0.72 * v + 0.28 * s) WHEN coalesce(v, 0) > 0 THEN v ELSE s END AS score FROM (SELECT 'e' || vec_id AS entity_id, round(greatest(0.0::DOUBLE, (list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) + 1) / 2), 6) AS v FROM embeddings ORDER BY v DESC, entity_id LIMIT 20) x FULL JOIN (SELECT entity_id, CASE WHEN contains(lower(name), 'red') THEN 0.85::DOUBLE ELSE 0 END AS s FROM (SELECT * FROM entities ORDER BY mentions DESC, entity_id LIMIT 500) WHERE contains(lower(name), 'red')) l ON l.entity_id = x.entity_id) WHERE score >= 0.18"))
def _(spark, d):
    """Vector candidates and the most mentioned names, fused."""
    e = a.read(spark, d, "embeddings").select(F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("v"))
    near = v.knn(e.where("id = 'e0'").select(F.lit(0).alias("q_id"), "v"), e, 20).select(F.col("id").alias("entity_id"), F.col("similarity").alias("vs"))
    pool = a.entities(spark, d).orderBy(F.desc("mentions"), "entity_id").limit(500).where(F.contains(F.lower("name"), F.lit("red"))).select("entity_id", F.lit(0.85).alias("ls"))
    both = near.join(pool, "entity_id", "full_outer")
    return both.select("entity_id", r6(t.fused_score(F.coalesce("vs", F.lit(0.0)), F.coalesce("ls", F.lit(0.0))), "score")).where("score >= 0.18")


@query("report_vector_search", "WITH kn AS (SELECT q.vec_id AS q_id, v.label, round(greatest(0.0::DOUBLE, (list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) + 1) / 2), 6) AS s FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0), tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC) AS k FROM kn) WHERE k <= 40) SELECT q_id, label AS report, max(s) AS score FROM kn GROUP BY q_id, label QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, report) <= 3")
def _(spark, d):
    """A report's score is that of its best vector."""
    e = a.read(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("v"))
    best = v.best_of_group(q, e.select(F.col("label").alias("grp"), F.col("embedding").alias("v")))
    return v.top_k(best, ["q_id"], 3, F.desc("similarity"), F.asc("grp")).select("q_id", F.col("grp").alias("report"), F.col("similarity").alias("score"))
