"""Queries over scoring (F1-F14), staleness (F15-F19, A25) and scored search."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.operators import scoring as s
from kvasir.operators import vectors
from kvasir.plans.registry import query
from kvasir.sources import adapters as a
from kvasir.sources.adapters import NOW, with_

AGE = f"greatest(0, {NOW} - greatest(created_at, accessed_at)) / 86400.0::DOUBLE"


def r6(c, name):
    return F.round(c, 6).alias(name)


@query(
    "recency_factors",
    with_("memories", f"""SELECT id, round(exp(-({AGE}) * (ln(2) / 30)), 6) AS recency_exp, round(greatest(0.0::DOUBLE, 1 - ({AGE}) / 100), 6) AS recency_linear,
  CAST(CASE WHEN ({AGE}) < 7 THEN 1 WHEN ({AGE}) < 30 THEN 0.8 WHEN ({AGE}) < 90 THEN 0.5 ELSE 0.2 END AS DOUBLE) AS recency_step FROM memories"""),
)
def _(spark, d):
    m = a.memories(spark, d)
    days = s.age_days(F.col("created_at"), F.col("accessed_at"), NOW)
    return m.select("id", r6(s.recency_exponential(days), "recency_exp"), r6(s.recency_linear(days, 100), "recency_linear"), s.recency_step(days, [(7, 0.8), (30, 0.5), (90, 0.2)]).alias("recency_step"))


@query(
    "frequency_factors",
    with_("memories", """SELECT id, round(CASE WHEN access_count > 0 THEN least(1.0::DOUBLE, ln(access_count + 1.0::DOUBLE) / ln(101.0::DOUBLE)) ELSE 0.5::DOUBLE END, 6) AS frequency_log,
  round(CASE WHEN access_count > 0 THEN least(1.0::DOUBLE, access_count / 100.0::DOUBLE) ELSE 0.5::DOUBLE END, 6) AS frequency_linear,
  round(CASE WHEN access_count > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1 / (1 + exp(-(access_count - 50.0::DOUBLE) / (100.0::DOUBLE / 6))) - 1 / (1 + exp(3.0::DOUBLE))) / (1 - 2 / (1 + exp(3.0::DOUBLE))))) ELSE 0.5::DOUBLE END, 6) AS frequency_sigmoid
FROM memories"""),
)
def _(spark, d):
    n = F.col("access_count")
    return a.memories(spark, d).select("id", r6(s.frequency_log(n), "frequency_log"), r6(s.frequency_linear(n), "frequency_linear"), r6(s.frequency_sigmoid(n), "frequency_sigmoid"))


@query(
    "semantic_and_confidence",
    "SELECT vec_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST(embedding[1] AS DOUBLE) * 8)) AS semantic, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST(embedding[2] AS DOUBLE) * 8)) AS confidence FROM embeddings",
)
def _(spark, d):
    e = a.read(spark, d, "embeddings")
    x = lambda i: F.col("embedding")[i].cast("double") * 8
    return e.select("vec_id", s.semantic_score(x(0)).alias("semantic"), s.confidence_score(x(1)).alias("confidence"))


def _decay_sql(factor):
    days = f"(greatest(0, {NOW} - coalesce(last_refreshed_at, greatest(accessed_at, created_at))) / 86400.0::DOUBLE * coalesce(decay_rate, 1.0::DOUBLE))"
    return with_("memories", f"""SELECT id, round(CASE WHEN decay_rate = 0 OR type IN ('architecture', 'decision') OR list_contains(tags, 'src3') THEN importance
  ELSE least(importance, greatest(0.1::DOUBLE, importance * {factor.format(days=days)})) END, 6) AS confidence FROM memories""")


for _name, _function, _factor in (
    ("exponential", "exponential", "exp(-{days} * (ln(2) / 90))"),
    ("linear", "linear", "greatest(0.0::DOUBLE, 1 - {days} / 365)"),
    ("step", "step", "CAST(CASE WHEN {days} < 30 THEN 1 WHEN {days} < 90 THEN 0.9 WHEN {days} < 180 THEN 0.7 ELSE 0.5 END AS DOUBLE)"),
):

    @query(f"decayed_confidence_{_name}", _decay_sql(_factor))
    def _(spark, d, function=_function):
        c = s.Decay(function=function, exempt_tags=("SRC3",))
        return a.memories(spark, d).select("id", r6(s.decayed_confidence(c, NOW), "confidence"))


BOOSTS = (
    s.Boost("fresh", "recency", 30, 1.2), s.Boost("important", "importance", 0.8, 1.3), s.Boost("popular", "frequency", 60, 1.1),
    s.Boost("stale", "staleness", 150, 0.7), s.Boost("kind", "memory_type", ("architecture",), 1.15), s.Boost("tagged", "tags", ("EN", "src1"), 1.25, True),
)
_FACTORS = f"""round(exp(-({AGE}) * (ln(2) / 30)), 12) AS rec, importance AS conf,
  CASE WHEN access_count > 0 THEN least(1.0::DOUBLE, ln(access_count + 1.0::DOUBLE) / ln(101.0::DOUBLE)) ELSE 0.5::DOUBLE END AS freq"""
_BOOST = f"""(CASE WHEN ({AGE}) <= 30 THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN importance >= 0.8 THEN 1.3::DOUBLE ELSE 1 END * CASE WHEN access_count >= 60 THEN 1.1::DOUBLE ELSE 1 END
  * CASE WHEN ({AGE}) >= 150 THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN type = 'architecture' THEN 1.15::DOUBLE ELSE 1 END * CASE WHEN list_contains(tags, 'en') AND list_contains(tags, 'src1') THEN 1.25::DOUBLE ELSE 1 END)"""
_NAMES = f"""concat_ws(',', CASE WHEN ({AGE}) <= 30 THEN 'fresh' END, CASE WHEN importance >= 0.8 THEN 'important' END, CASE WHEN access_count >= 60 THEN 'popular' END,
  CASE WHEN ({AGE}) >= 150 THEN 'stale' END, CASE WHEN type = 'architecture' THEN 'kind' END, CASE WHEN list_contains(tags, 'en') AND list_contains(tags, 'src1') THEN 'tagged' END)"""


@query(
    "boost_rules",
    with_("memories", f"""SELECT id, round(CASE WHEN names <> '' THEN greatest(0.0::DOUBLE, least(2.0::DOUBLE, importance * boost)) ELSE importance END, 6) AS score, names AS boosts
FROM (SELECT id, importance, {_BOOST} AS boost, {_NAMES} AS names FROM memories)"""),
)
def _(spark, d):
    score, names = s.boosted(F.col("importance"), list(BOOSTS), NOW)
    return a.memories(spark, d).select("id", r6(score, "score"), F.concat_ws(",", names).alias("boosts"))


# The whole scored search: every fiftieth vector asks, its nearest memories are hydrated, scored, boosted and ranked.
_SCORED = f"""kn AS (SELECT q.vec_id AS q_id, 'mem_' || v.vec_id AS id, round(greatest(0.0::DOUBLE, (list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) + 1) / 2), 6) AS similarity
  FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0),
hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, id) AS rn FROM kn) WHERE rn <= 30),
f AS (SELECT q_id, m.id, similarity, {_BOOST} AS boost, {_NAMES} AS names, {_FACTORS} FROM hit JOIN memories m ON m.id = hit.id),
sc AS (SELECT *, 0.5 * similarity + 0.2 * rec + 0.15 * conf + 0.15 * freq AS raw FROM f),
fin AS (SELECT q_id, id, similarity, names, round(CASE WHEN names <> '' THEN greatest(0.0::DOUBLE, least(2.0::DOUBLE, raw * boost)) ELSE raw END, 6) AS score FROM sc)
SELECT q_id, id, similarity, score, names AS boosts, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM fin) WHERE rank <= 10"""


@query("scored_search", with_("memories", "").rstrip() + ",\n" + _SCORED)
def _(spark, d):
    e = a.read(spark, d, "embeddings")
    vec = e.select(a.memory_id(F.col("vec_id")).alias("id"), F.col("embedding").alias("v"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("v"))
    hits = vectors.knn(asked, vec, 30).drop("rank")
    out = s.score(hits.join(a.memories(spark, d), "id"), NOW, s.Config(boosts=BOOSTS)).withColumn("score", F.round("final_score", 6))
    return vectors.top_k(out, ["q_id"], 10, F.desc("score"), F.asc("id")).select("q_id", "id", "similarity", "score", F.concat_ws(",", "boosts").alias("boosts"), "rank")


for _preset, _w in s.PRESETS.items():

    @query(
        f"preset_{_preset}",
        with_("memories", f"""SELECT id, round({_w.semantic}::DOUBLE * importance + {_w.recency}::DOUBLE * rec + {_w.confidence}::DOUBLE * conf + {_w.frequency}::DOUBLE * freq, 6) AS score FROM (SELECT id, importance, {_FACTORS} FROM memories)"""),
    )
    def _(spark, d, w=_w):
        m = a.memories(spark, d).withColumn("similarity", F.col("importance"))
        return s.score(m, NOW, s.Config(weights=w)).select("id", r6(F.col("final_score"), "score"))


@query("weight_normalise", "SELECT 'sum0' AS name, 0.25::DOUBLE AS semantic, 0.25::DOUBLE AS recency, 0.25::DOUBLE AS confidence, 0.25::DOUBLE AS frequency UNION ALL SELECT 'double', 0.5, 0.25, 0.125, 0.125 UNION ALL SELECT 'near', 0.5, 0.2, 0.15, 0.1505")
def _(spark, d):
    given = {"sum0": s.Weights(0, 0, 0, 0), "double": s.Weights(1, 0.5, 0.25, 0.25), "near": s.Weights(0.5, 0.2, 0.15, 0.1505)}
    rows = [(n, *[float(x) for x in (w.normalised().semantic, w.normalised().recency, w.normalised().confidence, w.normalised().frequency)]) for n, w in given.items()]
    return spark.createDataFrame(rows, "name string, semantic double, recency double, confidence double, frequency double")


@query(
    "score_explanation",
    with_("memories", f"""SELECT id, printf('semantic %.2f, recency %.2f, confidence %.2f, frequency %.2f', round(importance, 2), round(rec, 2), round(conf, 2), round(freq, 2)) AS explanation FROM (SELECT id, importance, {_FACTORS} FROM memories)"""),
)
def _(spark, d):
    return s.score(a.memories(spark, d).withColumn("similarity", F.col("importance")), NOW).select("id", s.explanation().alias("explanation"))


@query("empty_breakdown", with_("memories", "SELECT id, importance AS semantic, 1.0::DOUBLE AS recency, 0.5::DOUBLE AS confidence, 0.5::DOUBLE AS frequency, 1.0::DOUBLE AS w_semantic, 0.0::DOUBLE AS w_recency, 0.0::DOUBLE AS w_confidence, 0.0::DOUBLE AS w_frequency FROM memories"))
def _(spark, d):
    return a.memories(spark, d).select("id", *s.empty_breakdown(F.col("importance")))


_ANCHOR = "coalesce(last_refreshed_at, greatest(accessed_at, created_at))"
_TIME = f"""tm AS (SELECT id, least(1.0::DOUBLE, ({NOW} - {_ANCHOR}) / 86400.0::DOUBLE / 180) AS s FROM memories WHERE ({NOW} - {_ANCHOR}) / 86400.0::DOUBLE >= 7 AND least(1.0::DOUBLE, ({NOW} - {_ANCHOR}) / 86400.0::DOUBLE / 180) >= 0.1)"""


@query("staleness_time_decay", with_("memories", "").rstrip() + f",\n{_TIME}\nSELECT id, round(s, 6) AS score FROM tm")
def _(spark, d):
    return a.memories(spark, d).select("id", r6(s.time_decay_signal(NOW), "score")).where("score IS NOT NULL")




_HASH = "CAST('0x' || substring(md5(file), 1, 6) AS BIGINT)"
_CHANGES = f"ch AS (SELECT file, CAST({NOW} - {_HASH} % 300 * 86400 AS BIGINT) AS last_change FROM (SELECT DISTINCT unnest(related_files) AS file FROM memories))"


def changes(spark, d):
    """The memories' files, each last changed up to 300 days before NOW, by a hash of its path."""
    m = a.memories(spark, d).select(F.explode("related_files").alias("file")).distinct()
    h = F.conv(F.substring(F.md5("file"), 1, 6), 16, 10).cast("long")
    return m.select(F.concat(F.lit("./"), "file").alias("file"), (F.lit(NOW) - h % 300 * 86400).cast("long").alias("last_change"))


_GIT = f"""gt AS (SELECT id, count(*) FILTER (last_change > anchor) AS changed, count(*) AS total FROM (SELECT id, {_ANCHOR} AS anchor, lower(unnest(related_files)) AS file FROM memories) JOIN ch USING (file) GROUP BY id HAVING count(*) FILTER (last_change > anchor) > 0)"""


@query("staleness_git_changes", with_("memories", "").rstrip() + f",\n{_CHANGES},\n{_GIT}\nSELECT id, changed, total, round(least(1.0::DOUBLE, 0.5 + 0.5 * changed / total), 6) AS score FROM gt")
def _(spark, d):
    return s.git_change_signal(a.memories(spark, d), changes(spark, d)).select("id", "changed", "total", r6(F.col("score"), "score"))


_REL = f"""an AS (SELECT id, {_ANCHOR} AS anchor FROM memories),
nr AS (SELECT id, other, min(d) AS d FROM (SELECT source_id AS id, target_id AS other, 1 AS d FROM memory_relations UNION ALL SELECT x.source_id, y.target_id, 2 FROM memory_relations x JOIN memory_relations y ON x.target_id = y.source_id) WHERE id <> other GROUP BY 1, 2),
fr AS (SELECT nr.id, nr.d, least(1.0::DOUBLE, 0.5 + (b.anchor - c.anchor) / 86400.0::DOUBLE / 30 * 0.5) AS f FROM nr JOIN an c ON c.id = nr.id JOIN an b ON b.id = nr.other WHERE b.anchor > c.anchor),
rl AS (SELECT id, fresher, mean * least(1.0::DOUBLE, 0.4 + 0.15 * (fresher - 1)) AS s FROM (SELECT id, count(*) AS fresher, sum(f / d) / sum(1.0::DOUBLE / d) AS mean FROM fr GROUP BY id))"""


@query("staleness_related_updates", with_("memories memory_relations", "").rstrip() + f",\n{_REL}\nSELECT id, fresher, round(s, 6) AS score FROM rl WHERE s >= 0.1")
def _(spark, d):
    return s.related_update_signal(a.memories(spark, d), a.memory_relations(spark, d)).select("id", "fresher", r6(F.col("score"), "score"))


@query("staleness_superseded", with_("memories memory_relations", "SELECT id, type FROM memories WHERE id IN (SELECT target_id FROM memory_relations WHERE type = 'supersedes')"))
def _(spark, d):
    return s.superseded_signal(a.memories(spark, d), a.memory_relations(spark, d)).select("id", "type")


_STALE = f"""{_CHANGES}, {_TIME}, {_GIT}, {_REL},
al AS (SELECT m.id, tm.s AS t, CASE WHEN gt.id IS NOT NULL THEN least(1.0::DOUBLE, 0.5 + 0.5 * gt.changed / gt.total) END AS g, CASE WHEN rl.s >= 0.1 THEN rl.s END AS r, m.id IN (SELECT target_id FROM memory_relations WHERE type = 'supersedes') AS x
  FROM memories m LEFT JOIN tm ON tm.id = m.id LEFT JOIN gt ON gt.id = m.id LEFT JOIN rl ON rl.id = m.id),
st AS (SELECT id, round(CASE WHEN x THEN 1.0::DOUBLE ELSE (coalesce(t * 0.5, 0) + coalesce(g * 0.7, 0) + coalesce(r * 0.4, 0)) / (CASE WHEN t IS NULL THEN 0 ELSE 0.5::DOUBLE END + CASE WHEN g IS NULL THEN 0 ELSE 0.7::DOUBLE END + CASE WHEN r IS NULL THEN 0 ELSE 0.4::DOUBLE END) END, 6) AS composite,
  CAST((t IS NOT NULL)::INT + (g IS NOT NULL)::INT + (r IS NOT NULL)::INT + x::INT AS BIGINT) AS signals FROM al WHERE t IS NOT NULL OR g IS NOT NULL OR r IS NOT NULL OR x),
ac AS (SELECT *, CASE WHEN composite >= 0.9 THEN 'archive' WHEN composite >= 0.6 THEN 'refresh' WHEN composite >= 0.3 THEN 'review' ELSE 'keep' END AS action FROM st)"""


def _stale(spark, d):
    out = s.staleness(a.memories(spark, d), a.memory_relations(spark, d), changes(spark, d), NOW)
    return out.withColumn("composite", F.round("composite", 6)).withColumn("action", s.action(F.col("composite")))


@query("staleness_composite", with_("memories memory_relations", "").rstrip() + f",\n{_STALE}\nSELECT * FROM ac")
def _(spark, d):
    return _stale(spark, d)


@query("staleness_actions", with_("memories memory_relations", "").rstrip() + f",\n{_STALE}\nSELECT action, count(*) AS n FROM ac GROUP BY action")
def _(spark, d):
    return _stale(spark, d).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("staleness_page", with_("memories memory_relations", "").rstrip() + f",\n{_STALE},\nrk AS (SELECT id, composite, row_number() OVER (ORDER BY composite DESC, id) AS rn, count(*) OVER () AS n FROM ac WHERE action <> 'keep')\nSELECT id, composite, n > 40 AS has_more FROM rk WHERE rn > 20 AND rn <= 40")
def _(spark, d):
    """L2: the third page of ten twice over: offset and limit, and whether there is more."""
    found = _stale(spark, d).where("action <> 'keep'")
    more = found.agg((F.count(F.lit(1)) > 40).alias("has_more"))
    return found.orderBy(F.desc("composite"), "id").offset(20).limit(20).select("id", "composite").crossJoin(more)


@query(
    "refresh_confidence",
    with_("memories", f"""SELECT id, round(CASE WHEN decay_rate = 0 OR type IN ('architecture', 'decision') THEN importance ELSE least(importance, greatest(0.1::DOUBLE, importance * exp(-(greatest(0, {NOW} - {_ANCHOR}) / 86400.0::DOUBLE * coalesce(decay_rate, 1.0::DOUBLE)) * (ln(2) / 90)))) END, 6) AS before, importance AS after
FROM memories WHERE needs_review"""),
)
def _(spark, d):
    """Effective confidence before a refresh and after it (the anchor becomes now)."""
    m = a.memories(spark, d).where("needs_review")
    after = m.withColumn("last_refreshed_at", F.lit(NOW).cast("long")).select("id", r6(s.decayed_confidence(s.Decay(), NOW), "after"))
    return m.select("id", r6(s.decayed_confidence(s.Decay(), NOW), "before")).join(after, "id")
