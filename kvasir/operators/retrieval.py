"""Context building: reranking, budget selection, file lookup, sections, evidence and formatting.

Reranking is sequential by nature (each choice changes the next one's novelty and balance), so it runs as
one small pandas function over each query's bounded candidates; everything around it is joins and expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the reranker, and the boost of a source by route.
W_SEMANTIC, W_BALANCE, W_NOVELTY, REDUNDANCY, STREAK = 0.72, 0.18, 0.1, 0.08, 0.05
ROUTE_BOOST = {
    "code": {"kag": 0.08, "graphrag": 0.04, "rag": -0.04},
    "memory": {"rag": 0.08, "graphrag": 0.04, "kag": -0.04},
    "hybrid": {"graphrag": 0.02, "rag": 0.0, "kag": 0.0},
}
SOURCES = ("rag", "kag", "graphrag")


def shares(rag: float, kag: float, graphrag: float) -> dict[str, float]:
    """Source targets as shares of their sum; a half and two quarters without any."""
    given = {s: max(0.0, x) for s, x in zip(SOURCES, (rag, kag, graphrag), strict=True)}
    total = sum(given.values())
    return {s: x / total for s, x in given.items()} if total > 0 else {"rag": 0.5, "kag": 0.25, "graphrag": 0.25}


def rank_one(rows: pd.DataFrame) -> pd.DataFrame:
    """Greedy order of one query's candidates (id, source, relevance, terms; route, rag, kag, graphrag)."""
    rows = rows.sort_values("id", kind="stable").reset_index(drop=True)
    boost, target = ROUTE_BOOST[rows.at[0, "route"]], shares(*(rows.at[0, s] for s in SOURCES))
    top = max(rows["relevance"].max(), 0.0001)
    semantic = (rows["relevance"] / top).clip(lower=0).to_numpy()
    source, terms = rows["source"].tolist(), [{t.lower() for t in ts} for ts in rows["terms"]]
    left, order, seen, taken = set(range(len(rows))), [], set(), dict.fromkeys(SOURCES, 0)
    while left:
        ranked = []
        for i in left:
            balance = target[source[i]] - (taken[source[i]] / len(order) if order else 0.0)
            new = len(terms[i] - seen) / len(terms[i]) if terms[i] else 0.0
            score = W_SEMANTIC * semantic[i] + W_BALANCE * max(-1.0, min(1.0, balance)) + W_NOVELTY * new + boost[source[i]]
            score -= REDUNDANCY * (1 - new) if terms[i] else 0.0
            score -= STREAK if len(order) > 1 and all(source[k] == source[i] for k, _ in order[-2:]) else 0.0
            ranked.append((-score, -semantic[i], i))
        score, _, i = min(ranked)
        order.append((i, -score))
        left.remove(i)
        taken[source[i]] += 1
        seen |= terms[i]
    picked = rows.loc[[i for i, _ in order], ["query_id", "id", "source"]].reset_index(drop=True)
    picked["rank"] = range(1, len(order) + 1)
    picked["score"] = [round(s, 4) for _, s in order]
    return picked


def rerank(candidates: DataFrame) -> DataFrame:
    """(query_id, id, source, rank, score) of (query_id, id, source, relevance, terms, route, rag, kag, graphrag)."""
    return candidates.groupBy("query_id").applyInPandas(rank_one, "query_id long, id string, source string, rank long, score double")


def within_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """Rows (query_id, rank, tokens, ...) with ``included``: in rank order, each that still fits."""
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("rank", "tokens"))),
        F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ranks")),
        lambda t, x: F.when(t["used"] + x["tokens"] <= budget, F.struct((t["used"] + x["tokens"]).alias("used"), F.concat(t["ranks"], F.array(x["rank"])).alias("ranks"))).otherwise(t),
    )
    taken = ranked.groupBy("query_id").agg(fold.alias("f")).select("query_id", F.col("f.ranks").alias("ranks"))  # a query's bounded candidates
    return ranked.join(taken, "query_id").withColumn("included", F.array_contains("ranks", F.col("rank"))).drop("ranks")


def section_order() -> list[Column]:
    """Selected sections by source (rag, graphrag, kag) and then relevance."""
    return [F.when(F.col("source") == "rag", 0).when(F.col("source") == "graphrag", 1).otherwise(2), F.desc("relevance"), F.asc("id")]


def hint_scores(paths: DataFrame, hints: list[str], terms: list[str]) -> DataFrame:
    """(file_path, node_count) with hint_matches and score; paths that match nothing leave."""
    low = F.lower("file_path")
    name = F.element_at(F.split(low, "/"), -1)
    parts, longest, matches = F.lit(0.0), F.lit(0), F.lit(0)
    for h in (x.lower() for x in hints):
        by_name = (name == h) | name.startswith(f"{h}.") | name.startswith(f"{h}-") | name.startswith(f"{h}_")
        by_part = low.contains(f"/{h}/") | low.contains(f"/{h}.") | low.endswith(f"/{h}")
        points = F.when(by_name, max(10, min(20, len(h) + 7))).when(by_part, max(8, min(18, len(h) + 5))).when(low.contains(h), max(3, min(10, len(h) // 2))).otherwise(0)
        parts, matches = parts + points, matches + (points > 0).cast("int")
        longest = F.greatest(longest, F.when(points > 0, len(h)).otherwise(0))
    found = sum((low.contains(t).cast("int") for t in terms if len(t) >= 4), F.lit(0))
    score = parts + 2.5 * found + F.least(F.lit(3.0), F.col("node_count") * 0.1) + F.least(F.lit(4.0), longest * 0.15)
    return paths.withColumn("hint_matches", matches.cast("long")).withColumn("score", F.round(score, 6)).where("hint_matches > 0")


def format_memory() -> Column:
    """Title, type, content (300 characters at most), tags and importance."""
    preview = F.when(F.length("content") > 300, F.concat(F.substring("content", 1, 300), F.lit("..."))).otherwise(F.col("content"))
    meta = F.concat(F.lit("*Tags: "), F.concat_ws(", ", "tags"), F.lit(" | Importance: "), F.floor(F.col("importance") * 100 + 0.5).cast("string"), F.lit("%*"))
    return F.concat_ws("\n", F.concat(F.lit("**"), "title", F.lit("** ("), "type", F.lit(")")), preview, meta)


#: A source's heading.
HEADINGS = (("rag", "## Relevant Memories"), ("graphrag", "## Knowledge Graph Insights"), ("kag", "## Code Relationships"))


def markdown(sections: DataFrame, compact: bool = False) -> DataFrame:
    """(query_id, markdown) of selected sections (query_id, query, source, relevance, id, title, content)."""
    body = F.when((F.col("source") == "rag") & F.lit(compact), F.element_at(F.split("content", "\n"), 1)).otherwise(F.col("content"))
    one = F.struct((-F.col("relevance")).alias("o"), "id", F.concat_ws("\n", F.concat(F.lit("### "), "title"), body, F.lit("")).alias("text"))
    part = [F.array_sort(F.collect_list(F.when(F.col("source") == s, one))).alias(s) for s, _ in HEADINGS]
    g = sections.groupBy("query_id", "query").agg(*part)  # a query's selected sections
    blocks = [F.when(F.size(s) > 0, F.concat_ws("\n", F.lit(h), F.lit(""), F.array_join(F.transform(s, lambda x: x["text"]), "\n"))) for s, h in HEADINGS]
    return g.select("query_id", F.concat_ws("\n", F.concat(F.lit("# Context for: "), "query"), F.lit(""), *blocks).alias("markdown"))
