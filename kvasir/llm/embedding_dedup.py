"""Operator 8: near-duplicate embeddings by small-world graphs per shard.

Equal vectors form a class with its smallest id. Classes are dealt evenly to shards by a hash. A shard gathers
groups of near-equal vectors into balls (see ``balls``) and builds one graph of the balls' centres, most of
which are single vectors; its beam is widened until the recall audit passes, and all are compared where it
doesn't. Every ball then queries every shard, in blocks of balls by shard, for the centres in whose ball a
linked vector may be. Links between two balls are certain by their angles or confirmed by the cosine in double
precision, so a group of near-equal vectors costs its members and not its pairs. A task joins the links it finds
into a spanning forest: it returns a row for each linked vector and not for each link, and these rows' components
are the result's.

A shard has at most about ``shard_values`` numbers (and there are ``min_shards`` at least), so a task's memory is
bounded; a query meets every shard, so beyond min_shards full shards the work grows with vectors times shards.

Ids are whole numbers. Defined cases: vectors that are null, all zero, or have null or non-finite components link with nothing, as
do rows with a null id; vectors of different lengths never link; equal vectors link; repeated rows count
as other vectors; an empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvasir.llm.balls import Ball, angle, gather, link
from kvasir.llm.common import Stage
from kvasir.llm.components import components
from kvasir.llm.hnsw import Graph

BUILT = "dim int, shard int, part int, graph binary, vectors binary, reps binary, sizes binary, starts binary, radius double, recall double"
#: Vectors of one block of queries.
BLOCK = 16_384


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Balls:
    """Balls in a row: their members' unit vectors, ids and weights, ball k's from starts[k] to starts[k + 1]."""

    def __init__(self, exact: np.ndarray, reps: np.ndarray, sizes: np.ndarray, starts: np.ndarray):
        self.exact, self.reps, self.sizes, self.starts, self.made = exact, reps, sizes, starts, {}
        self.single = np.diff(starts) == 1
        self.centres, self.radii = exact[starts[:-1]].copy(), np.zeros(len(starts) - 1)
        for k in np.flatnonzero(~self.single):
            self.centres[k], self.radii[k] = self[k].centre, self[k].radius

    def __getitem__(self, k: int) -> Ball:
        if k not in self.made:
            at = slice(self.starts[k], self.starts[k + 1])
            self.made[k] = Ball(self.exact[at], self.reps[at], self.sizes[at])
        return self.made[k]

    def dump(self) -> dict:
        return {"vectors": self.exact.tobytes(), "reps": self.reps.tobytes(), "sizes": self.sizes.tobytes(), "starts": self.starts.tobytes()}

    @classmethod
    def load(cls, row, dim: int) -> Balls:
        return cls(np.frombuffer(row["vectors"]).reshape(-1, dim), *(np.frombuffer(row[c], np.int64) for c in ("reps", "sizes", "starts")))

    def part(self, first: int, last: int) -> Balls:
        a, b = self.starts[first], self.starts[last]
        return Balls(self.exact[a:b], self.reps[a:b], self.sizes[a:b], self.starts[first : last + 1] - a)


def _build(threshold: float, recall: float):
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", ignore_index=True)
        rows = rows.iloc[np.random.default_rng(len(rows)).permutation(len(rows))]
        exact = _unit(np.stack(rows["v"].to_numpy()).astype(np.float64))
        ball = gather(exact.astype(np.float32))
        order = np.argsort(ball, kind="stable")
        starts = np.concatenate((np.flatnonzero(np.diff(ball[order], prepend=-1)), [len(order)]))
        balls = Balls(exact[order], rows["rep"].to_numpy(np.int64)[order], rows["n"].to_numpy(np.int64)[order], starts)
        graph, radius = Graph.build(balls.centres.astype(np.float32)), float(balls.radii.max())
        found = graph.audit(float(np.cos(min(np.pi, np.arccos(threshold) + radius))), recall)
        same = {"dim": key[0], "shard": key[1]}
        out = [{**same, "part": -1, "graph": graph.dump(), **balls.dump(), "radius": radius, "recall": found}]
        first = 0
        while first < len(starts) - 1:
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + BLOCK, side="right")) - 1)
            out.append({**same, "part": len(out) - 1, "graph": None, **balls.part(first, last).dump(), "radius": radius, "recall": found})
            first = last
        return pd.DataFrame(out)

    return build


def _search(threshold: float):
    most = float(np.arccos(threshold))

    def search(key: tuple, queries: pd.DataFrame, graphs: pd.DataFrame) -> pd.DataFrame:
        root: dict[int, int] = {}
        counts: list[tuple[int, int]] = []

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def join(x: int, y: int) -> None:
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)

        if len(queries) and len(graphs):
            there, radius = Balls.load(graphs.iloc[0], key[0]), float(graphs.iloc[0]["radius"])
            graph = Graph.load(graphs.iloc[0]["graph"], there.centres.astype(np.float32))
            for _, row in queries.iterrows():
                here = Balls.load(row, key[0])
                least = np.cos(np.minimum(np.pi, most + here.radii + radius)) - 1e-4
                for i, hits in enumerate(graph.within(here.centres.astype(np.float32), least.astype(np.float32))):
                    if not len(hits):
                        continue
                    a, alone = here.starts[i], there.single[hits]
                    if here.single[i]:
                        at = there.starts[hits[alone]]
                        at = at[there.reps[at] != here.reps[a]]
                        at = at[there.exact[at] @ here.exact[a] >= threshold]
                        if len(at):
                            counts.append((int(here.reps[a]), int(there.sizes[at].sum())))
                            for x in there.reps[at].tolist():
                                join(int(here.reps[a]), x)
                        hits = hits[~alone]
                    reach = most + here.radii[i] + there.radii[hits] + 1e-4
                    for k in hits[angle(there.centres[hits] @ here.centres[i]) <= reach].tolist():
                        weight, edges = link(here[i], there[k], threshold)
                        counts += [(int(x), int(n)) for x, n in zip(here[i].reps, weight, strict=True) if n]
                        for x, y in edges:
                            join(x, y)
        forest = [(x, find(x), 0) for x in list(root) if find(x) != x]
        return pd.DataFrame([(x, x, n) for x, n in counts] + forest, columns=["a", "b", "n"], dtype=np.int64)

    return search


def near_duplicates(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, recall: float = 0.995, min_shards: int = 8, shard_values: int = 6_400_000
) -> DataFrame:
    """One row per row: id, n_links (long), component_id, kept (boolean)."""
    stage = Stage(table.sparkSession, "embeddings")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & sound)
    classes = stage.table(valid.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    values = classes.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0]
    shards = max(min_shards, -(-values // shard_values))
    dealt = classes.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))
    built = stage.table(dealt.groupBy("dim", "shard").applyInPandas(_build(threshold, recall), BUILT))
    blocks = built.where("part >= 0").select("dim", F.concat_ws("-", "shard", "part").alias("block"), "vectors", "reps", "sizes", "starts")
    # Each task has one shard's graph, and blocks of queries that have together about as many vectors as a shard.
    part = F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int").alias("part")
    queries = blocks.select("*", part, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    copies = built.where("part < 0").drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    key = ["dim", "shard", "part"]
    found = stage.table(queries.groupBy(*key).cogroup(copies.groupBy(*key)).applyInPandas(_search(threshold), "a long, b long, n long"))
    label = components(found.where("a <> b").select("a", "b"), "embedding-links")
    counts = found.where("a = b").groupBy("a").agg(F.sum("n").alias("links"))
    known = (
        classes.join(counts.withColumnRenamed("a", "rep"), "rep", "left")
        .join(label.withColumnRenamed("id", "rep"), "rep", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    out = valid.join(stage.table(known), "v").select("id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    other = rows.where(~F.coalesce(F.col("id").isNotNull() & F.col("v").isNotNull() & sound, F.lit(False)))
    lone = other.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(lone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


#: The query over embeddings in DuckDB's SQL, by brute force over all pairs.
ORACLE_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), g AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r(id, root) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b)
SELECT e.vec_id, coalesce(n, 0) AS n_links, min(root) AS component_id, e.vec_id = min(root) AS kept
FROM e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = e.vec_id JOIN r ON r.id = e.vec_id GROUP BY e.vec_id, n
"""
