"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a minimum per node (combined on the map side) and a join with the edges; the minima are
written first, so AQE can split a hub's edges. The edge table is rewritten in the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvasir.llm.common import Stage


def _star(edges: DataFrame, stage: Stage, large: bool, rows: int) -> DataFrame:
    """edges (a, b) with a > b. Large: each node's greater neighbours join its least one; small: its lesser ones do."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), rows)
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = stage.table(edges.groupBy("a").agg(F.min("b").alias("m")), rows)
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id of the undirected edges (a, b): the smallest id reachable from it."""
    stage = Stage(edges.sparkSession, name)
    now = stage.table(
        edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    )
    state = _state(now)
    while True:
        rows = 2 * state[0]  # no step makes more
        wide = stage.table(_star(now, stage, True, rows).where("a <> b").distinct(), rows)
        nxt = stage.table(_star(wide, stage, False, rows).where("a <> b").distinct(), rows)
        for old in (now, wide):
            stage.drop(old)
        now, before, state = nxt, state, _state(nxt)
        if state == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
