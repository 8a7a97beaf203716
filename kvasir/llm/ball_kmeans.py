"""Operator 11: centroid clustering by ball k-means, exact in whole numbers.

Vectors become whole numbers, floor(scale * x), so sums, centroids and distances have no rounding. A cluster is a
ball: its centroid and a radius that holds every member. Each round

1. the driver, from the k centroids and radii alone, lists each ball's neighbours by distance: the centroids no
   farther than twice the radius. No member can be as near to any other one;
2. every task splits a ball's members by their distance d to their own centroid. Those with 2 * d below the nearest
   neighbour's distance are the stable core and stay unseen; the others lie in annuli, and one in the t-th annulus
   is compared exactly with the first t neighbours, those within 2 * d;
3. the members' sums, counts and greatest distances, combined on the map side, give the next centroids. The radius
   around a moved centroid is bounded by the old one and the way it moved, so that no further pass measures it.

The bounds are not strict, so a tie with a smaller number is always seen. Each round's table (id, vector, cluster,
distance) is written to the shared folder and the one before deleted; k rows of sums a round reach the driver.

Defined cases: vectors that are null, of another size, or hold null or non-finite components give no row; whole
components beyond +-2^27 count as that bound, with which squared distances fit a long; of repeated rows each is a
vector of its own; a null id is clustered but never a first centroid; equal hashes go by the vector; with fewer than
k vectors there are as many centroids; without any, or from an empty table, no rows. Other columns are ignored
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvasir.llm.common import Stage

#: Greatest size of a whole component.
MOST = 1 << 27


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(id, x: array<long>) of the vectors that count."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))))
    return vectors.where((F.size(v) == dims) & finite).select(F.col(id_col).alias("id"), scaled.alias("x"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the least hash of their ids, in that order."""
    hashed = rows.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256).alias("h"), "x")
    return [list(r["x"]) for r in hashed.orderBy("h", "x").limit(k).collect()]  # k rows


def square(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def neighbours(centroids: list[list[int]], radii: list[int | None]) -> list[list[tuple[int, int]]]:
    """For each ball the (squared distance, number) of the centroids within twice its radius (None: no bound), nearest first."""
    out = []
    for i, (c, r) in enumerate(zip(centroids, radii, strict=True)):
        met = sorted((square(c, other), j) for j, other in enumerate(centroids) if j != i)
        out.append([(d, j) for d, j in met if r is None or d <= 4 * r * r])
    return out


def moved_radius(greatest: int, way: int) -> int:
    """A whole number no less than sqrt(greatest) + sqrt(way)."""
    up = lambda n: math.isqrt(n - 1) + 1 if n else 0
    return up(greatest) + up(way)


def nearest(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, near: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of ``x``, in ball ``own``, the nearest centroid and its squared distance; and how many distances were taken."""
    cluster, distance, taken = own.copy(), np.zeros(len(x), np.int64), 0
    for i in np.unique(own):
        rows = np.flatnonzero(own == i)
        mine = ((x[rows] - centroids[i]) ** 2).sum(axis=1)
        best, number, taken = mine.copy(), np.full(len(rows), i, np.int32), taken + len(rows)
        for apart, j in near[i]:
            seen = np.flatnonzero(mine >= -(-apart // 4))  # the annuli from this neighbour's outwards
            if not len(seen):
                break
            d = ((x[rows[seen]] - centroids[j]) ** 2).sum(axis=1)
            taken += len(seen)
            better = (d < best[seen]) | ((d == best[seen]) & (j < number[seen]))
            best[seen[better]], number[seen[better]] = d[better], j
        cluster[rows], distance[rows] = number, best
    return cluster, distance, taken


def _assigned(centroids: list[list[int]], near: list[list[tuple[int, int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    at = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cluster, distance, _ = nearest(x, batch.column(2).to_numpy(zero_copy_only=False).astype(np.int32), at, near)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster), pa.array(distance)], names=["id", "x", "cluster", "distance"])

    return run


def ball_kmeans(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3") -> DataFrame:
    """One row per vector: its id, cluster (int), distance (squared, long), cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    stage = Stage(spark, "balls")
    now = stage.table(whole_vectors(vectors, id_col, vec_col, dims, scale).withColumn("cluster", F.lit(0)))
    centroids = first_centroids(now, k, salt)
    id_type = now.schema["id"].dataType.simpleString()
    names = f"{id_col} {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], names)
    radii: list[int | None] = [None] * len(centroids)
    for step in range(rounds + 1):
        before, near = now, neighbours(centroids, radii)
        now = stage.table(now.select("id", "x", "cluster").mapInArrow(_assigned(centroids, near), f"id {id_type}, x array<bigint>, cluster int, distance long"))
        stage.drop(before)
        if step < rounds:
            sums: list[Column] = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(dims)]
            for r in now.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"), *sums).collect():  # k rows
                i, old = r["cluster"], centroids[r["cluster"]]
                centroids[i] = [r[f"s{d}"] // r["n"] for d in range(dims)]
                radii[i] = moved_radius(r["far"], square(old, centroids[i]))
    inertia = {r["cluster"]: int(r["d"]) for r in now.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    cut = lambda n: min(n, 2**63 - 1)
    texts = [",".join(map(str, c)) for c in centroids]
    told = [(i, cut(n), cut(sum(inertia.values())), hashlib.sha256(texts[i].encode()).hexdigest()) for i, n in sorted(inertia.items())]
    clusters = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = now.select(F.col("id").alias(id_col), "cluster", "distance").join(F.broadcast(clusters), "cluster")  # k rows
    return out.select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3") -> str:
    """The same in DuckDB's SQL: every distance in every round."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {dims}
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0)""",
        f"v AS MATERIALIZED (SELECT vec_id, unnest(range({dims})) AS d, CAST(floor({scale} * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS x FROM kept)",
        f"firsts AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY sha256('{salt}:' || vec_id)) - 1 AS c FROM kept ORDER BY c LIMIT {k})",
        "c0 AS MATERIALIZED (SELECT c, d, x FROM v JOIN firsts USING (vec_id))",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, min(dist) AS dist, arg_min(c, dist * {k} + c) AS c FROM
  (SELECT vec_id, c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS dist FROM v JOIN c{r} m USING (d) GROUP BY ALL) GROUP BY vec_id)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT m.c, m.d, coalesce((s - ((s % n) + n) % n) // n, m.x) AS x FROM c{r} m LEFT JOIN
  (SELECT c, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id) GROUP BY ALL) USING (c, d))"""
            )
    last = f"""h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (c)"""
    return "WITH " + ",\n".join([*parts, last])


ORACLE_SQL = _oracle()
