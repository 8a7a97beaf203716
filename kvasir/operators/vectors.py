"""Vectors: cosine similarity, exact nearest neighbours, ranking and truncation.

Queries of up to ``QUERY_VALUES`` numbers, which is checked, travel to the tasks, and the vectors are read in place: a
task holds the best k of each query so far and gives them once, at its end. More queries than that are dealt out in
blocks, one a task, past which all vectors stream, so that a block's best rows leave a task once. No pair table is
made, whatever the number of vectors. ``operators/cells.py`` has the index that reads a part of the vectors only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda t, u: t + u)


def cosine(x: Column, y: Column) -> Column:
    """0 where a norm is 0; vectors of different lengths are an error."""
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    value = F.when(norm == 0, 0.0).otherwise(dot(x, y) / norm)
    return F.when(F.size(x) == F.size(y), value).otherwise(F.raise_error(F.lit("vectors differ in length")))


def similarity(cos: Column) -> Column:
    """Cosine scaled to 0..1, as stores that keep a distance report it."""
    return F.greatest(F.lit(0.0), (cos + 1.0) / 2.0)


def truncate_normalise(v: Column, size: int) -> Column:
    """The first ``size`` components, rescaled to length 1 (all zeros stay)."""
    head = F.transform(F.slice(v, 1, size), lambda x: x.cast("double"))
    norm = F.sqrt(dot(head, head))
    return F.transform(head, lambda x: F.when(norm == 0, x).otherwise(x / norm))


def top_k(df: DataFrame, by: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank; Spark cuts groups to k before it shuffles them."""
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return out.where(F.col(rank) <= k)


#: Numbers in the queries that travel to every task (32 MB of doubles).
QUERY_VALUES = 4_000_000
#: Queries and vectors in one matrix product, and vectors of a group that meets blocks of queries.
QUERIES_AT_ONCE, VECTORS_AT_ONCE, GROUP = 512, 4096, 4096
#: Queries whose best rows a task holds at once, and tasks that fewer blocks than these are spread over.
QUERIES_A_TASK, TASKS = 32_768, 64


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column, all of one length and without nulls, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def similarities(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines scaled to 0..1, of each row of x with each of y; .5 where a norm is 0."""
    scale = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
    cos = np.divide(x @ y.T, scale, out=np.zeros_like(scale), where=scale > 0)
    return np.round(np.maximum(0.0, (cos + 1) / 2), 6)


class Best:
    """The k best (similarity, id) of each query among the vectors seen, ties by id."""

    def __init__(self, n: int, k: int):
        self.k, self.bar = k, np.full(n, -1.0)
        self.q, self.ids, self.sim = np.zeros(0, np.int64), None, np.zeros(0)

    def see(self, at: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> None:
        """``sim``: a row for each query number of ``at``, a column for each id."""
        bar = self.bar[at]
        if sim.shape[1] > self.k:
            bar = np.maximum(bar, np.partition(sim, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero(sim >= bar[:, None])  # those below are behind k others
        self.add(at[row], ids[col], sim[row, col])

    def add(self, at: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> None:
        """Rows that may be among the best."""
        ids = ids if self.ids is None else np.concatenate((self.ids, ids))
        q, sim = np.concatenate((self.q, at)), np.concatenate((self.sim, sim))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, -sim, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = order[place < self.k]
        last = place == self.k - 1
        self.bar[q[last]] = sim[order][last]
        self.q, self.ids, self.sim = q[place < self.k], ids[kept], sim[kept]


class Nearest:
    """The k nearest vectors of each row of ``x``, held for QUERIES_AT_ONCE rows together, so that an addition sorts few."""

    def __init__(self, x: np.ndarray, k: int):
        self.x, self.parts = x, list(_parts(len(x), QUERIES_AT_ONCE))
        self.best = [Best(len(x[s]), k) for s in self.parts]
        self.unit = _unit(x)

    def see(self, ids: np.ndarray, y: np.ndarray) -> None:
        """Once a query has k rows, only pairs whose cosine may reach its last one's are looked at closely."""
        unit = _unit(y)
        for s, best in zip(self.parts, self.best, strict=True):
            if best.bar.min() < 0:
                best.see(np.arange(len(best.bar)), ids, similarities(self.x[s], y))
                continue
            row, col = np.nonzero(self.unit[s] @ unit.T >= (2 * best.bar - 1 - 1e-5)[:, None])
            if len(row):
                best.add(row, ids[col], _similarity_of(self.x[s][row], y[col]))

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(number of a row of x, id, similarity) of what was found."""
        return ((best.q + s.start, best.ids, best.sim) for s, best in zip(self.parts, self.best, strict=True) if len(best.q))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1)[:, None]
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _similarity_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As ``similarities``, of each row of x with the same row of y."""
    scale = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
    cos = np.divide(np.einsum("ij,ij->i", x, y), scale, out=np.zeros_like(scale), where=scale > 0)
    return np.round(np.maximum(0.0, (cos + 1) / 2), 6)


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy() if pa.types.is_integer(column.type) and not column.null_count else np.array(column.to_pylist(), dtype=object)


def small(queries: DataFrame) -> tuple[pa.Array, np.ndarray] | None:
    """The queries' ids and vectors, if they have at most ``QUERY_VALUES`` numbers."""
    size = queries.agg(F.sum(F.size("v").cast("long")).alias("n")).first()["n"] or 0
    if size > QUERY_VALUES:
        return None
    got = queries.select("q_id", "v").toArrow().combine_chunks()
    return pa.concat_arrays(got.column(0).chunks) if len(got) else pa.array([], got.schema.field(0).type), matrix(pa.concat_arrays(got.column(1).chunks)) if len(got) else np.zeros((0, 0))


def _types(queries: DataFrame, vectors: DataFrame, name: str) -> str:
    return f"q_id {queries.schema['q_id'].dataType.simpleString()}, {name} {vectors.schema[name].dataType.simpleString()}, similarity double"


def _parts(n: int, size: int) -> Iterator[slice]:
    return (slice(a, a + size) for a in range(0, n, size))


def _blocks(queries: DataFrame, block: int) -> DataFrame:
    """(q: array of (q_id, v)): the stated queries in blocks of about ``block``."""
    share = F.pmod(F.xxhash64("q_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    numbered = queries.withColumn("block", F.floor(share * F.ceil(F.lit(queries.count()) / block)).cast("int"))
    return numbered.groupBy("block").agg(F.collect_list(F.struct(F.col("q_id"), F.col("v"))).alias("q"))


def _met(queries: DataFrame, vectors: DataFrame, block: int, parts: int = 64) -> DataFrame:
    """Every block of queries with every bounded group of vectors, which they reach over ``parts`` keys."""
    row = F.monotonically_increasing_id()
    grouped = vectors.withColumn("g", F.floor(row / GROUP)).groupBy("g").agg(F.collect_list(F.struct(*vectors.columns)).alias("vs"))
    grouped = grouped.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(parts)))
    spread = _blocks(queries, block).select("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    return grouped.join(spread, "part").select("q", "vs")


def _rows(rows: list, field: str) -> np.ndarray:
    return np.array([r[field] for r in rows], dtype=np.float64)


def _dealt(queries: DataFrame, vectors: DataFrame, block: int) -> DataFrame:
    """(key, q_id, id, v): each block of queries before each share of the vectors, in one task a key.

    The vectors are sent once for each block, and each share's best rows leave their task, so there are the fewer shares the
    more blocks there are, and one from TASKS blocks on.
    """
    blocks = max(1, -(-queries.count() // block))
    shares = max(1, TASKS // blocks)
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(number("q_id", blocks).alias("b"), every(shares).alias("s"), "q_id", F.lit(None).cast(vectors.schema["id"].dataType).alias("id"), "v")
    x = vectors.select(every(blocks).alias("b"), number("id", shares).alias("s"), F.lit(None).cast(queries.schema["q_id"].dataType).alias("q_id"), "id", "v")
    rows = q.withColumn("kind", F.lit(0)).union(x.withColumn("kind", F.lit(1)))
    rows = rows.select((F.col("b") * shares + F.col("s")).alias("key"), "kind", "q_id", "id", "v")
    # More tasks than keys, so that hardly a task gets two keys.
    return rows.repartition(4 * blocks * shares, "key").sortWithinPartitions("key", "kind")


def knn(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERIES_A_TASK) -> DataFrame:
    """(q_id, id, similarity, rank): the k vectors (id, v) nearest to each query (q_id, v), ties by id.

    Null vectors and queries are left out; vectors of different lengths are an error.
    """
    queries, vectors = queries.where("v IS NOT NULL"), vectors.where("v IS NOT NULL").select("id", "v")
    kind, own = _types(queries, vectors, "id"), small(queries)

    def given(nearest: Nearest, q_ids: pa.Array, kind_of: pa.DataType) -> Iterator[pa.RecordBatch]:
        for at, ids, sim in nearest.rows():
            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(at)), pa.array(ids.tolist(), kind_of), pa.array(sim)], names=["q_id", "id", "similarity"])

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, x = own
        nearest, kind_of = Nearest(x, k), pa.null()
        for batch in batches:
            for s in _parts(batch.num_rows if len(x) else 0, VECTORS_AT_ONCE):
                part = batch.slice(s.start, VECTORS_AT_ONCE)
                nearest.see(_ids(part.column(0)), matrix(part.column(1)))
                kind_of = part.column(0).type
        yield from given(nearest, q_ids, kind_of)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, nearest = None, [], None
        for batch in batches:
            key, which = batch.column("key").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.concatenate(([0], 1 + np.nonzero((np.diff(key) != 0) | (np.diff(which) != 0))[0], [len(key)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b > a and key[a] != at:
                    if nearest is not None:
                        yield from given(nearest, q_ids, batch.column("id").type)
                    at, asked, nearest = key[a], [], None
                if b > a and which[a] == 0:
                    asked.append(batch.slice(a, b - a))
                    continue
                if b > a and asked and nearest is None:
                    q_ids, x = pa.concat_arrays([r.column("q_id") for r in asked]), np.concatenate([matrix(r.column("v")) for r in asked])
                    nearest = Nearest(x, k)
                for s in _parts(b - a if asked else 0, VECTORS_AT_ONCE):
                    part = batch.slice(a + s.start, min(VECTORS_AT_ONCE, b - a - s.start))
                    nearest.see(_ids(part.column("id")), matrix(part.column("v")))
        if nearest is not None:
            yield from given(nearest, q_ids, batch.column("id").type)

    found = vectors.mapInArrow(in_place, kind) if own is not None else _dealt(queries, vectors, block).mapInArrow(streamed, kind)
    return top_k(found, ["q_id"], k, F.desc("similarity"), F.asc("id"))


def best_of_group(queries: DataFrame, vectors: DataFrame, block: int = QUERIES_AT_ONCE) -> DataFrame:
    """(q_id, grp, similarity): for each query the best similarity in each group of the vectors (grp, v).

    A task's groups leave it as their maxima, so rows are bounded by tasks times queries times groups.
    """
    queries, vectors = queries.where("v IS NOT NULL"), vectors.where("v IS NOT NULL AND grp IS NOT NULL").select("grp", "v")
    kind, own = _types(queries, vectors, "grp"), small(queries)

    def maxima(q_ids: np.ndarray, x: np.ndarray, grp: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        groups, at = np.unique(grp, return_inverse=True)
        top = np.zeros((len(x), len(groups)))
        np.maximum.at(top.T, at, similarities(x, y).T)
        return pd.DataFrame({"q_id": np.repeat(q_ids, len(groups)), "grp": np.tile(groups, len(x)), "similarity": top.ravel()})

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, x = own
        for batch in batches:
            grp, y = np.array(batch.column(0).to_pylist(), dtype=object), matrix(batch.column(1))
            for s in _parts(len(x) if len(grp) else 0, QUERIES_AT_ONCE):
                top = maxima(np.arange(len(x))[s], x[s], grp, y)
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(top["q_id"])), pa.array(top["grp"].tolist(), batch.column(0).type), pa.array(top["similarity"])], names=["q_id", "grp", "similarity"])

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q, part in zip(pdf["q"], pdf["vs"], strict=True):
                yield maxima(np.array([r["q_id"] for r in q], dtype=object), _rows(q, "v"), np.array([r["grp"] for r in part], dtype=object), _rows(part, "v"))

    found = vectors.mapInArrow(in_place, kind) if own is not None else _met(queries, vectors, block).mapInPandas(met, kind)
    return found.groupBy("q_id", "grp").agg(F.max("similarity").alias("similarity"))
