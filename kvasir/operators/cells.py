"""An inverted-file index over vectors: cells around k-means centroids, of which a query reads the nearest ones.

``build`` fits the centroids on a sample of at most ``sample`` vectors (the first by a hash of their ids) by rounds of
DataFrame aggregations, gives every vector of the table its cell, and writes the table partitioned by cell, a large
cell over several files. It then audits itself: the exact neighbours of ``audits`` sampled vectors, taken over all
rows, tell for each number of probed cells which share of them is found; the index keeps the least number with the
wanted recall, and that recall.

``search`` probes that many cells a query, or as many as asked. Only the probed cells' folders are read: their numbers
are literal values of the partition filter. With ``exact`` a second pass also reads every cell that may hold a nearer
vector: a cell's vectors lie within an angle of its centroid, so none is nearer to the query than the angle between
query and centroid less that one. Its result is that of comparing all vectors, and it skips as many cells as the
vectors' clusters allow. Work on the driver is bounded by cells (at most ``MOST_CELLS``) and by the size of queries that
may travel; more queries meet the cells' vectors in blocks, by an equi-join on the cell.

Vectors without a direction (all zeros) have similarity .5 with all; they go to a cell of their own, which is always
read. Null vectors, and those of another length than most of the sample, aren't indexed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvasir.operators import vectors as V

MOST_CELLS = 4096
#: Number of the cell of vectors without a direction.
ZERO = -1
#: What rounding may add to an angle's cosine; similarities are rounded to six places.
SLACK = 2e-6


@dataclass
class CellIndex:
    path: str
    dims: int
    centroids: np.ndarray
    #: Of each cell: its number of vectors, and the least cosine of one with the centroid.
    sizes: np.ndarray
    least: np.ndarray
    probes: int = 1
    recall: float = 1.0
    zeros: int = 0
    by_probes: list[float] = field(default_factory=list)

    def rows(self, spark: SparkSession) -> DataFrame:
        """(id, v, cell) of all indexed vectors."""
        return spark.read.parquet(f"{self.path}/vectors")

    def save(self, spark: SparkSession) -> None:
        told = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items() if k != "path"}
        spark.createDataFrame([(json.dumps(told),)], "index string").coalesce(1).write.mode("overwrite").text(f"{self.path}/index")

    @staticmethod
    def open(spark: SparkSession, path: str) -> CellIndex:
        told = json.loads(spark.read.text(f"{path}/index").first()[0])
        arrays = {k: np.array(told.pop(k)) for k in ("centroids", "sizes", "least")}
        return CellIndex(path, **arrays, **told)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _with_cell(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows (id, v) with their cell and the cosine with its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, V.VECTORS_AT_ONCE):
                part = batch.slice(a, V.VECTORS_AT_ONCE)
                x = unit(V.matrix(part.column(1)))
                cos = x @ centroids.T
                cell = cos.argmax(axis=1).astype(np.int32)
                near = cos[np.arange(len(x)), cell]
                cell[~x.any(axis=1)] = ZERO
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell), pa.array(near)], names=["id", "v", "cell", "cos"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, cell int, cos double")


def fit(sample: DataFrame, cells: int, rounds: int) -> np.ndarray:
    """Unit centroids of the sample's (id, v) by spherical k-means; the first ones are the sample's first by hash."""
    first = sample.orderBy(F.xxhash64("id", F.lit("first cells")), "id").limit(cells).select("v").toArrow()  # at most MOST_CELLS rows
    centroids = unit(V.matrix(pa.concat_arrays(first.column(0).chunks)))
    for _ in range(rounds):
        x = F.posexplode(F.transform("v", lambda t: t.cast("double")))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, t: s + t.cast("double") * t.cast("double")))
        means = _with_cell(sample, centroids).where(F.col("cell") != ZERO).select("cell", norm.alias("norm"), x.alias("i", "x")).groupBy("cell", "i").agg(F.avg(F.col("x") / F.col("norm")).alias("m"))
        got = means.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).collect()  # one row a cell
        moved = centroids.copy()
        for r in got:
            moved[r["cell"]] = [s["m"] for s in r["c"]]
        moved = unit(moved)
        if np.allclose(moved, centroids, atol=1e-6):
            break
        centroids = moved
    return centroids


def build(
    vectors: DataFrame, path: str, cells: int | None = None, sample: int = 20_000, rounds: int = 8, audits: int = 64, k: int = 10, recall: float = 0.95, rows_per_file: int = 200_000
) -> CellIndex:
    """An index of (id, v) at ``path``. Without a number of cells there are about as many as the square root of the rows."""
    spark = vectors.sparkSession
    rows = vectors.select("id", "v").where("v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
    drawn = rows.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(sample)
    common = drawn.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = common["dims"] if common else 0
    rows = rows.where(F.size("v") == dims)
    n = rows.count()
    wanted = min(MOST_CELLS, max(1, round(n**0.5)) if cells is None else cells)
    centroids = fit(drawn.where(F.size("v") == dims), wanted, rounds) if n else np.zeros((0, 0))
    placed = _with_cell(rows, centroids)
    index = CellIndex(path, dims, centroids, np.zeros(len(centroids), np.int64), np.ones(len(centroids)))
    files = [(ZERO, 1)]
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("least")).collect() if n else []:  # one row a cell
        files.append((r["cell"], -(-r["n"] // rows_per_file)))
        if r["cell"] == ZERO:
            index.zeros = r["n"]
        else:
            index.sizes[r["cell"]], index.least[r["cell"]] = r["n"], r["least"]
    # A hash of the id deals a large cell over files, so no task writes a whole one.
    per_cell = F.broadcast(spark.createDataFrame(files, "cell int, files long").groupBy("cell").agg(F.max("files").alias("files")))  # one row a cell
    dealt = placed.join(per_cell, "cell").withColumn("file", F.pmod(F.xxhash64("id"), F.col("files"))).repartition("cell", "file")
    dealt.select("id", "v", "cos", "cell").sortWithinPartitions("cell").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/vectors")
    if n:
        _audit(index, spark, audits, k, recall)
    index.save(spark)
    return index


def _audit(index: CellIndex, spark: SparkSession, audits: int, k: int, wanted: float) -> None:
    """Set the least number of probes that finds the wanted share of the exact neighbours of sampled vectors."""
    rows = index.rows(spark)
    asked = rows.orderBy(F.xxhash64("id", F.lit("audit")), "id").limit(audits).select(F.col("id").alias("q_id"), "v")
    # The vector itself is no finding.
    found = V.knn(asked, rows, k + 1).where("id <> q_id").join(rows.select("id", "cell"), "id").select("q_id", "cell")
    near = found.join(asked, "q_id").select("cell", "v").toArrow()  # audits * k rows
    if not len(near):
        return
    order = probe_order(index, V.matrix(pa.concat_arrays(near.column(1).chunks)))
    cell = near.column(0).to_numpy()
    rank = np.where(cell == ZERO, 0, (order == cell[:, None]).argmax(axis=1))
    index.by_probes = (np.cumsum(np.bincount(rank, minlength=order.shape[1])) / len(rank)).tolist()
    index.probes = int(np.argmax(np.array(index.by_probes) >= min(wanted, 1.0))) + 1
    index.recall = index.by_probes[index.probes - 1]


def probe_order(index: CellIndex, x: np.ndarray) -> np.ndarray:
    """Of each query the cells, nearest centroid first."""
    return np.argsort(-(unit(x) @ index.centroids.T), axis=1, kind="stable")


def bounds(index: CellIndex, x: np.ndarray) -> np.ndarray:
    """Of each query and cell the greatest similarity that a vector of the cell can have."""
    to = np.arccos(np.clip(unit(x) @ index.centroids.T, -1, 1))
    apart = np.maximum(0.0, to - np.arccos(np.clip(index.least, -1, 1))[None, :])
    top = (np.cos(apart) + 1) / 2 + SLACK
    top[~x.any(axis=1)] = 0.5 + SLACK
    top[:, index.sizes == 0] = -1.0
    return top


def _read(index: CellIndex, spark: SparkSession, q_ids: pa.Array, x: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
    """(q_id, id, similarity): candidates from the cells wanted (queries x cells), read in place."""
    cells = [int(c) for c in np.flatnonzero(wanted.any(axis=0))] + [ZERO] * (index.zeros > 0)
    asking = {c: np.flatnonzero(wanted[:, c]) for c in cells if c != ZERO} | {ZERO: np.arange(len(x))}
    rows = index.rows(spark).where(F.col("cell").isin(cells)).select("id", "v", "cell")
    kind = f"q_id {_spark_type(q_ids.type)}, id {rows.schema['id'].dataType.simpleString()}, similarity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = V.Best(len(x), k)
        for batch in batches:
            cell = batch.column(2).to_numpy(zero_copy_only=False)
            ids, y = np.array(batch.column(0).to_pylist(), dtype=object), V.matrix(batch.column(1))
            for c in np.unique(cell):
                at = np.flatnonzero(cell == c)
                for s in (at[i : i + V.VECTORS_AT_ONCE] for i in range(0, len(at), V.VECTORS_AT_ONCE)):
                    for q in (asking[c][i : i + V.QUERIES_AT_ONCE] for i in range(0, len(asking[c]), V.QUERIES_AT_ONCE)):
                        best.see(q, ids[s], V.similarities(x[q], y[s]))
            id_type = batch.column(0).type
        if len(best.q):
            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(best.q)), pa.array(best.ids.tolist(), id_type), pa.array(best.sim)], names=["q_id", "id", "similarity"])

    return rows.mapInArrow(run, kind)


def _spark_type(t: pa.DataType) -> str:
    return {pa.int64(): "bigint", pa.int32(): "int"}.get(t, "string")


def search(index: CellIndex, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(q_id, id, similarity, rank): the k nearest of the probed cells, or with ``exact`` of all."""
    spark = queries.sparkSession
    queries = queries.where("v IS NOT NULL").select("q_id", "v")
    own = V.small(queries)
    order = [F.desc("similarity"), F.asc("id")]
    if own is None:
        if exact:
            return V.knn(queries, index.rows(spark), k)
        return V.top_k(_in_blocks(index, queries, k, probes or index.probes), ["q_id"], k, *order)
    q_ids, x = own
    if not len(x) or not index.dims:
        return V.knn(queries, index.rows(spark).limit(0) if index.dims else queries.select(F.col("q_id").alias("id"), "v").limit(0), k)
    near = probe_order(index, x)[:, : probes or index.probes]
    wanted = np.zeros((len(x), len(index.centroids)), bool)
    np.put_along_axis(wanted, near, True, axis=1)
    found = _read(index, spark, q_ids, x, wanted, k)
    if exact:
        found = V.top_k(found, ["q_id"], k, *order).drop("rank")
        kth = {r["q_id"]: r["kth"] for r in found.groupBy("q_id").agg(F.min("similarity").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).collect()}  # one row a query
        bar = np.array([kth.get(q, -1.0) for q in q_ids.to_pylist()])
        more = ~wanted & (bounds(index, x) >= bar[:, None])
        if more.any():
            found = found.union(_read(index, spark, q_ids, x, more, k)).distinct()
    return V.top_k(found, ["q_id"], k, *order)


def _in_blocks(index: CellIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """As _read, for queries of any number: blocks of a cell's queries meet groups of its vectors by an equi-join."""
    q_type = queries.schema["q_id"].dataType.simpleString()
    v_type = queries.schema["v"].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, V.QUERIES_AT_ONCE):
                part = batch.slice(a, V.QUERIES_AT_ONCE)
                near = probe_order(index, V.matrix(part.column(1)))[:, :probes].astype(np.int32)
                if index.zeros:
                    near = np.concatenate((near, np.full((len(near), 1), ZERO, np.int32)), axis=1)
                rows = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(near.ravel())], names=["q_id", "v", "cell"])

    asked = queries.mapInArrow(ask, f"q_id {q_type}, v {v_type}, cell int")
    rows = index.rows(queries.sparkSession).select("id", "v", "cell")
    dealt = lambda df, key, size: df.withColumn("g", F.pmod(F.xxhash64(key), F.lit(size)))
    slices = max(1, int(index.sizes.max(initial=1)) // V.GROUP)
    blocks = dealt(asked, "q_id", 1 + max(1, queries.count() * probes // (max(1, len(index.centroids)) * V.QUERIES_AT_ONCE)))
    blocks = blocks.groupBy("cell", "g").agg(F.collect_list(F.struct("q_id", "v")).alias("q")).drop("g")
    groups = dealt(rows, "id", slices).groupBy("cell", "g").agg(F.collect_list(F.struct("id", "v")).alias("vs")).drop("g")
    id_type = rows.schema["id"].dataType.simpleString()

    def met(batches):
        import pandas as pd

        for pdf in batches:
            for q, part in zip(pdf["q"], pdf["vs"], strict=True):
                best = V.Best(len(q), k)
                best.see(np.arange(len(q)), np.array([r["id"] for r in part], dtype=object), V.similarities(V._rows(q, "v"), V._rows(part, "v")))
                yield pd.DataFrame({"q_id": np.array([r["q_id"] for r in q], dtype=object)[best.q], "id": best.ids, "similarity": best.sim})

    return blocks.join(groups, "cell").select("q", "vs").mapInPandas(met, f"q_id {q_type}, id {id_type}, similarity double")


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(q_id, recall): the share of each query's exact neighbours (q_id, id) that were found."""
    hit = found.select("q_id", "id", F.lit(1).alias("hit"))
    return exact.select("q_id", "id").join(hit, ["q_id", "id"], "left").groupBy("q_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
