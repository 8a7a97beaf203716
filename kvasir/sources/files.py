"""Sources and sinks: file discovery, git logs, markdown, JSON history, snapshots and an offline embedder."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File endings that are scanned, and folders and patterns that are left out.
SCANNED = ("ts", "tsx", "js", "jsx", "sql", "py", "go", "rs")
SKIPPED_FOLDERS = ("node_modules", ".git", "dist", "build", "out", "coverage", ".next", "vendor", "target", "__pycache__", ".venv")
SKIPPED_FILES = r"\.(min\.js|d\.ts|lock|map)$"


def discover(spark: SparkSession, root: str, endings: tuple[str, ...] = SCANNED) -> DataFrame:
    """(path, length, modified) of the files below ``root`` with these endings; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(endings) + "}").load(root)
    folders = "/(" + "|".join(f.replace(".", r"\.") for f in SKIPPED_FOLDERS) + ")/"
    return files.where(~F.col("path").rlike(folders) & ~F.col("path").rlike(SKIPPED_FILES)).select("path", "length", F.col("modificationTime").alias("modified"))


def contents(spark: SparkSession, root: str, endings: tuple[str, ...] = SCANNED) -> DataFrame:
    """(path, content, hash) of the discovered files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(endings) + "}").load(root)
    text = F.decode("content", "UTF-8")
    return files.select("path", text.alias("content"), F.sha2(text, 256).alias("hash"))


def git_log(lines: DataFrame) -> DataFrame:
    """(author, email, ts_s, file) of lines (repo, n, line): each header ``name|email|seconds`` holds for the files after it."""
    header = F.col("line").rlike(r"^[^|]+\|[^|]+\|[0-9]+$")
    w = Window.partitionBy("repo").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("head", F.last(F.when(header, F.col("line")), ignorenulls=True).over(w)).where(~header & (F.trim("line") != "") & F.col("head").isNotNull())
    part = F.split("head", r"\|")
    return rows.select("repo", part[0].alias("author"), part[1].alias("email"), part[2].cast("long").alias("ts_s"), F.col("line").alias("file"))


def adr(text: Column) -> Column:
    """Title, status, context and decision of a decision record in markdown."""
    part = lambda name: F.trim(F.regexp_extract(text, rf"(?s)##\s+{name}\s*\n(.*?)(?:\n##|$)", 1))
    return F.struct(F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)).alias("title"), part("Status").alias("status"), part("Context").alias("context"), part("Decision").alias("decision"))


def markdown_notes(docs: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Imported notes: texts of more than 100 characters, cut at 10,000; decision records are typed so."""
    record = F.col(content).rlike(r"(?m)^##\s+Decision")
    return docs.where(F.length(content) > 100).select(path, F.when(record, "decision").otherwise("note").alias("type"), F.substring(content, 1, 10_000).alias("content"), adr(F.col(content)).alias("adr"))


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the .md and .mdx files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,mdx}").load(root)
    return files.select("path", F.decode("content", "UTF-8").alias("content"))


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Benchmark records of JSON lines in order of time; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy("unixMs")


def export_json(tables: dict[str, DataFrame], root: str) -> None:
    """Each table as JSON lines in a folder of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{root}/{name}")


class Catalog:
    """Named Parquet tables in a folder, with the upserts and deletes of a store; one writer at a time.

    A table is a folder of versions. A change writes the next one whole, and the last one that is complete is the
    table: a failed write leaves it as it was, and it is found again by whoever opens the folder next.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self, name: str) -> int:
        """The last complete version, -1 without one."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/v*/_SUCCESS")
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(folder)
        return max([int(f.getPath().getParent().getName()[1:]) for f in found or []], default=-1)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/v{self.version(name)}")

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{self.version(name) + 1}")
        return self.table(name)

    def upsert(self, name: str, rows: DataFrame, key: list[str]) -> DataFrame:
        if self.version(name) < 0:
            return self.put(name, rows)
        old = self.table(name)
        return self.put(name, old.join(rows.select(*key), key, "left_anti").unionByName(rows))

    def delete(self, name: str, keys: DataFrame) -> DataFrame:
        return self.put(name, self.table(name).join(keys, keys.columns, "left_anti"))


def hash_embedder(dims: int = 64):
    """A text-to-vector function without a model: signed feature hashing of words, scaled to length 1."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}

        def one(text):
            v = np.zeros(dims, np.float32)
            for w in (text or "").lower().split():
                if w not in known:
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                    known[w] = (h % dims, 1.0 if h >> 63 else -1.0)
                i, sign = known[w]
                v[i] += sign
            n = np.linalg.norm(v)
            return v / n if n else v

        return texts.map(one)

    return embed


def embed_missing(texts: DataFrame, cache: DataFrame, embed, model: str) -> DataFrame:
    """(content_hash, model, embedding) of the texts (content): cached ones as they are, the others embedded once."""
    wanted = texts.select("content", F.sha2("content", 256).alias("content_hash")).dropDuplicates(["content_hash"])
    mine = cache.where(F.col("model") == model)
    hits = mine.join(wanted.select("content_hash"), "content_hash", "left_semi").select("content_hash", "model", "embedding")
    misses = wanted.join(mine.select("content_hash"), "content_hash", "left_anti")
    return hits.union(misses.select("content_hash", F.lit(model), embed("content")))
