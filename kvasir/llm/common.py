"""Helpers shared by the operators: staged tables in the shared folder, and text expressions."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space the contracts name, as a character class's content.
SPACE = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one only where that is unset and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _local_dir()
    return found.rstrip("/")


@functools.cache
def _local_dir() -> str:
    """One folder a process; the setting itself can't be changed in a running session."""
    return "file://" + tempfile.mkdtemp(prefix="kvasir-")


#: Rows that a task writes where a table's size is known.
ROWS_A_TASK = 200_000


class Stage:
    """Intermediate tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/kvasir-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def table(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``rows``: about how many there are at most, where that is known; few of them then need few tasks and files."""
        self.count += 1
        if rows is not None:
            df = df.coalesce(1 + rows // ROWS_A_TASK)
        path = f"{self.root}/{self.count:03d}"
        df.write.option("compression", "snappy").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kvasir_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._kvasir_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def whole(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text, F.lit(""))


def one_space(text: Column) -> Column:
    """Each run of white space replaced by one space; single spaces, by far the most, aren't rewritten."""
    return F.regexp_replace(whole(text), rf"[\x09-\x0D][{SPACE}]*|\x20[{SPACE}]+", " ")


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters (long)."""
    t = F.trim(one_space(text))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def even_slices(rows: int, per_slice: int) -> int:
    return max(1, -(-rows // per_slice))
