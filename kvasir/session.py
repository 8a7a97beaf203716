"""Session defaults shared by tests, bench and users without a cluster config."""

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "kvasir") -> SparkSession:
    """A local session with the settings the engine's results depend on (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


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


def staged(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: computed once, cut from its lineage, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/kvasir-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
