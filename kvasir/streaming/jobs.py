"""Structured Streaming jobs: metric aggregation, buffered samples, a request cache with a life time, file changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kvasir.operators.relational import change_set
from kvasir.sources.files import Catalog


def metrics_by_window(samples: DataFrame, late: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """Samples (ts, variant_id, latency_ms) per time window and variant; windows close when the watermark passes."""
    return (
        samples.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "variant_id")
        .agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("latency_ms"), 6).alias("avg_latency"), F.round(F.max("latency_ms"), 6).alias("max_latency"))
        .select(F.col("w.start").alias("window_start"), "variant_id", "samples", "avg_latency", "max_latency")
    )


def sessions(samples: DataFrame, gap: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """Debounced file events (ts, path): a batch ends after ``gap`` without an event of the path."""
    return (
        samples.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "path")
        .agg(F.count(F.lit(1)).alias("events"))
        .select("path", F.col("w.start").alias("first"), "events")
    )


def cache_misses(requests: DataFrame, key: str, life: str = "5 minutes") -> DataFrame:
    """(key, ts) of the requests (ts, key) that a cache would not answer: a key's first one, and the first one ``life`` or
    more after its last miss. A key's state is its last miss, which goes when the watermark has passed its life."""
    kept = pd.Timedelta(life)

    def misses(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = (pd.Timestamp(state.get[0], unit="us") if state.exists else None), []
        for ts in sorted(t for batch in batches for t in batch["ts"]):
            if last is None or ts - last >= kept:
                out.append(ts)
                last = ts
        state.update((last.value // 1000,))
        state.setTimeoutTimestamp(max((last + kept).value // 1_000_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), "ts": out})

    rows = requests.select(key, "ts").withWatermark("ts", life)
    schema = f"{key} {requests.schema[key].dataType.simpleString()}, ts timestamp"
    return rows.groupBy(key).applyInPandasWithState(misses, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def buffered(samples: DataFrame, path: str, checkpoint: str, seconds: int = 60):
    """Append samples to Parquet a micro-batch at a time."""
    return samples.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").outputMode("append").start()


def incremental_scan(catalog: Catalog, name: str = "file_hashes", deletions: bool = True):
    """A foreachBatch function: each batch (path, hash) is compared with the stored snapshot, which it updates.

    Changes are kept in the table ``<name>_changes`` by batch. ``deletions`` only where a batch is a whole scan.
    """

    def scan(batch: DataFrame, batch_id: int) -> None:
        now = batch.groupBy("path").agg(F.max("hash").alias("hash"))
        old = catalog.table(name) if catalog.version(name) >= 0 else now.limit(0)
        changes = change_set(old, now).withColumn("batch", F.lit(batch_id).cast("long"))
        if not deletions:
            changes = changes.where("change <> 'deleted'")
        catalog.upsert(f"{name}_changes", changes, ["batch", "path"])
        kept = old.join(now.select("path"), "path", "left_anti")
        catalog.put(name, now if deletions else kept.unionByName(now))

    return scan
