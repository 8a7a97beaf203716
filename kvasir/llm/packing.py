"""Operator 3: packing into optimal length buckets.

A dynamic programme over the global length histogram chooses the ``buckets`` boundaries with the least
padding; inside each bucket, documents form batches of at most ``token_budget`` padded tokens.

The histogram has every distinct length, so the boundaries are the optimum; v of them take v * v / 2 tokens
at least, and the programme takes ``buckets`` * v steps in the driver. Batches are
numbered by a two-level rank: rows are dealt evenly to slices, ranked within (bucket, slice), and shifted
by the slices' running counts; no bucket is ever gathered in a task.

Defined cases: null text has length 0; length-0 documents are in the first bucket and cost padding; a
document longer than the budget has a batch of its own and is never cut; repeated rows and ties are each
packed once; other columns are ignored whatever their names; fewer distinct lengths than buckets give fewer buckets; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvasir.llm.common import Stage, even_slices, word_count


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of the at most ``buckets`` intervals of the ascending ``lengths`` with the least total padding."""
    v = len(lengths)
    if v == 0:
        return []
    # Whole numbers of Python, so that no sum is rounded.
    tops = [int(x) for x in lengths]
    c, s = ([0, *itertools.accumulate(int(x) for x in xs)] for xs in (counts, sums))
    k = min(buckets, v)
    cut = np.zeros((k, v + 1), dtype=np.int32)
    # The first bucket holds the first j lengths; best[j] is their least padding in the layer's number of buckets.
    best = [0, *(tops[j - 1] * c[j] - s[j] for j in range(1, v + 1))]
    for layer in range(1, k):
        # A cut i costs best[i] + s[i] - c[i] * top, a line in top: the lines' lower envelope, asked at ascending tops.
        nxt, hull, at = [0] * (v + 1), [], 0
        for j in range(1, v + 1):
            i, high = j - 1, best[j - 1] + s[j - 1]
            while len(hull) >= 2:
                (a, ya), (b, yb) = hull[-2], hull[-1]
                if (high - ya) * (c[b] - c[a]) > (yb - ya) * (c[i] - c[a]):
                    break
                hull.pop()
            hull.append((i, high))
            top, at = tops[j - 1], min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][1] - c[hull[at + 1][0]] * top < hull[at][1] - c[hull[at][0]] * top:
                at += 1
            cut[layer, j] = i = hull[at][0]
            nxt[j] = hull[at][1] + top * (c[j] - c[i]) - s[j]
        best = nxt
    out, j = [], v
    for layer in range(k - 1, -1, -1):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[layer, j])
    return out[::-1]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: Column | None = None,
    buckets: int = 16,
    token_budget: int = 16384,
    rows_per_slice: int = 20000,
    keep: str | None = None,
) -> DataFrame:
    """One row per document: id, n_tokens, bucket, bucket_len, batch_id, slot, padding (all long).

    ``length`` is the token count to pack by; white-space words of ``text_col`` by default. ``keep`` names a column
    to pass through as the last one.
    """
    spark, stage = docs.sparkSession, Stage(docs.sparkSession, "packing")
    n = word_count(F.col(text_col)) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    kept = [F.col(keep).alias("kept")] if keep else []
    rows = stage.table(docs.select(F.col(id_col).alias("id"), n.alias("n_tokens"), F.monotonically_increasing_id().alias("row"), *kept))
    grid = (
        rows.groupBy(F.col("n_tokens").alias("top"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("s"))
        .collect()  # one row a distinct length
    )
    grid.sort(key=lambda r: r["top"])
    total = sum(r["n"] for r in grid)
    tops = optimal_boundaries(*(np.array([r[k] for r in grid], dtype=np.int64) for k in ("top", "n", "s")), buckets)
    tops = tops or [0]
    slices = even_slices(total, rows_per_slice)
    bounds = F.array(*[F.lit(t).cast("long") for t in tops])
    placed = (
        rows.withColumn("bucket", F.size(F.filter(bounds, lambda b: b < F.col("n_tokens"))).cast("long"))
        .withColumn("bucket_len", F.element_at(bounds, (F.col("bucket") + 1).cast("int")))
        .withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)))
    )
    counts = placed.groupBy("bucket", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("id", "row")) - 1)
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_len"), F.lit(1))).cast("long"))
    at = F.col("rank") + F.col("offset")
    return ranked.join(offsets, ["bucket", "slice"]).select(
        F.col("id").alias(id_col),
        "n_tokens",
        "bucket",
        "bucket_len",
        F.floor(at / room).cast("long").alias("batch_id"),
        F.pmod(at, room).cast("long").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        *([F.col("kept").alias(keep)] if keep else []),
    )
