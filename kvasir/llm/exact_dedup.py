"""Operator 7: exact dedup by skew-safe combining.

Texts are equal when identical after each run of white space is replaced by one space. Groups are
merged in three stages, each keyed by the digest *and the whole normalised text*, so contents and not
only digests are compared:

1. locally: the map side of the first aggregation leaves one row per text and input partition;
2. salted: rows of one text from many partitions meet in ``salts`` groups, keyed by (salt, text);
3. globally: the at most ``salts`` winners of each text are combined.

So a text that holds a third of all rows reaches any task as at most one row for each input partition.

Defined cases: null text counts as empty; a null id never wins against another and a group of null ids
keeps ``keep_id`` null with all rows kept; repeated rows each get a row; an empty table gives no rows;
other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvasir.llm.common import Stage, one_space


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size (long), kept (boolean), text_sha256."""
    rows = docs.select(F.col(id_col).alias("id"), one_space(F.col(text_col)).alias("norm")).withColumn("digest", F.sha2("norm", 256))
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("salt", "digest", "norm")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    groups = (
        salted.groupBy("digest", "norm")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .select("digest", "keep_id", "group_size")
        .groupBy("digest")
        .agg(F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    )
    # Written, so that the join below shuffles both sides itself and AQE can split a hot digest's rows.
    groups = Stage(docs.sparkSession, "exact").table(groups)
    one_text = F.when(F.col("texts") > 1, F.raise_error(F.lit("two different texts have one SHA-256"))).otherwise(F.col("keep_id"))
    return rows.select("id", "digest").join(groups, "digest").select(
        F.col("id").alias(id_col),
        one_text.alias("keep_id"),
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


#: The same in DuckDB's SQL.
ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""
