"""Operator 6: line dedup by a suffix array over line-id sequences. DataFrame functions only.

Each document is a sequence of line ids. Distributed prefix doubling ranks the suffixes by their first
1, 2, 4, ... lines: a level's keys are pairs of ranks of the level below, its repeated keys are sorted over
range partitions, and a key's place in that order is its rank, so ranks keep the lexicographic order of line
ids. Suffixes alone with their prefix have found their place in the array and go no further, so a level costs
what is still repeated and not the corpus. Suffixes with one rank form a longest-common-prefix interval.

A run of lines of any length is the intersection of two intervals (its first and its last power of two
lines), so equal runs are equal pairs of ranks. Deleted are the lines in a maximal repeated run of
``min_words`` words or more that has an earlier copy. Such a run is the union of its shortest sub-runs of
``min_words`` words: those that start at a line and those that end at one. (A line whose sub-run towards
the start of the run is too short lies in the shortest one from the start.) So only these two runs of each
line are looked up, doubling ends at the longest of them, and maximal runs are their union.

Document order is (id, text hash): the copy in the smallest id stays. Counts and minima are combined on the
map side and written before they are joined back, so AQE can split the rows of a line that is in a third of
all documents; windows are over one document's repeated lines.

Defined cases: null text counts as empty; lines are cut at line feeds and compared exactly; blank lines
count as lines without words; runs repeated inside one document count, too; rows that share id and text are
one document and get the same result; null ids come first; a document that loses all its lines has empty
text; an empty table gives no rows; all other columns are passed through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from kvasir.llm.common import Stage, whole, word_count

#: A document: whether its id is known, the id (0 where unknown) and the text hash; no part is null.
DOC = ["known", "doc", "th"]
SUFFIX = [*DOC, "pos"]


def _doc(doc: Column, kind: DataType, text: Column) -> list[Column]:
    return [doc.isNotNull().alias("known"), F.coalesce(doc, F.lit("0").cast(kind)).alias("doc"), F.xxhash64(text).alias("th")]


def _ranked(stage: Stage, keyed: DataFrame, by: list[str]) -> DataFrame:
    """(by, rank): the keys that more than one suffix has, ranked in their order."""
    at = F.struct(*SUFFIX)
    found = keyed.groupBy(*by).agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low <> high").select(*by)
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage.table(found.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()))


def _suffix_levels(stage: Stage, base: DataFrame, longest: int) -> list[DataFrame]:
    """(document, pos, rank) by 1, 2, 4, ... lines, up to ``longest`` lines or the longest repeat."""
    levels = [base]
    while 2 << (len(levels) - 1) <= longest:
        size = 1 << (len(levels) - 1)
        ahead = F.first("rank").over(Window.partitionBy(*DOC).orderBy("pos").rangeBetween(size, size))
        keyed = stage.table(levels[-1].select(*SUFFIX, F.col("rank").alias("r1"), ahead.alias("r2")).where("r2 IS NOT NULL"))
        ranks = _ranked(stage, keyed, ["r1", "r2"])
        if ranks.isEmpty():
            break
        levels.append(stage.table(keyed.join(ranks, ["r1", "r2"]).select(*SUFFIX, "rank")))
    return levels


def _short_runs(active: DataFrame, min_words: int) -> DataFrame:
    """(document, pos, size): for each repeated line, the shortest runs of repeated lines with ``min_words`` words from it and up to it."""
    doc = Window.partitionBy(*DOC).orderBy("pos")
    island = Window.partitionBy(*DOC, "island")
    runs = (
        active.withColumn("island", F.col("pos") - F.row_number().over(doc))
        .withColumn("after", F.sum("words").over(island.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.col("after") - F.col("words"))
        .withColumn("begin", F.min("pos").over(island))
        .withColumn("end", F.max("pos").over(island) + 1)
        .withColumn("total", F.sum("words").over(island))
        # The first line whose preceding words reach the bound ends the run from here; or the island does.
        .withColumn("stop", F.min("pos").over(island.orderBy("before").rangeBetween(min_words, Window.unboundedFollowing)))
        .withColumn("left", F.max("pos").over(island.orderBy("after").rangeBetween(Window.unboundedPreceding, -min_words)))
    )
    onward = runs.where(F.col("total") - F.col("before") >= min_words).select(*SUFFIX, (F.coalesce("stop", "end") - F.col("pos")).alias("size"))
    start = F.coalesce(F.col("left") + 1, "begin")
    back = runs.where(F.col("after") >= min_words).select(*DOC, start.alias("pos"), (F.col("pos") + 1 - start).alias("size"))
    return onward.union(back).distinct()


def deleted_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10) -> DataFrame:
    """(known, doc, th, begins, ends): for each document that loses lines, its disjoint ascending ranges of lines."""
    stage = Stage(docs.sparkSession, "lines")
    text = whole(F.col(text_col))
    split = docs.select(*_doc(F.col(id_col), docs.schema[id_col].dataType, text), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = stage.table(
        split.select(*SUFFIX, F.unhex(F.substring(F.sha2("line", 256), 1, 32)).alias("id"), word_count(F.col("line")).cast("int").alias("words"))
    )
    ranks = _ranked(stage, lines, ["id"])
    active = stage.table(lines.join(ranks, "id").select(*SUFFIX, "words", "rank").dropDuplicates(SUFFIX))
    runs = stage.table(_short_runs(active, min_words))
    longest = runs.agg(F.max("size")).first()[0] or 1
    levels = _suffix_levels(stage, active.select(*SUFFIX, "rank"), longest)
    ranked = levels[0].withColumn("level", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        ranked = ranked.unionByName(level.withColumn("level", F.lit(k)))
    level = F.floor(F.log2(F.col("size").cast("double"))).cast("int")
    sought = runs.withColumn("level", level).withColumn("tail", F.col("pos") + F.col("size") - F.expr("shiftleft(1, level)"))
    first, last = ranked.withColumnRenamed("rank", "r1"), ranked.withColumnRenamed("rank", "r2").withColumnRenamed("pos", "tail")
    named = stage.table(sought.join(first, [*SUFFIX, "level"]).join(last, [*DOC, "tail", "level"]).select(*SUFFIX, "size", "r1", "r2"))
    at, key = F.struct(*SUFFIX), ["size", "r1", "r2"]
    copied = stage.table(named.groupBy(*key).agg(F.min(at).alias("first"), F.max(at).alias("high")).where("first <> high").drop("high"))
    later = named.join(copied, key).where(at != F.col("first")).select(*DOC, "pos", (F.col("pos") + F.col("size")).alias("end"))
    doc = Window.partitionBy(*DOC).orderBy("pos", "end")
    reach = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        later.withColumn("fresh", F.when(reach.isNull() | (F.col("pos") > reach), 1).otherwise(0))
        .withColumn("range", F.sum("fresh").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*DOC, "range")
        .agg(F.min("pos").alias("begin"), F.max("end").alias("end"))
    )
    ranges = F.array_sort(F.collect_list(F.struct("begin", "end")))
    return stage.table(merged.groupBy(*DOC).agg(ranges.alias("cut")).select(*DOC, F.col("cut.begin").alias("begins"), F.col("cut.end").alias("ends")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, counts: bool = False) -> DataFrame:
    """The table with later copies of repeated runs of lines cut from ``text_col``.

    With ``counts``: columns n_lines and n_dropped (long) are added.
    """
    cuts = deleted_ranges(docs, id_col, text_col, min_words)
    row = docs.select(F.struct("*").alias("row"))
    row = row.select("row", *_doc(F.col(f"row.`{id_col}`"), docs.schema[id_col].dataType, whole(F.col(f"row.`{text_col}`"))))
    # Both sides are shuffled at every size: the ranges grow with the table.
    joined = row.join(cuts.hint("merge"), DOC, "left")
    text = F.col(f"row.`{text_col}`")
    lines = F.split(text, "\n", -1)
    zero = F.array(F.lit(0))
    kept = F.flatten(
        F.zip_with(F.concat(zero, "ends"), F.concat(F.col("begins"), F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 1, b - a))
    )
    cut = F.when(F.col("begins").isNull(), text).otherwise(F.array_join(kept, "\n"))
    out = [cut.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]
    if counts:
        gone = F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0), lambda t, x: t + x)
        out += [F.size(F.split(whole(text), "\n", -1)).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped")]
    return joined.select(*out)


#: The query over documents in DuckDB's SQL, from every run of lines and not only the shortest ones.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
w AS (SELECT doc_id, pos, line, dense_rank() OVER (ORDER BY line) AS id, count(*) OVER (PARTITION BY line) AS copies,
  len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM u),
i AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM w GROUP BY doc_id),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, sum(CASE WHEN copies = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS breaks FROM w),
r AS (SELECT a.doc_id, a.pos AS s, b.pos AS e, list_slice(i.ids, a.pos, b.pos) AS run FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND a.breaks = b.breaks JOIN i ON i.doc_id = a.doc_id
  WHERE a.copies > 1 AND b.upto - a.upto + a.words >= 10),
n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS copy FROM r),
x AS (SELECT DISTINCT c.doc_id, c.pos FROM c JOIN n ON c.doc_id = n.doc_id AND c.pos BETWEEN n.s AND n.e AND n.copy > 1)
SELECT c.doc_id, count(*) AS n_lines, count(x.pos) AS n_dropped, sha256(coalesce(string_agg(CASE WHEN x.pos IS NULL THEN c.line END, chr(10) ORDER BY c.pos), '')) AS text_sha256
FROM c LEFT JOIN x USING (doc_id, pos) GROUP BY c.doc_id
"""
