"""Operator 13: spelling variants, grouped by a symmetric-delete join.

Words are counted over whole texts in one pass, combined on the map side. Two words are near at exactly one inserted,
deleted or replaced code point. Every word emits itself and each of its single deletions, and words meet where they
share what they emitted:

* a deletion and the place it was made at: both words have that text around one letter, so one replaces it;
* a deletion and a whole word: the one has a letter more. Equal deletions (of one letter in a run of equal ones)
  are one key here.

So each key holds near words only: at most one word for each letter of the alphabet (or the word and its deletion),
whatever the number of words, and the join emits links, each once and in both directions, never the distance-two pairs
that share a deletion at different places. Keys are 64-bit hashes, so every link is verified by its exact distance.
A word's links are aggregated to their number and its form: the near word of largest n, if that is ``least_ratio``
times the word's own. Forms have a larger n than their words, so following them ends; the roots are found by joins
that double the way followed each round. Words grow with the input, so all joins are by sorted merges: a broadcast table
would be built in the driver.

Defined cases: null texts have no words; a null id counts as empty in the hash that damages runs; repeated rows
count again; very long runs are words like others (their deletions travel as hashes); ties go to the smallest word
in code-point order; without near words n_near is 0 and form null; an empty table gives no rows. Other columns are
ignored whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvasir.llm.common import Stage, whole

LETTERS = r"A-Za-zÀ-ÿ"


def runs(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, run): the runs of letters of ``least`` code points and more, A-Z in lower case, a row each time."""
    low = F.translate(whole(F.col(text_col)), string.ascii_uppercase, string.ascii_lowercase)
    found = F.filter(F.split(low, f"[^{LETTERS}]+"), lambda r: F.length(r) >= least)
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))


def without(word: Column, at: Column) -> Column:
    """The word less its code point number ``at``, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def damaged(rows: DataFrame, every: int) -> Column:
    """The run, less a code point where ``every`` divides the crc32 of id and run."""
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    return F.when(h % every == 0, without(F.col("run"), (h % F.length("run")).cast("int"))).otherwise(F.col("run"))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_n: int = 5, every: int = 199) -> DataFrame:
    """(word, n): the words that are long and frequent enough."""
    rows = runs(docs, id_col, text_col, least_length)
    counted = rows.select(damaged(rows, every).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") >= least_n) & (F.length("word") >= least_length))


def deletions(words: DataFrame) -> DataFrame:
    """(word, n, at, key, first): a row for each code point; ``first`` where the deletion wasn't made one place before."""
    w = F.col("word")
    keys = F.transform(F.sequence(F.lit(0), F.length(w) - 1), lambda i: F.xxhash64(without(w, i)))
    rows = words.select("word", "n", F.posexplode(keys).alias("at", "key"))
    same = F.substring(w, F.col("at"), F.lit(1)) == F.substring(w, F.col("at") + 1, F.lit(1))
    return rows.withColumn("first", (F.col("at") == 0) | ~same)


def links(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): the pairs at distance one, each in both directions."""
    made = deletions(words)
    near_made = made.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "at", "key")
    exact = F.levenshtein("word", "near", 1) == 1
    replaced = made.select("word", "n", "at", "key").join(near_made.hint("merge"), ["key", "at"]).where((F.col("word") != F.col("near")) & exact).select("word", "n", "near", "near_n")
    itself = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.xxhash64("word").alias("key"))
    shorter = made.where("first").select("word", "n", "key").join(itself.hint("merge"), "key").where(exact).select("word", "n", "near", "near_n")
    longer = shorter.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return replaced.union(shorter).union(longer)


def forms(words: DataFrame, least_ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n) for every word."""
    best = links(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("b"))
    found = words.join(best.hint("merge"), "word", "left")
    enough = -F.col("b.less") >= least_ratio * F.col("n")
    return found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("b.near")).alias("form"), F.when(enough, -F.col("b.less")).alias("form_n")
    )


def roots(found: DataFrame, stage: Stage) -> DataFrame:
    """(word, root) for the words that have a form: from each, the forms followed to the last."""
    step = stage.table(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        new = stage.table(step.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")))
        stage.drop(step)
        step = new
        if new.where("moved").isEmpty():
            return new.select("word", "root")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_n: int = 5, least_ratio: int = 5, every: int = 199) -> DataFrame:
    """(word, n, n_near, form, form_n, root): one row per word."""
    stage = Stage(docs.sparkSession, "spelling")
    words = stage.table(count_words(docs, id_col, text_col, least_length, least_n, every))
    found = stage.table(forms(words, least_ratio))
    return found.join(roots(found, stage).hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


#: The same in DuckDB's SQL: crc32 by its table, a byte at a time; every pair that shares a deletion, by edit distance.
ORACLE_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i:
    list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
each AS MATERIALIZED (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS MATERIALIZED (SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x), 2), lambda i: CAST('0x' || substr(x, CAST(i AS INTEGER) + 1, 2) AS BIGINT))),
    lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS INTEGER) + 1])), 4294967295) AS h FROM each, crc),
w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM
    (SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM hashed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
keys AS MATERIALIZED (SELECT DISTINCT word, n, key FROM (SELECT word, n, unnest(list_transform(range(length(word)), lambda i: substr(word, 1, CAST(i AS INTEGER)) || substr(word, CAST(i AS INTEGER) + 2))) AS key FROM w
    UNION ALL SELECT word, n, word FROM w)),
near AS MATERIALIZED (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM keys a JOIN keys b USING (key) WHERE a.word <> b.word
    AND abs(length(a.word) - length(b.word)) <= 1 AND (length(a.word) <> length(b.word) OR
      len(list_filter(range(length(a.word)), lambda i: substr(a.word, CAST(i AS INTEGER) + 1, 1) <> substr(b.word, CAST(i AS INTEGER) + 1, 1))) = 1)
    AND (length(a.word) = length(b.word) OR key IN (a.word, b.word))),
best AS (SELECT word, n_near, near, near_n FROM (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near) WHERE r = 1),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
way AS (SELECT word, word AS root FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form, f.form_n, way.root FROM f JOIN way ON way.word = f.word JOIN f last ON last.word = way.root AND last.form IS NULL
"""
