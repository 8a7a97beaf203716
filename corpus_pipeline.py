"""The corpus pipeline: five of the ten operators applied one after another to documents.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next stage's docs.

All stages take tables with nulls in any column, texts of any length, repeated rows and further columns of any
name; an empty table gives an empty one. Each says below what becomes of such rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvasir.llm import language, line_dedup, minhash, packing, pii, token_counts
from kvasir.llm.common import Stage
from kvasir.llm.queries import DEMO_KEY, vocabulary

#: A document goes when no language was found in it, or none has this share of its letters.
LEAST_SCORE = 0.5
#: The session's setting that names the key of the pseudonyms. Without it they are made with a public key, by which
#: anyone can find out a value: set it to a secret in production.
KEY_SETTING = "spark.kvasir.pseudonymKey"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one language stay; those that are undetermined, or mixed without a main language, go.

    Null and empty texts, and those without a letter, are undetermined. Rows are judged one by one, so repeated rows
    all stay or all go, and null ids, languages and sources don't matter; without labelled rows all go.
    """
    found = language.identify(docs.select(F.struct("*").alias("row"), "text"), language.fit_on_fold(docs), keep=["row"])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and with them documents that were nothing else.

    Documents that are null, empty or blank go, too. Rows with one id and text are one document, which all stay or
    all go with one text; null ids come first in the order of documents.
    """
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.where(F.coalesce(F.trim(F.col("text")), F.lit("")) != "")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id.

    Texts without words are no copies and stay, as do rows without an id, which can't be told apart. Rows of one id are
    one document: they stay if the id is the smallest of its group.
    """
    kept = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    # Both sides are shuffled at every size: the ids that stay grow with the table.
    with_id = docs.join(kept.hint("merge"), "doc_id", "left_semi")
    return with_id.select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.where(docs["doc_id"].isNull()))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses are replaced by pseudonyms, under the key of KEY_SETTING.

    All rows stay, each with its own text; null texts stay null.
    """
    key = spark.conf.get(KEY_SETTING, None)
    out = pii.pseudonymise(docs, key.encode() if key else DEMO_KEY, spans_col=None)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def length_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, and its number of word pieces, its bucket, batch and place in it.

    All rows stay, each with a place of its own; null texts have 0 pieces; rows of one length and id are placed in
    any order. A column of ``docs`` that is named like one of the packing's gets underscores.
    """
    others = [c for c in docs.columns if c != "text"]
    row = docs.select(F.struct(*others).alias("row"), "text")
    counted = token_counts.count_tokens(row, vocabulary("byte_bpe_50k.tiktoken"), keep=["row", "text"])
    counted = counted.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", F.struct("row", "text").alias("kept"))
    packed = packing.pack(counted, length=F.col("n_tokens"), keep="kept")
    names = [c for c in packed.columns if c != "kept"]
    free = {c: c for c in docs.columns}
    for c in docs.columns:
        while c != "doc_id" and free[c].lower() in (n.lower() for n in names):
            free[c] += "_"
    of_docs = [F.col("kept.text" if c == "text" else f"kept.row.`{c}`").alias(free[c]) for c in docs.columns if c != "doc_id"]
    return packed.select(*names, *of_docs)


STAGES = [
    ("language_id", language_id),
    ("line_runs", line_runs),
    ("near_duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("length_buckets", length_buckets),
]

#: Learning, hashing and pseudonyms can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each one's result is written and reread."""
    stage, docs = Stage(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage.table(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
