"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvasir.llm import ball_kmeans, embedding_dedup, exact_dedup, language, line_dedup, minhash, packing, pieces, pii, quality, secrets, spelling, token_counts
from kvasir.llm.common import documents


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, which every executor has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The key of the registered query; a production run passes its own secret.
DEMO_KEY = b"kvasir public demonstration key"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), DEMO_KEY))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.encode_decode(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model")))


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths are the word-piece counts of operator 5."""
    counted = token_counts.count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"))
    return packing.pack(counted, length=F.col("n_tokens"))


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository is a source's documents in one language, its owner the source."""
    repo = F.concat(F.col("source"), F.lit("/"), F.col("lang"))
    return secrets.digest(secrets.scan(documents(spark, sf_dir), "doc_id", "text", repo, F.col("source")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op8_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(documents(spark, sf_dir, "embeddings"))


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op10_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = language.identify(docs, language.fit_on_fold(docs))
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.ball_kmeans(documents(spark, sf_dir, "embeddings"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = quality.score(docs, quality.fit_on_fold(docs, documents(spark, sf_dir, "labels")))
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_feistel_pseudonyms, op2_piece_codec, op3_length_buckets, op4_secret_ownership, op5_token_counts, op6_line_runs, op7_exact_dedup, op8_hnsw_near_dedup, op9_minmax_near_dedup, op10_language_spans, op11_ball_kmeans, op12_quality, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_secret_ownership": secrets.ORACLE_SQL,
        "op6_line_runs": line_dedup.ORACLE_SQL,
        "op7_exact_dedup": exact_dedup.ORACLE_SQL,
        "op8_hnsw_near_dedup": embedding_dedup.ORACLE_SQL,
        "op9_minmax_near_dedup": minhash.ORACLE_SQL,
        "op11_ball_kmeans": ball_kmeans.ORACLE_SQL,
        "op13_spelling_variants": spelling.ORACLE_SQL,
    }
