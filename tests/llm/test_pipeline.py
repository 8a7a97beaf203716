"""The pipeline's stages on a small table, each against its own definition, and the whole run."""

import regex

import corpus_pipeline
from kvasir.llm import pii, token_counts
from kvasir.llm.queries import vocabulary
from tests.llm.test_line_dedup import brute as lines_by_brute_force
from tests.llm.test_minhash import brute as copies_by_brute_force


def test_stages_on_the_smallest_table(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    junk = spark.createDataFrame([(9000, "12 34 --", "en", "x", 8), (9001, None, "en", "x", 0), (9002, "", None, None, 0)], docs.schema)
    docs, columns = docs.union(junk), docs.columns
    names = pii.Pseudonyms(corpus_pipeline.DEMO_KEY)
    for name, function in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = function(spark, docs, d)
        out.write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        rows = {r["doc_id"]: r for r in docs.collect()}
        if name != "length_buckets":
            assert docs.columns == columns and len(rows) == docs.count()
            after = {i: r["text"] for i, r in rows.items()}
        if name == "language_id":
            assert not {9000, 9001, 9002} & after.keys() and len(after) >= 0.97 * (len(before) - 3)
            assert all(before[i] == t for i, t in after.items())
        elif name == "line_runs":
            expected = lines_by_brute_force(list(before.items()), 10)
            assert after == {i: t for (i, _), t in expected.items() if t.strip()}
        elif name == "near_duplicates":
            expected = copies_by_brute_force(list(before.items()))
            assert after.keys() == {i for i, (_, c) in expected.items() if i == c}
        elif name == "pseudonyms":
            assert after == {i: names.replace(t)[0] for i, t in before.items()}
        else:
            assert rows.keys() == before.keys()
            assert all(r["text"] == before[i] for i, r in rows.items()) and {"lang", "source"} <= set(docs.columns)
            automaton, _ = token_counts.load(vocabulary("byte_bpe_50k.tiktoken"))
            words = regex.compile(token_counts.WORDS).findall
            assert all(r["n_tokens"] == sum(automaton.count(w.encode()) for w in words(before[i])) for i, r in rows.items())


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.count() <= 200 and {"doc_id", "bucket", "batch_id"} <= set(out.columns)


def test_stages_on_odd_rows(spark):
    """Nulls anywhere, repeated rows, rows of one id, a very long text, and columns named like those the stages add."""
    text = "the quick brown fox of {} jumps over the lazy dog and runs away from all the others in the field near the old house"
    rows = [(1, text.format("one"), "en", None), (1, text.format("one"), "en", None), (2, None, None, None), (None, text.format("null"), "en", "s"), (3, "", "en", "s"), (4, "12 34", None, "s"), (5, "word " * 60_000, "en", "s")]
    rows += [(k, " ".join(f"w{k}x{i}" for i in range(40)) + f" mail a{k}@b.org", "en", "s") for k in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("row", "bucket", "kept", "n_tokens", "id", "kept_id", "spans", "class", "pii_spans", "Bucket_len"):
        docs = docs.withColumn(name, docs["doc_id"])
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, "")
        got = sorted((r["doc_id"] or -1) for r in out.collect())
        if name == "language_id":
            assert got == [-1, 1, 1, 5, *range(10, 30)]
        elif name == "line_runs":
            assert got == [-1, 1, 1, 4, 5, *range(10, 30)]
        elif name == "near_duplicates":
            assert got == [-1, 1, 1, 2, 3, 4, 5, *range(10, 30)]
        else:
            assert got == sorted((r[0] or -1) for r in rows)
        assert function(spark, docs.limit(0), "").count() == 0
        if name == "length_buckets":
            assert {"bucket", "bucket_", "Bucket_len_", "n_tokens_", "text", "lang"} <= set(out.columns)
        else:
            assert out.columns == docs.columns
