from kvasir.llm import spelling


def test_no_table_of_words_is_broadcast(spark):
    """Whatever the threshold: such a table is built in the driver."""
    words = spark.createDataFrame([("letter", 50), ("leter", 5), ("lettes", 6)], "word string, n long")
    for df in (spelling.links(words), spelling.forms(words)):
        df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    docs = spark.createDataFrame([(1, "letters " * 50 + "letterz " * 6)], "doc_id long, text string")
    df = spelling.group_variants(docs)
    assert {(r["word"], r["root"]) for r in df.collect()} == {("letters", "letters"), ("letterz", "letters")}
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
