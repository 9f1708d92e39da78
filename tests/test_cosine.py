"""The cosine of documents 50 ids apart, over rows built here."""
import __spark_entry__ as entry


def test_token_cosine_moves_words_once_and_keeps_repeated_ids(spark, tmp_path):
    rows = [(1, "red red apple"), (51, "red pear"), (101, None), (2, ""), (52, "plum"), (1, "pear"), (None, "red"), (60, "kiwi"), (110, "kiwi kiwi")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = entry.queries()["token_cosine"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    got = sorted(((r.doc_id, r.cosine) for r in out.collect()))
    # Both rows of id 1 count as one bag: red 2, apple 1, pear 1 against red 1, pear 1.
    assert got == [(1, 0.866025), (1, 0.866025), (2, 0.0), (51, 0.0), (60, 1.0)]
    assert plan.count("generate inline") + plan.count("Generate inline") == 1 and plan.count("Generate explode") == 1
