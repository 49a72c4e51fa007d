def test_one_row_of_each_group_stays(spark, tmp_path):
    """Repeated rows and rows without an id go through run() as one row of each group of copies or near copies."""
    import corpus_pipeline

    near = " ".join(f"term{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200))
    rows = [(1, "a text loaded twice", "en")] * 3 + [(None, "copies without any id", "en")] * 4 + [(None, near, "en"), (None, near.replace("termya", "other"), "en"), (9, "words of its own kind", "en")]
    rows += [(5, near.replace("termba", "another"), "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == [1, 5, 9, None]
