import duckdb
import pytest


@pytest.mark.parametrize("block_windows", [10, 200_000])
def test_items_without_id_are_searched(spark, tmp_path, hard, monkeypatch, block_windows):
    """The query equals its SQL and the pipeline's stage drops the documents where benchmark ids are null."""
    import corpus_pipeline
    from riskloom.llm import decontaminate
    from riskloom.llm.queries import CONTAMINATION_SQL, op10_decontaminate

    monkeypatch.setitem(decontaminate.decontaminate.__kwdefaults__, "block_windows", block_windows)
    docs = hard.filter("doc_id is not null")
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.createDataFrame([(None, "one two"), (None, "a a a"), (7, "wort"), (None, None), (8, "wort wort"), (None, "wort")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = op10_decontaminate(spark, str(tmp_path))
    want = duckdb.sql(CONTAMINATION_SQL)
    assert got.columns == want.columns
    rows = {r.doc_id: tuple(r) for r in got.collect()}
    assert rows == {r[0]: r for r in want.fetchall()}
    assert all(rows[i][2] > 0 and rows[i][3] == 0 and rows[i][5] for i in (8, 9, 14)) and rows[10][3] == 2
    assert {8, 9, 10, 14}.isdisjoint(r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, str(tmp_path)).collect())
