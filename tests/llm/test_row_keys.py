"""Rows that share an id or have none, and corpora without labels, lose nothing that occurs once."""

from collections import Counter

import pytest
from pyspark.sql import functions as F


def passage(mark):
    return " ".join(f"{mark}{k}" for k in range(30))


def test_substring_rows_without_own_id(spark):
    from riskloom.llm.substring_dedup import remove_repeats

    p, q, r = map(passage, "pqr")
    rows = [(1, p), (None, p), (None, q), (2, p), (2, r), (None, None), (3, None), (None, ""), (2, f"{r} {q} tail")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), keep_text=True).collect()
    assert len(got) == len(rows)
    kept = Counter((g.doc_id, g.kept_text) for g in got)
    assert kept[(1, p)] == 1 and kept[(2, "")] in (1, 2) and kept[(None, "")] == 4 and kept[(3, "")] == 1
    # The two texts with r under id 2 come in an order of their hashes: r stays in one of them, q in that of id 2.
    assert (kept[(2, r)], kept[(2, f"{q} tail")]) == (1, 1) or (kept[(2, "")], kept[(2, f"{r} {q} tail")]) == (2, 1)
    left = Counter(w for g in got for w in g.kept_text.split())
    assert left == Counter(f"{p} {q} {r} tail".split())


def test_one_of_repeated_rows_stays(spark):
    from riskloom.llm.substring_dedup import remove_repeats

    rows = [(5, passage("p"))] * 3 + [(6, passage("p"))]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((g.doc_id, g.n_removed) for g in got) == [(5, 0), (5, 30), (5, 30), (6, 30)]


def test_row_keys(spark):
    from riskloom.llm.rows import row_keys

    rows = [(2, "b", "x"), (1, "a", "x"), (None, "c", "x"), (2, "b", "x"), (2, "b", "y"), (None, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(4)
    got = row_keys(docs, "doc_id").collect()
    assert sorted([tuple(g)[:3] for g in got], key=repr) == sorted(rows, key=repr)
    assert len({g["__key"] for g in got}) == len(rows)
    order = sorted(got, key=lambda g: g["__key"])
    assert [g.doc_id for g in order] == [1, 2, 2, 2, None, None]
    alone = row_keys(docs.filter("doc_id = 1"), "doc_id").collect()
    assert [a["__key"] for a in alone] == [1] and row_keys(docs.limit(0), "doc_id").count() == 0


@pytest.mark.parametrize("lang", [None, "en"])
def test_language_stage_keeps_texts(spark, lang):
    import corpus_pipeline

    rows = [(i, f"a text of some words number {i}", lang) for i in range(5)] + [(6, None, lang), (7, "123 !", lang), (8, "", lang)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.with_language(spark, docs, "")
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {0, 1, 2, 3, 4}


def test_thresholds_of_near_copies(spark):
    from riskloom.llm.near_dedup import agreeing, near_duplicates, trees_for

    assert (trees_for(85), agreeing(85)) == (8, 112) and trees_for(70) > 8 and agreeing(70) < 112
    rows = []
    for k in range(60):
        words = [f"g{k}w{i}" for i in range(100)]
        rows.append((2 * k, " ".join(words)))
        for at in (20, 50, 80):  # three words of a hundred change 15 shingles of 96 on either side: 81 of 111
            words[at] = f"other{k}x{at}"
        rows.append((2 * k + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_duplicates(docs, percent=72).filter("kept").count() == 60
    assert near_duplicates(docs, percent=75).filter("kept").count() == 120
    with pytest.raises(ValueError):
        near_duplicates(docs, percent=30)
