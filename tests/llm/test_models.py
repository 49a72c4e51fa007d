import zlib

import numpy as np
import pytest
from llm_cases import HARD, texts
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize("n", [1, 2, 4, 6, 7, 30])
def test_codewords(n):
    from riskloom.llm.language_id import codewords

    code = codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0}
    assert len(np.unique(code, axis=0)) == n


def test_every_ngram_once(monkeypatch):
    from riskloom.llm import language_id

    text = bytes(range(32, 127)) * 9
    whole = np.sort(np.concatenate(list(language_id.blocks(text))))
    monkeypatch.setattr(language_id, "BLOCK", 50)
    assert (np.sort(np.concatenate(list(language_id.blocks(text)))) == whole).all()
    assert len(whole) == 3 * len(text) - 3


def test_language(spark, hard, none):
    from riskloom.llm.language_id import fit, identify
    from riskloom.llm.samples import held_out

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held", held_out("doc_id"))
    rows = identify(docs, fit(docs)).collect()
    assert all(r.held == out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    got = {r.doc_id: r for r in identify(hard, fit(hard)).collect()}
    assert len(got) == len(HARD) and got[4].lang_pred == got[5].lang_pred == got[6].lang_pred == got[7].lang_pred == "und"
    assert all(got[i].lang_pred in ("en", "de", "fr") for i in (1, 10, 11, 12)) and got[1].score != "score"
    assert identify(none, fit(none)).collect() == []
    assert {r.lang_pred for r in identify(hard, None).collect()} == {"und"}


def test_scores_ignore_labels_and_ids(spark):
    from riskloom.llm.language_id import fit, identify

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs)
    same = identify(docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang")), model, carry=["doc_id"])
    want = {r.doc_id + 7: (r.lang_pred, r.score) for r in identify(docs, model, carry=["doc_id"]).collect()}
    assert {r.doc_id: (r.lang_pred, r.score) for r in same.collect()} == want


def test_gradient():
    from riskloom.llm.quality import FEATURES, Bags

    rng = np.random.default_rng(0)
    x, starts, labels = rng.normal(size=(9, FEATURES)), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])
    net = Bags(np.zeros(FEATURES), np.ones(FEATURES))
    loss = lambda: np.sum(np.logaddexp(0, f := net.forward(x, starts)["logit"]) - labels * f)
    f = net.forward(x, starts)
    grad = net.gradient(f, starts, 1 / (1 + np.exp(-f["logit"])) - labels)
    for name, w in net.p.items():
        at = tuple(rng.integers(0, n) for n in w.shape)
        keep = w[at]
        w[at] = keep + 1e-5
        up = loss()
        w[at] = keep - 1e-5
        down = loss()
        w[at] = keep
        assert grad[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_quality(spark, hard, none):
    from riskloom.llm.quality import features, fit, score

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    rows = score(docs, model).join(labels.select("doc_id", "quality"), "doc_id", "left").collect()
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.93
    bad, good = ([r.score for r in held if r.quality == q] for q in (0, 1))
    assert np.mean([b < g for b in bad for g in good]) > 0.95
    got = score(hard, model).collect()
    assert len(got) == len(HARD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in score(hard, fit(hard, labels.limit(0))).collect()} == {0.5}
    assert score(none, model).collect() == []
    assert len(features(b"a " * 200)) == 4 and not features(None).any()
    odd = labels.select("doc_id", F.lit(5).alias("quality")).unionByName(labels.select("doc_id", F.lit(None).cast("int").alias("quality")))
    assert fit(docs, odd) is None


def test_words_repeat(hard):
    assert texts()[14].split() == ["a"] * 30
