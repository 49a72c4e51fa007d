"""The anchored counter on keys that are cut into chunks."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from riskloom.operators import counters
from test_operators import by_uid, frame

FIELDS = ("anchor_ms", "anchor_uid", "ordinal")


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def dense(seed, n, gap):
    """One key with a moment in most milliseconds, repeated ones and rare long pauses."""
    rng, t, rows = random.Random(seed), 5_000, []
    for i in range(n):
        t += rng.choice(gap) + (900 if rng.random() < 0.004 else 0)
        rows.append({"seq": i, "attempt_uid": f"u{i}", "ingest_ms": t, "merchant_id": "m", "ip": "hot" if rng.random() < 0.9 else None})
    return rows


@pytest.mark.parametrize("ttl", [300, 9_000, 400_000])
@pytest.mark.parametrize("chunk", [200, 3_000, 50_000])
def test_chunked_keys_count_like_whole_ones(spark, small_batches, ttl, chunk):
    rows = brute.stream(3, 400)
    got = counters.anchored_ttl_counter(frame(spark, rows), ["merchant_id", "ip"], ttl, hot_rows=5, chunk_ms=chunk)
    assert by_uid(got, *FIELDS) == brute.anchored(rows, ["merchant_id", "ip"], ttl)


@pytest.mark.parametrize("gap", [[1], [0, 1, 1, 2], [1, 3, 7]])
@pytest.mark.parametrize("ttl", [1, 17, 130, 1_000])
def test_dense_moments(spark, gap, ttl):
    rows = dense(len(gap), 1_200, gap)
    got = counters.anchored_ttl_counter(frame(spark, rows), ["merchant_id", "ip"], ttl, hot_rows=50, chunk_ms=100)
    assert by_uid(got, *FIELDS) == brute.anchored(rows, ["merchant_id", "ip"], ttl)


def test_pieces_of_adjoining_moments_are_few(spark):
    import pandas as pd

    made = counters._jumps(["k", "_chunk"], "t", 60)(("a", 0), pd.DataFrame({"t": range(3_600)}))
    assert len(made) <= 2 * 3_600 // 60
    covered = {}
    for first, to, last, flat in made[["_from", "_to", "_last", "_flat"]].itertuples(index=False):
        covered.update({t: last if flat else last + t - first for t in range(first, to + 1)})
    assert covered == {t: t + (3_599 - t) // 60 * 60 for t in range(3_600)}


def test_no_task_holds_a_hot_key(spark):
    rows = dense(7, 2_000, [1])
    df = frame(spark, rows).withColumn("digest", F.col("ip"))
    out = counters.idempotent_accept(df, "digest", 100, hot_rows=50, chunk_ms=250)
    want = brute.anchored(rows, ["merchant_id", "ip"], 100)
    assert by_uid(out, "accepted", "stored_attempt_uid") == {u: (n == 1, a) for u, (_, a, n) in want.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan and "FlatMapGroupsInPandas" in plan


def test_late_chunks_without_an_anchor_and_empty_input(spark):
    rows = [{"seq": i, "attempt_uid": f"u{i}", "ingest_ms": t, "merchant_id": None, "ip": "x"} for i, t in enumerate((0, 0, 5, 90, 100, 1_000, 1_040, 1_101, 1_101))]
    schema = "seq long, attempt_uid string, ingest_ms long, merchant_id string, ip string"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = counters.shed_counter(df, 100, hot_rows=2, chunk_ms=50)
    want = brute.anchored(rows, ["merchant_id", "ip"], 100)
    assert by_uid(got, "shed_count") == {u: n for u, (_, _, n) in want.items()}
    assert counters.shed_counter(df.limit(0), 100, hot_rows=2).count() == 0
