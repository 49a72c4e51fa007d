"""The closed forms and chunk maps of the token bucket against one step per run."""

import random

import numpy as np
import pytest

import brute
from riskloom.operators import admission
from test_operators import by_uid, frame


def stepped(scale, full, level, gains, counts):
    out = []
    for g, n in zip(gains, counts):
        level = min(full, level + g)
        out.append(min(n, level // scale))
        level -= scale * out[-1]
    return out, level


def load(rng, n, scale, full):
    """Idle stretches, floods and a rate near the refill, one after another."""
    gains, counts = [], []
    while len(gains) < n:
        kind, length = rng.randrange(3), rng.randint(1, 40)
        for _ in range(length):
            gains.append(rng.randint(0, [2 * full + 3, 2, 2 * scale][kind]))
            counts.append([rng.randint(0, 1), rng.randint(0, full // scale + 2), rng.randint(0, 3)][kind])
    return np.array(gains[:n]), np.array(counts[:n])


@pytest.mark.parametrize("scale,burst", [(1, 1), (1, 7), (3, 4), (20, 10), (20, 200), (7, 0)])
def test_closed_forms_and_maps(scale, burst):
    rng, full = random.Random(scale * 1000 + burst), scale * burst
    bucket = admission.Bucket(scale, full)
    for _ in range(150):
        gains, counts = load(rng, rng.choice([1, 2, 5, 60, 300]), scale, full)
        piece = bucket.chunk_map(gains, counts)
        for level in {0, full, full // 2, *(rng.randint(0, full) for _ in range(25))}:
            want, end = stepped(scale, full, level, gains.tolist(), counts.tolist())
            made, after = bucket.admitted(level, gains, counts)
            assert made.tolist() == want and after == end
            assert bucket.through(level, *piece) == end


@pytest.mark.parametrize("rate,burst", [(50, 3), (1, 2), (3, 5), (1000, 4)])
@pytest.mark.parametrize("plan", [{}, {"hot_rows": 5, "chunk_ms": 700}, {"hot_rows": 250, "chunk_ms": 60_000}])
def test_small_batches_and_null_merchants(spark, rate, burst, plan):
    rows = brute.stream(11, 500)
    for r in rows:
        r["merchant_id"] = None if r["merchant_id"] == "m1" else r["merchant_id"]
    want = brute.tokens(rows, rate, burst)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = by_uid(admission.token_bucket(frame(spark, rows), rate, burst, **plan), "admitted")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_no_attempts(spark):
    empty = frame(spark, brute.stream(1, 5)).limit(0)
    assert admission.token_bucket(empty).count() == 0
