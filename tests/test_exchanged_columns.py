"""Rows are dealt once for a key space and take along only what is still read."""

import random
from datetime import datetime, timedelta

import brute
import pytest
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.operators import counters, prefix
from riskloom.operators.decision import decide
from riskloom.operators.features import enrich_attempts, feature_vector
from riskloom.operators.sweep import Count, add_window_stats
from riskloom.plans.views import DAY, shape_attempts
from riskloom.plans.windows import RULES, WIDTHS
from test_operators import by_uid, frame

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark, n=400):
    draw, start = random.Random(5), datetime(2024, 1, 1)
    kinds = ["view", "click", "purchase", "signup", "error"]
    rows = [(i, start + timedelta(minutes=draw.randrange(20_000)), draw.randrange(9), draw.choice(kinds), draw.random() * 600, f'{{"k": {draw.randrange(30)}}}') for i in range(n)]
    return shape_attempts(spark.createDataFrame(rows, EVENTS))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_vector_deals_rows_once_for_a_key_space(spark):
    out = feature_vector(enrich_attempts(events(spark, 50)), WIDTHS).select("attempt_uid", *K.FEATURE_NAMES)
    assert plan_of(out).count("Exchange hashpartitioning") == 7  # cards, event ids and five window spaces


def test_columns_nobody_reads_do_not_travel(spark):
    df = frame(spark, brute.stream(3, 40)).withColumn("wide", F.sha2("attempt_uid", 256))
    assert "wide" not in plan_of(add_window_stats(df, ["merchant_id", "ip"], [Count("n", 1_000)]).select("attempt_uid", "n"))


@pytest.mark.parametrize("ttl", [300, 9_000, 400_000])
def test_anchors_are_carried_from_batch_to_batch(spark, ttl):
    rows = [{**r, "ip": None if i % 5 == 0 else r["ip"]} for i, r in enumerate(brute.stream(8, 300))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = counters.anchored_ttl_counter(frame(spark, rows), ["merchant_id", "ip"], ttl)
        assert by_uid(out, "anchor_ms", "anchor_uid", "ordinal") == brute.anchored(rows, ["merchant_id", "ip"], ttl)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert plan_of(out).count("Exchange hashpartitioning") == 1


def test_hot_keys_are_counted_by_hash_first(spark):
    df = spark.createDataFrame([("m", None)] * 30 + [("m", f"k{i}") for i in range(40)] + [(None, "k")] * 25, "merchant_id string, ip string")
    hot = prefix.hot_keys(df, [["merchant_id", "ip"], ["merchant_id"], ["ip"]], 20)
    assert {k: sorted(map(tuple, v.collect()), key=str) for k, v in hot.items()} == {
        ("merchant_id", "ip"): sorted([("m", None), (None, "k")], key=str), ("merchant_id",): sorted([("m",), (None,)], key=str), ("ip",): sorted([(None,), ("k",)], key=str),
    }
    assert prefix.find_hot(df, ["ip"], 30) is None


def test_decide_leaves_out_only_columns_that_are_not_asked_for(spark):
    lam = spark.createDataFrame([(f"m{i}", [0.05] * 24) for i in range(4)], "merchant_id string, lam array<double>")
    run = lambda **kw: decide(events(spark), lam, 3.0, widths=WIDTHS, rules=RULES, policy={**K.POLICY, "cooldown_s": 12 * 3600}, cusum=K.CUSUM, ttl_ms=2 * DAY, **kw)
    some, whole = run(columns=["attempt_uid"]), run()
    names = sorted(set(some.columns))
    key = lambda df: sorted(map(str, df.select(*names).collect()))
    assert key(some) == key(whole)
    assert "payload_digest" in whole.columns and "payload_digest" not in names and {"in_force_tier", "attempts_before", "rules_fired"} <= set(names)
