"""Null is a group like any other, and no plan depends on the size of the input."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import calibration, counters, prefix, ranking

ROWS = [
    # seq, merchant, event, ip, payload, ms
    (1, "m", None, None, "p", 10), (2, "m", None, "a", "q", 20), (3, "m", "e", None, "p", 30), (4, "m", "e", "a", "p", 40),
    (5, "m", None, None, "q", 50), (6, None, "e", "a", None, 60), (7, "m", None, None, None, 70), (8, None, "e", None, None, 80),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "seq long, merchant_id string, event_id string, ip string, payload_digest string, ingest_ms long").withColumn("attempt_uid", F.col("seq").cast("string"))


@pytest.mark.parametrize("hot_rows", [0, 2, 10_000_000])
def test_running_distinct(rows, hot_rows):
    got = {r.seq: r.n for r in prefix.running_distinct(rows, ["merchant_id", "event_id"], "payload_digest", "n", hot_rows=hot_rows, chunk_ms=15).collect()}
    want = {}
    seen = {}
    for seq, merchant, event, _, payload, _ in ROWS:
        seen.setdefault((merchant, event), set()).add(payload)
        want[seq] = len(seen[merchant, event])
    assert got == want


@pytest.mark.parametrize("hot_rows", [0, 2, 10_000_000])
def test_running_and_walk(rows, hot_rows):
    summed = prefix.running(rows, ["ip"], {"n": ("sum", F.lit(1)), "low": ("min", F.col("seq"), "before")}, hot_rows=hot_rows, chunk_ms=15)
    walked = prefix.reflected_walk(rows, ["ip"], F.when(F.col("seq") % 2 == 0, 1.0).otherwise(-0.5), "s", hot_rows=hot_rows, chunk_ms=15)
    count, first, s = {}, {}, {}
    for row in sorted(ROWS):
        ip, seq = row[3], row[0]
        count[ip] = count.get(ip, 0) + 1
        s[ip] = max(0.0, s.get(ip, 0.0) + (1.0 if seq % 2 == 0 else -0.5))
        first.setdefault(ip, seq)
        assert summed.filter(F.col("seq") == seq).first()["n"] == count[ip]
        assert walked.filter(F.col("seq") == seq).first()["s"] == s[ip]
    assert {r.seq: r.low for r in summed.collect()} == {r[0]: None if first[r[3]] == r[0] else first[r[3]] for r in ROWS}


def test_counters_keep_null_keys(rows):
    got = {r.seq: r.shed_count for r in counters.shed_counter(rows, ttl_ms=45).collect()}
    want, anchor, count = {}, {}, {}
    for seq, merchant, _, ip, _, ms in ROWS:
        key = (merchant, ip)
        if key not in anchor or ms >= anchor[key] + 45:
            anchor[key], count[key] = ms, 0
        count[key] += 1
        want[seq] = count[key]
    assert got == want


def test_metrics_keep_the_null_group(spark):
    df = spark.createDataFrame([(g, s / 10, (s * 7 + o) % 3 == 0, o) for o, g in enumerate((None, "x") * 20) for s in (o % 9,)], "g string, score double, label boolean, ordinal long")
    filled = df.withColumn("g", F.coalesce("g", F.lit("none")))
    for metric in (ranking.roc_auc, ranking.average_precision, lambda d, by: ranking.recall_at_fpr(d, 0.3, by), ranking.roc_points):
        a = sorted((r.g or "none", *(tuple(r)[1:])) for r in metric(df, ["g"]).collect())
        b = sorted((r.g, *(tuple(r)[1:])) for r in metric(filled, ["g"]).collect())
        assert len(a) == len(b) >= 2 and repr(a) == repr(b)
    assert calibration.prevalence_weights(df, 0.2, ["g"]).filter("weight is null").count() == 0
    assert calibration.prevalence_weights(df, 0.2, ["g"]).count() == df.count()
    assert calibration.reliability_bins(df, 4, ["g"]).filter("g is null and weight > 0").count() == calibration.reliability_bins(filled, 4, ["g"]).filter("g = 'none' and weight > 0").count() > 0


@pytest.mark.parametrize("parts", [1, 3])
def test_value_order_with_null_groups(spark, parts):
    from riskloom.operators.ranked import exact_quantiles

    df = spark.createDataFrame([(None if k % 2 else "x", float(k)) for k in range(41)], "g string, v double")
    got = {(r.g, r.q): r.value for r in exact_quantiles(df, ["g"], "v", [0.0, 0.5, 1.0], parts=parts).collect()}
    assert got == {("x", 0.0): 0.0, ("x", 0.5): 20.0, ("x", 1.0): 40.0, (None, 0.0): 1.0, (None, 0.5): 20.0, (None, 1.0): 39.0}


def test_split_reads_each_side_twice_at_most(spark, tmp_path):
    from riskloom.operators.samples import three_way_temporal_slice

    rows = spark.range(200).select(F.col("id").alias("ingest_ms"), F.when(F.col("id") % 7 == 0, F.concat(F.lit("e"), F.floor(F.col("id") / 20))).alias("episode_id"))
    rows.write.parquet(str(tmp_path / "rows"))
    out = three_way_temporal_slice(spark.read.parquet(str(tmp_path / "rows")), embargo_ms=3)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 6
    assert {r.split for r in out.select("split").distinct().collect()} == {"fit", "earlystop", "calib"}
