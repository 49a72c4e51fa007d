"""Streams equal batches however the feed is cut, and the physical plans stay scalable."""

import brute
import pytest
from pyspark.sql import functions as F

from riskloom.operators import detectors, incidents as I, ranking as R
from riskloom.operators.sweep import Concentration, Count, Distinct, add_window_stats
from riskloom.plans import all_oracles, all_queries
from riskloom.streaming import operators as ST

SF = "/root/testdata/sf0.001"
SCHEMA = "seq long, attempt_uid string, ingest_ms long, merchant_id string, ip string, card_hash string, bin string, score double, x double"


def feed(spark, tmp_path, rows, files):
    """The rows as ``files`` files in time order, read one file per micro-batch."""
    path = str(tmp_path / f"feed{files}")
    size = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * size : (i + 1) * size]
        spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in part], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return ST.with_event_time(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), "0 seconds")


def drained(df, tmp_path, name):
    return ST.run_to_table(df, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-ckpt"))


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_batch(spark, tmp_path, files):
    rows = brute.stream(11, 200)
    batch = spark.createDataFrame(rows)
    source = feed(spark, tmp_path, rows, files)
    keys = ["merchant_id", "ip"]

    stats = [Count("n", 8_000), Distinct("d", "card_hash", 20_000), Concentration("hhi", "ent", "bin", 8_000)]
    columns = ["attempt_uid", "n", "d", "hhi", "ent"]
    got = {r[0]: r[1:] for r in drained(ST.stream_features(source, keys, stats, 0), tmp_path, "w").select(*columns).collect()}
    want = {r[0]: r[1:] for r in add_window_stats(batch, keys, stats).select(*columns).collect()}
    assert got.keys() == want.keys() and all(got[u] == pytest.approx(want[u], abs=1e-9) for u in want)

    got = {r["attempt_uid"]: (r["accepted"], r["stored_attempt_uid"]) for r in drained(ST.stream_dedupe(source, "card_hash", 9_000), tmp_path, "a").collect()}
    assert got == {u: (v[2] == 1, v[1]) for u, v in brute.anchored(rows, ["merchant_id", "card_hash"], 9_000).items()}

    got = {r["attempt_uid"]: r["drift_lambda"] for r in drained(ST.stream_sprt(source, keys, "score", 0.6), tmp_path, "s").collect()}
    want = {r["attempt_uid"]: r["drift_lambda"] for r in detectors.sprt_drift(batch, keys, "score", F.lit(0.6)).collect()}
    assert got.keys() == want.keys() and all(got[u] == pytest.approx(want[u], abs=1e-9) for u in want)


@pytest.mark.parametrize("files", [1, 3])
def test_stream_cusum_and_incidents(spark, tmp_path, files):
    rows = brute.stream(12, 240)
    batch = spark.createDataFrame(rows)
    source = feed(spark, tmp_path, rows, files)
    lam = {"m0": [0.05] * 24, "m1": [0.02 + 0.01 * h for h in range(24)]}
    rates = spark.createDataFrame(list(lam.items()), "merchant_id string, lam array<double>")
    counts = detectors.cusum_bucket_counts(batch, F.col("score") > 0.5)
    closed = drained(ST.stream_bucket_counts(source, F.col("score") > 0.5), tmp_path, "b")
    last = rows[-1]["ingest_ms"]
    whole = {(r[0], r[1]): r[2:] for r in counts.collect() if (r["bucket"] + 1) * 10_000 <= last}
    assert {(r[0], r[1]): r[2:] for r in closed.collect()} == whole
    again = str(tmp_path / "closed")
    closed.orderBy("bucket").coalesce(1).write.parquet(again)
    stream = spark.readStream.schema(closed.schema).parquet(again)
    got = {(r["merchant_id"], r["bucket"]): r["s"] for r in drained(ST.stream_cusum(stream, lam), tmp_path, "c").collect()}
    want = {(r["merchant_id"], r["bucket"]): r["s"] for r in detectors.poisson_cusum_sparse(counts, rates).collect()}
    assert got and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)

    shaped = lambda df: df.withColumns({"entity_type": F.lit("ip"), "entity_key": F.col("ip"), "fired": F.col("score") > 0.8})
    log = drained(ST.stream_incidents(shaped(source).select("merchant_id", "entity_type", "entity_key", "seq", "ingest_ms", "fired", "event_time"), 5_000), tmp_path, "i")
    final = {r["incident_id"]: r["s"] for r in log.groupBy("incident_id").agg(F.max_by("state", F.struct("at", F.when(F.col("state") == "CLOSED", 2).when(F.col("state") == "OPEN", 1).otherwise(0))).alias("s")).collect()}
    table = I.incident_sessions(shaped(batch), 5_000).filter("incident_id is not null").groupBy("incident_id").agg(F.max("last_fire_ms").alias("f")).collect()
    assert final == {r["incident_id"]: "CLOSED" if last >= r["f"] + 10_000 else "COOLING" if last >= r["f"] + 5_000 else "OPEN" for r in table}


def test_redelivered_batches_change_nothing(spark, tmp_path):
    lines = [(i, '{"attempt_uid": "u%d", "payload": {"attempt": {"attempt_uid": "u%d", "bin": "b"}, "incident": {"incident_id": "i%d", "state": "s%d"}}}' % (i, i, i % 3, i)) for i in range(20)]
    lines += [(20, lines[0][1]), (21, '{"attempt_uid": "torn')]
    source, sink = str(tmp_path / "spool"), str(tmp_path / "tables")
    spark.createDataFrame(lines, "seq long, value string").repartition(3).write.parquet(source)
    for name in ("first", "second"):  # a lost checkpoint re-delivers everything
        stream = spark.readStream.schema("seq long, value string").parquet(source)
        ST.stream_tables(stream, sink, str(tmp_path / name)).awaitTermination()
        assert ST.read_stream_table(spark, sink, "attempt").count() == 20
        assert {r["incident_id"]: r["state"] for r in ST.read_stream_table(spark, sink, "incident").collect()} == {"i0": "s0", "i1": "s19", "i2": "s17"}


# --- plans ------------------------------------------------------------------------------
def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "enrich_attempts", "feature_vector", "rules_r1_r2_r3", "idempotent_accept", "threat_rollup", "sprt_drift", "detector_label", "incident_sessions",
    "policy_resolve", "entity_overlap", "temporal_split", "b1_decline_velocity", "average_precision", "roc_auc", "univariate_audit", "verify_outcomes",
])
def test_no_nested_loops_and_no_cross_joins(spark, name):
    text = plan_text(all_queries()[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_one_shuffle_serves_all_statistics_of_a_key_space(spark):
    df = spark.createDataFrame(brute.stream(13, 30))
    stats = [Count("a", 1_000), Distinct("b", "card_hash", 9_000), Distinct("c", "bin", 500), Concentration("h", "e", "bin", 1_000)]
    assert plan_text(add_window_stats(df, ["merchant_id", "ip"], stats)).count("Exchange hashpartitioning") == 1


def test_scans_read_only_what_the_statistic_needs(spark):
    text = plan_text(all_queries()["attempts_per_ip_5m"](spark, SF))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in scan


def test_registry_is_complete():
    queries, oracles = all_queries(), all_oracles()
    assert set(oracles) <= set(queries) and len(queries) > 120
    assert len(queries) - len(oracles) < 12


def test_roc_by_stretches_matches_one_stretch(spark):
    df = spark.createDataFrame([(r["score"], r["x"] > 0, r["ip"]) for r in brute.stream(14, 300)], "score double, label boolean, g string")
    key = lambda parts: sorted(map(tuple, R.roc_points(df, ["g"], parts=parts).select("g", "tp", "fp", "threshold").collect()))
    assert key(1) == key(9)
