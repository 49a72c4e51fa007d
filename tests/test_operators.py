"""Operators against one-event-at-a-time rules, on both the plain and the hot-key plans."""

import hashlib
import json
import math
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import columns as C
from riskloom.operators import admission, counters, detectors, features, incidents as I, policy as P, prefix
from riskloom.operators.sweep import Concentration, Count, Distinct, add_window_stats

PLANS = [{}, {"hot_rows": 5, "chunk_ms": 3_000}]


def frame(spark, rows):
    return spark.createDataFrame(rows).repartition(3)


def by_uid(df, *columns):
    return {r["attempt_uid"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.select("attempt_uid", *columns).collect()}


@pytest.mark.parametrize("chunk", [7_000, 60_000, 10_000_000])
def test_window_statistics(spark, chunk):
    rows = brute.stream(1, 250)
    keys = ["merchant_id", "ip"]
    stats = [
        Count("n1", 4_000), Count("n2", 20_000), Distinct("d1", "card_hash", 4_000), Distinct("d2", "card_hash", 20_000),
        Distinct("b2", "bin", 20_000), Concentration("hhi", "ent", "bin", 20_000),
    ]
    out = add_window_stats(frame(spark, rows), keys, stats, chunk_ms=chunk)
    got = by_uid(out, "n1", "n2", "d1", "d2", "b2", "hhi", "ent")
    n1, n2 = brute.windows(rows, keys, 4_000), brute.windows(rows, keys, 20_000)
    d1, d2 = brute.windows(rows, keys, 4_000, "card_hash"), brute.windows(rows, keys, 20_000, "card_hash")
    b2 = brute.windows(rows, keys, 20_000, "bin")
    assert len(got) == len(rows)
    for uid, v in got.items():
        assert v[:5] == (n1[uid], n2[uid], len(set(d1[uid])), len(set(d2[uid])), len(set(b2[uid])))
        hhi, ent = brute.concentration(b2[uid])
        assert v[5] == pytest.approx(hhi, abs=1e-9) and v[6] == pytest.approx(ent, abs=1e-9)
        if len(set(b2[uid])) == 1:
            assert v[6] == 0.0


def test_window_is_half_open(spark):
    rows = [{"attempt_uid": f"u{i}", "seq": i, "ingest_ms": t, "merchant_id": "m", "ip": "a", "card_hash": c} for i, (t, c) in enumerate([(0, "x"), (59_999, "y"), (60_000, "z"), (60_000, "z"), (119_999, "y")])]
    out = add_window_stats(frame(spark, rows), ["merchant_id", "ip"], [Count("n", 60_000), Distinct("d", "card_hash", 60_000)])
    assert by_uid(out, "n", "d") == {"u0": (1, 1), "u1": (2, 2), "u2": (2, 2), "u3": (3, 2), "u4": (3, 2)}


def test_windows_survive_time_shift_and_row_order(spark):
    rows = brute.stream(2, 120)
    stats = [Count("n", 5_000), Distinct("d", "card_hash", 30_000)]
    base = by_uid(add_window_stats(frame(spark, rows), ["ip"], stats), "n", "d")
    moved = [dict(r, ingest_ms=r["ingest_ms"] + 7 * K.HOUR_MS) for r in reversed(rows)]
    assert by_uid(add_window_stats(frame(spark, moved), ["ip"], stats), "n", "d") == base


@pytest.mark.parametrize("ttl", [300, 9_000, 400_000])
def test_anchored_counter(spark, ttl):
    rows = brute.stream(3, 400)
    want = brute.anchored(rows, ["merchant_id", "ip"], ttl)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = by_uid(counters.anchored_ttl_counter(frame(spark, rows), ["merchant_id", "ip"], ttl), "anchor_ms", "anchor_uid", "ordinal")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


@pytest.mark.parametrize("plan", PLANS)
def test_refreshed_counter_and_reuse(spark, plan):
    rows = brute.stream(4, 300)
    got = by_uid(counters.card_seen(frame(spark, rows), 6_000, "refresh", **plan), "card_seen_24h")
    state, seen = {}, {}
    for r in rows:
        k = (r["merchant_id"], r["card_hash"])
        last, n = state.get(k, (None, 0))
        n = 1 if last is None or r["ingest_ms"] - last >= 6_000 else n + 1
        state[k] = (r["ingest_ms"], n)
        seen[r["attempt_uid"]] = n
    assert got == seen
    got = by_uid(prefix.running_distinct(frame(spark, rows), ["merchant_id", "ip"], "card_hash", "n", **plan), "n")
    members, want = {}, {}
    for r in rows:
        members.setdefault((r["merchant_id"], r["ip"]), set()).add(r["card_hash"])
        want[r["attempt_uid"]] = len(members[(r["merchant_id"], r["ip"])])
    assert got == want


@pytest.mark.parametrize("plan", PLANS)
def test_running_and_reflected_walk(spark, plan):
    rows = brute.stream(5, 300)
    df = frame(spark, rows)
    out = prefix.running(df, ["ip"], {"s": ("sum", F.lit(1)), "b": ("sum", F.lit(1), "before"), "hi": ("max", F.col("x")), "lo": ("min", F.col("x"), "before")}, **plan)
    got = by_uid(out, "s", "b", "hi", "lo")
    seen = {}
    for r in rows:
        past = seen.setdefault(r["ip"], [])
        lo = min(past) if past else None
        past.append(r["x"])
        assert got[r["attempt_uid"]] == (len(past), len(past) - 1, max(past), lo)
    walked = by_uid(prefix.reflected_walk(df, ["merchant_id", "ip"], F.col("x"), "s", **plan), "s")
    want = brute.walk(rows, ["merchant_id", "ip"], lambda r: r["x"])
    assert walked.keys() == want.keys()
    assert all(walked[u] == pytest.approx(want[u], abs=1e-9) for u in want)


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("rate,burst", [(50, 3), (7, 2)])
def test_token_bucket(spark, plan, rate, burst):
    rows = brute.stream(6, 400)
    got = by_uid(admission.token_bucket(frame(spark, rows), rate, burst, **plan), "admitted")
    want = brute.tokens(rows, rate, burst)
    assert got == want and {True, False} <= set(want.values())


def test_availability_alert_once_per_clock_window(spark):
    rows = [{"attempt_uid": f"u{i}", "seq": i, "merchant_id": "m", "ingest_ms": 60_000 + i * 1_000} for i in range(100)]
    out = by_uid(admission.availability_alert(frame(spark, rows), 20, 60_000), "alerting", "alert_emitted")
    assert [u for u, v in sorted(out.items(), key=lambda x: int(x[0][1:])) if v[1]] == ["u19", "u60"]
    assert sum(v[0] for v in out.values()) == 81


@pytest.mark.parametrize("plan", PLANS)
def test_threat_rollup(spark, plan):
    rows = brute.stream(7, 300)
    for r in rows:
        r["severity"] = 2 if r["score"] > 0.95 else 1 if r["score"] > 0.9 else 0
    got = by_uid(features.threat_rollup(frame(spark, rows), 5_000, 2_000, **plan), "threat_state")
    state, want = {}, {}
    for r in rows:
        events, level, since = state.get(r["merchant_id"], ([], "calm", None))
        events = [e for e in events if e[0] > r["ingest_ms"] - 5_000] + [(r["ingest_ms"], r["severity"])]
        peak = max(s for _, s in events)
        if peak:
            level, since = ("under_attack" if peak == 2 else "elevated"), None
        elif level in ("elevated", "under_attack"):
            level, since = "resolved", r["ingest_ms"]
        elif level == "resolved" and r["ingest_ms"] - since >= 2_000:
            level = "calm"
        state[r["merchant_id"]] = (events, level, since)
        want[r["attempt_uid"]] = level
    assert got == want and "resolved" in want.values()


def evidence(seed, n):
    rows = brute.stream(seed, n, keys=4)
    for i, r in enumerate(rows):
        r["fired"] = r["score"] > 0.72
        r["detector"] = ["cusum", "drift", "both"][i % 3] if r["fired"] else "none"
        r["families"] = [["velocity"], ["bin_structure"], [], ["velocity", "bin_structure"]][i % 4]
        r["bucket"] = r["ingest_ms"] // 10_000
        r["rule_tier"] = "challenge" if i % 23 == 0 else "throttle" if i % 11 == 0 else "allow"
        r["signal_value"], r["cusum_stat"], r["p"] = r["score"], r["score"], r["score"]
        r["entity_type"], r["entity_key"] = "ip", r["ip"]
    return rows


@pytest.mark.parametrize("plan", PLANS)
def test_policy_and_incidents(spark, plan):
    thetas = {"throttle": 0.2, "challenge": 0.5, "step_up": 0.7, "block": 0.9}
    cooldown = 4_000
    rows = evidence(8, 500)
    want, machine = brute.policy(rows, thetas, 0.08, cooldown, 3, 0.25)
    df = I.incident_sessions(frame(spark, rows), cooldown, **plan)
    df = I.live_incident_count(I.corroborated(df, **plan), cooldown, **plan)
    out = P.policy_resolve(df, thetas, {**K.POLICY, "k_max": 3, "control_fraction": 0.25}, **plan)
    assert by_uid(out, "proposed_tier", "in_force_tier", "control_arm", "advisory") == want
    assert {v[3] for v in want.values()} == {True, False}

    inside = out.filter("incident_id is not null")
    last = max(r["ingest_ms"] for r in rows)
    for m in ("m0", "m1"):
        machine.sweep(m, last)
    merged = I.detector_merges(inside, **plan).withColumns({c: F.lit(0) for c in ("attempts_before", "cards_before", "entity_first_seen")})
    table = I.incident_metrics(merged).join(I.escalations(merged, F.col("merges"), cooldown), "incident_id")
    label = merged.groupBy("incident_id").agg(F.max_by("incident_detector", F.struct("ingest_ms", "seq")).alias("detector"))
    stated = I.incident_state_at(table.join(label, "incident_id"), F.lit(last), cooldown).collect()
    got = sorted((r["merchant_id"], r["entity_key"], r["opened_at"], r["attempts_total"], r["state"], r["detector"], r["escalated_at"], r["cooling_at"], r["closed_at"]) for r in stated)
    ref = sorted((i["m"], i["e"], i["open"], i["n"], i["state"], i["detector"], i["escalated_at"], i["cooling_at"], i["closed_at"]) for i in machine.all)
    assert got == ref

    rises = P.tier_transitions(inside, **plan).collect()
    assert len(rises) > len(ref) and all(r["ordinal"] == 0 for r in rises if r["from_tier"] is None)


def test_digests_match_python(spark):
    samples = [
        {"merchant_id": "m", "event_id": "e1", "card_hash": 'a"b\\c', "bin": "411111", "last4": None, "exp_month": 1, "exp_year": None, "amount_minor": 5, "currency": "INR", "session_id": "é\n😀"},
        {"merchant_id": "m", "event_id": "e2", "card_hash": "plain", "bin": "b", "last4": "0042", "exp_month": None, "exp_year": 2030, "amount_minor": 0, "currency": "INR", "session_id": ""},
    ]
    schema = "merchant_id string, event_id string, card_hash string, bin string, last4 string, exp_month int, exp_year int, amount_minor long, currency string, session_id string"
    df = spark.createDataFrame([tuple(s[c.split()[0]] for c in schema.split(", ")) for s in samples], schema)
    rows = df.withColumn("p", C.payload_digest()).withColumn("d", C.idem_digest(F.col("p"))).collect()
    names = ["card_hash", "bin", "last4", "exp_month", "exp_year", "amount_minor", "currency", "session_id"]
    for r, s in zip(rows, samples):
        want = hashlib.sha256(json.dumps({n: s[n] for n in names}, sort_keys=True).encode()).hexdigest()
        assert r["p"] == want and r["d"] == hashlib.sha256(f"m|{s['event_id']}|{want}".encode()).hexdigest()


def test_observed_arl0_and_closed_loop(spark):
    rows = brute.stream(9, 400, span=900_000)
    lam = {"m0": [0.02 + 0.01 * h for h in range(24)], "m1": [0.05] * 24}
    rates = spark.createDataFrame([(m, v) for m, v in lam.items()], "merchant_id string, lam array<double>")
    df = frame(spark, rows).withColumn("margin", 6 * F.col("score") - 3)
    rho, h, step = 3.0, 1.5, 10

    counts = detectors.cusum_bucket_counts(df, F.col("score") > 0.8, step)
    arl = {r["merchant_id"]: (r["alarms"], r["arl0"]) for r in detectors.observed_arl0(counts, rates, rho, h, step).collect()}
    loop = {(r["merchant_id"], r["bucket"]): r for r in detectors.closed_loop_regime(df, "margin", rates, 1.2, -0.1, 0.5, 0.02, rho, h, step, pi0=0.01).collect()}
    for m in lam:
        mine = [r for r in rows if r["merchant_id"] == m]
        first, last = mine[0]["ingest_ms"] // 10_000, mine[-1]["ingest_ms"] // 10_000
        plain = Counter(r["ingest_ms"] // 10_000 for r in mine if r["score"] > 0.8)
        s, length, runs = 0.0, 0, []
        loop_s, alarm, ratio = 0.0, False, 0.0
        for b in range(first, last + 1):
            rate = lam[m][(b * 10_000 // K.HOUR_MS) % 24]
            s, length = max(0.0, s + plain[b] * math.log(rho) - (rho - 1) * rate), length + 1
            if s > h:
                runs.append(length)
                s, length = 0.0, 0
            odds = max(ratio, 0.0) * 0.01 / 0.99
            prior = min(max(odds / (1 + odds), 0.01), 0.95) if alarm else 0.01
            sig = lambda z: 1 / (1 + math.exp(-z))
            lg = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
            n = sum(sig(lg(sig(1.2 * (6 * r["score"] - 3) - 0.1)) + lg(prior) - lg(0.5)) >= 0.02 for r in mine if r["ingest_ms"] // 10_000 == b)
            loop_s = max(0.0, loop_s + n * math.log(rho) - (rho - 1) * rate)
            if (m, b) in loop:
                got = loop[(m, b)]
                assert (got["regime"], got["flagged"]) == ("alarm" if alarm else "in_control", n)
                assert got["s"] == pytest.approx(loop_s, abs=1e-7)
            alarm, ratio = loop_s > h, n / rate
        assert arl[m][0] == len(runs) and arl[m][1] == pytest.approx(sum(runs) / len(runs) if runs else last - first + 1)


def test_sparse_cusum_matches_the_recursion_over_long_gaps(spark):
    rows = brute.stream(10, 200, span=3 * K.DAY_MS)
    lam = [0.002 * (h + 1) for h in range(24)]
    rates = spark.createDataFrame([("m0", lam), ("m1", lam)], "merchant_id string, lam array<double>")
    counts = detectors.cusum_bucket_counts(frame(spark, rows), F.col("score") > 0.3)
    got = {(r["merchant_id"], r["bucket"]): (r["s_before"], r["s"]) for r in detectors.poisson_cusum_sparse(counts, rates).collect()}
    for m in ("m0", "m1"):
        n = Counter(r["ingest_ms"] // 10_000 for r in rows if r["merchant_id"] == m and r["score"] > 0.3)
        seen = sorted({r["ingest_ms"] // 10_000 for r in rows if r["merchant_id"] == m})
        s = 0.0
        for b in range(seen[0], seen[-1] + 1):
            rate = lam[(b // 360) % 24]
            before = s
            s = max(0.0, s + n[b] * math.log(5.0) - 4.0 * rate)
            if (m, b) in got:
                assert got[(m, b)] == pytest.approx((before if b > seen[0] else 0.0, s), abs=1e-7)


def test_entity_scope_and_ids(spark):
    df = spark.createDataFrame([("m", "1.2.3.4", "headless", "c" * 40, "411111", 5)], "merchant_id string, ip string, ua_class string, card_hash string, bin string, t long")
    for scope, kind, key in (("card", "card", "c" * 40), ("bin", "bin", "411111"), ("ipua", "ipua", hashlib.sha1(b"1.2.3.4|headless").hexdigest()), ("ip", "ip", "1.2.3.4")):
        r = I.resolve_entity(df, F.lit(scope)).withColumn("i", I.incident_id(F.col("t"))).withColumn("s", C.truncated_key(F.col("entity_type"), F.col("entity_key"))).first()
        assert (r["entity_type"], r["entity_key"]) == (kind, key)
        assert r["i"] == "I" + hashlib.sha1(f"m|{kind}|{key}|5".encode()).hexdigest()[:25].upper()
        assert r["s"] == (key if kind in ("ip", "bin") else key[:8] + "…")
    with pytest.raises(Exception, match="no identifier"):
        I.resolve_entity(df.withColumn("ip", F.lit(" ")), F.lit("ip")).collect()
