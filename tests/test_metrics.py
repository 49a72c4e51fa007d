"""Metrics, calibration, splits, outcomes and tables against plain-Python statements."""

import hashlib
import hmac
import json
import math
import random

import brute
import pytest
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import columns as C
from riskloom.operators import calibration as CAL, layer1 as L, outcomes as O, quality as Q, ranking as R, reports as REP, samples as S, tables as TB
from riskloom.operators.ranked import exact_quantiles
from riskloom.sources import attempts as SRC


def scored(seed, n, grid=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = rng.random() < 0.3
        s = min(1.0, max(0.0, rng.gauss(0.6 if y else 0.4, 0.2)))
        out.append((round(s * grid) / grid if grid else s, y, i, "g1" if i % 3 else "g2"))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "score double, label boolean, ordinal long, g string").repartition(3)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("grid", [0, 10])
def test_ranking(spark, parts, grid):
    rows = scored(1, 400, grid)
    df = frame(spark, rows)
    auc = {r["g"]: r["auc"] for r in R.roc_auc(df, ["g"], parts=parts).collect()}
    ap = {r["g"]: (r["ap"], r["ap_at_prevalence"]) for r in R.average_precision(df, ["g"], prevalence=0.05, parts=parts, hot_rows=5, chunk_ms=50).collect()}
    rec = {r["g"]: r for r in R.recall_at_fpr(df, 0.1, ["g"], parts=parts).collect()}
    hull = R.roc_convex_hull(df, ["g"], parts=parts).collect()
    for g in ("g1", "g2"):
        mine = [r for r in rows if r[3] == g]
        pos, neg = [r[0] for r in mine if r[1]], [r[0] for r in mine if not r[1]]
        want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
        assert auc[g] == pytest.approx(want)
        tp = fp = 0
        a = t = 0.0
        for r in sorted(mine, key=lambda r: (-r[0], r[2])):
            tp, fp = tp + r[1], fp + (not r[1])
            if r[1]:
                a += tp / (tp + fp)
                x, y = tp / len(pos), fp / len(neg)
                t += 0.05 * x / (0.05 * x + 0.95 * y)
        assert ap[g] == pytest.approx((a / len(pos), t / len(pos)))
        points = [(0.0, 0.0)] + [(sum(q >= s for q in neg) / len(neg), sum(p >= s for p in pos) / len(pos)) for s in sorted({r[0] for r in mine}, reverse=True)]
        assert rec[g]["value"] == pytest.approx(max(y for x, y in points if x <= 0.1))
        assert rec[g]["resolvable"] == (len(neg) >= 10)
        top = sorted((r["fpr"], r["tpr"]) for r in hull if r["g"] == g)
        assert top[0] == (0.0, 0.0) or top[0][0] == 0.0
        for x, y in points:
            for (ax, ay), (bx, by) in zip(top, top[1:]):
                if ax <= x <= bx and bx > ax:
                    assert y <= ay + (by - ay) * (x - ax) / (bx - ax) + 1e-12


def test_degenerate_metrics_are_null(spark):
    df = spark.createDataFrame([(0.5, True, 0), (0.7, True, 1)], "score double, label boolean, ordinal long")
    assert R.roc_auc(df).first()["auc"] is None
    assert R.average_precision(df).first()["ap"] is None
    assert R.recall_at_fpr(df, 0.1).first()["value"] is None
    flat = spark.createDataFrame([(1.0, True, 0), (1.0, False, 1)], "score double, label boolean, ordinal long")
    assert R.recall_at_fpr(flat, 0.1).first()["value"] is None
    assert R.operating_point(flat, 2.0).first()["precision"] is None


def test_prevalence_identity(spark):
    df = frame(spark, scored(2, 300))
    share = df.agg(F.avg(F.col("label").cast("double"))).first()[0]
    r = R.average_precision(df, prevalence=share).first()
    assert r["ap"] == pytest.approx(r["ap_at_prevalence"])
    w = CAL.prevalence_weights(df, share)
    assert w.filter(F.abs(F.col("weight") - 1) > 1e-9).count() == 0
    assert CAL.brier(df).first()["brier"] == pytest.approx(CAL.brier(w, weight=F.col("weight")).first()["brier"])


def test_platt_isotonic_and_quantiles(spark):
    rows = scored(3, 500)
    df = frame(spark, rows).withColumn("margin", 6 * F.col("score") - 3)
    a, b, share, n = L.fit_platt(df)
    pos = sum(r[1] for r in rows)
    hi, lo = (pos + 1) / (pos + 2), 1 / (len(rows) - pos + 2)

    def loss(a, b):
        total = 0.0
        for s, y, _, _ in rows:
            z = a * (6 * s - 3) + b
            total += max(z, 0) + math.log1p(math.exp(-abs(z))) - (hi if y else lo) * z
        return total

    assert a > 0 and n == 500 and share == pytest.approx(pos / 500)
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-1e-3, 0, 1e-3) for db in (-1e-3, 0, 1e-3))
    with pytest.raises(ValueError):
        L.fit_platt(df.filter("label"))
    with pytest.raises(ValueError):
        L.fit_platt(df.withColumn("margin", -F.col("margin")))

    coarse = frame(spark, scored(4, 400, 25))
    pooled = {}
    for r in coarse.collect():
        c = pooled.setdefault(r["score"], [0, 0])
        c[0], c[1] = c[0] + 1, c[1] + r["label"]
    blocks = []
    for s in sorted(pooled):
        blocks.append([pooled[s][0], pooled[s][1], [s]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    want = {s: k[1] / k[0] for k in blocks for s in k[2]}
    for parts, merged in ((1, 16), (5, 16), (13, 2)):
        steps = L.fit_isotonic(coarse, parts=parts, merged=merged)
        assert {r["score"]: r["calibrated"] for r in L.predict_isotonic(coarse, steps).collect()} == pytest.approx(want)
        merged = L._merge_steps(coarse, steps, "score", "calibrated", 4).collect()
        assert {r["score"]: r["calibrated"] for r in merged} == pytest.approx(want) and len(merged) == 400

    values = sorted(r[0] for r in rows)
    for probs in ([0.05, 0.5, 0.95], [i / 100 for i in range(101)]):
        for parts in (1, 6):
            got = {r["idx"]: r["value"] for r in exact_quantiles(frame(spark, rows), [], "score", probs, parts).collect()}
            for i, q in enumerate(probs):
                at = q * (len(values) - 1)
                k = int(at)
                assert got[i] == pytest.approx(values[k] + (at - k) * (values[min(k + 1, len(values) - 1)] - values[k]))


def test_calibrator_stays_inside_zero_and_one(spark):
    df = spark.createDataFrame([(-1e6,), (0.0,), (1e6,)], "m double").withColumn("p", C.apply_calibrator(F.col("m"), 1.0, 0.0, 0.5, 0.001))
    p = [r["p"] for r in df.orderBy("m").collect()]
    assert 0 < p[0] < p[1] < p[2] < 1 and p[1] == pytest.approx(0.001)


def test_trees_attribute_the_margin(spark):
    rng = random.Random(5)
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "uid long, a double, b double, c double").withColumn("is_attack", F.col("a") + 0.5 * F.col("b") > 0.8)
    names = ["a", "b", "c"]
    matrix = L.training_matrix(df.select("uid", "is_attack"), df.drop("is_attack"), ["uid"], names, ("c",))
    assert matrix.filter("c <> 0").count() == 0
    model = L.train_gbt(matrix, 4, 3)
    margins = {r["uid"]: r["margin"] for r in L.score_margin(model, matrix).collect()}
    tops = L.top_contributors(model, matrix, names, 3).collect()
    for r in tops:
        assert r["margin"] == pytest.approx(margins[r["uid"]], abs=1e-9)
        assert r["bias"] + sum(t["contribution"] for t in r["top_contributors"]) == pytest.approx(r["margin"], abs=1e-5)
        sizes = [abs(t["contribution"]) for t in r["top_contributors"]]
        assert sizes == sorted(sizes, reverse=True)
    auc = R.roc_auc(L.score_margin(model, matrix).withColumn("label", F.col("target") == 1), score="margin").first()["auc"]
    assert auc > 0.9
    trace = L.early_stop_trace(model, matrix, 0.1)
    kept, resolved = L.best_round(trace)
    assert trace.count() == 4 and 1 <= kept <= 4


def test_splits_do_not_leak(spark):
    rows = brute.stream(6, 400, span=3_000_000)
    for i, r in enumerate(rows):
        r["is_attack"] = i % 4 == 0
        r["episode_id"] = f"ep{i // 20}" if r["is_attack"] else None
        r["gateway_status"] = "declined" if i % 3 == 0 else "approved"
        r["outcome_visible_ms"] = r["ingest_ms"] + 340
    df = spark.createDataFrame(rows).repartition(3)
    split = S.require_two_classes(S.temporal_split(df, 0.6, 60_000)).collect()
    t0, t1 = rows[0]["ingest_ms"], rows[-1]["ingest_ms"]
    cut = t0 + int((t1 - t0) * 0.6)
    train, test = [r for r in split if r["split"] == "train"], [r for r in split if r["split"] == "test"]
    assert train and test and max(r["ingest_ms"] for r in train) <= cut and min(r["ingest_ms"] for r in test) > cut + 60_000
    assert not {r["episode_id"] for r in train if r["episode_id"]} & {r["episode_id"] for r in test if r["episode_id"]}
    with pytest.raises(S.SingleClassSplit):
        S.require_two_classes(S.temporal_split(df.filter("is_attack"), 0.6, 0))

    spans = {}
    for r in rows:
        if r["is_attack"]:
            e = spans.setdefault(r["episode_id"], [r["ingest_ms"], r["ingest_ms"], set(), set()])
            e[1] = r["ingest_ms"]
            e[2].add(r["ip"]), e[3].add(r["card_hash"])
    want = {r["seq"]: not r["is_attack"] and any(lo <= r["ingest_ms"] <= hi + 9_000 and (r["ip"] in a or r["card_hash"] in c) for lo, hi, a, c in spans.values()) for r in rows}
    for plan in ({}, {"hot_rows": 5, "chunk_ms": 5_000}):
        assert {r["seq"]: r["entity_overlap"] for r in S.entity_overlap(df, 9_000, **plan).collect()} == want
        got = {r["seq"]: r["visible_declines"] for r in S.b1_decline_velocity(df, 2, 60_000, **plan).collect()}
        for r in rows:
            n = sum(q["ip"] == r["ip"] and q["gateway_status"] == "declined" and r["ingest_ms"] - 60_000 < q["outcome_visible_ms"] < r["ingest_ms"] for q in rows)
            assert got[r["seq"]] == n


def test_outcome_verification(spark):
    secret, now = "s3cret", 1_000_000
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    body = {"event_id": "e1", "gateway_status": "declined", "reached_gateway": True, "decline_code": None, "gateway_latency_ms": 340, "auth_fee_minor": None}

    def report(seq, **changes):
        r = {"seq": seq, "now_ms": now, "api_key": "k1", "timestamp": str(now), "nonce": f"n{seq}", **body}
        r.update({k: v for k, v in changes.items() if k in body or k in ("api_key", "timestamp", "nonce")})
        canonical = json.dumps({k: r[k] for k in body}, sort_keys=True, separators=(",", ":"))
        text = f"{'m1' if r['api_key'] == 'k1' else 'm2'}\n{r['timestamp']}\n{r['nonce']}\n{digest(canonical)}"
        r["signature"] = changes.get("signature", hmac.new(secret.encode(), text.encode(), hashlib.sha256).hexdigest())
        r.update(changes.get("tamper", {}))
        return r

    reports = [
        report(1), report(2, nonce="n1"), report(3, api_key="nobody"), report(4, api_key="k2"), report(5, signature="00"), report(6, event_id="e9"),
        report(7, timestamp=str(now - 300_001)), report(8, timestamp="abc"), report(9, nonce=""), report(10, tamper={"gateway_status": "approved"}), report(11),
    ]
    schema = "seq long, now_ms long, api_key string, timestamp string, nonce string, event_id string, gateway_status string, reached_gateway boolean, decline_code string, gateway_latency_ms long, auth_fee_minor long, signature string"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in reports], schema)
    merchants = spark.createDataFrame([("m1", digest("k1"), digest(secret)), ("m2", digest("k2"), "other")], "merchant_id string, api_key_hash string, outcome_hmac_key_hash string")
    attempts = spark.createDataFrame([("m1", "e1", "u1", 0)], "merchant_id string, event_id string, attempt_uid string, seq int")
    out = O.verify_outcomes(df, merchants, attempts, secret)
    assert {r["seq"]: r["reason"] for r in out.collect()} == {
        1: None, 2: "replayed nonce", 3: "unknown key", 4: "secret not bound to merchant", 5: "bad signature", 6: "unknown event_id",
        7: "stale", 8: "unsigned", 9: "unsigned", 10: "bad signature", 11: None,
    }
    recorded = O.recorded_outcomes(out).collect()
    assert len(recorded) == 1 and recorded[0]["gateway_status"] == "declined"


def test_tables_and_quality(spark, tmp_path):
    target = spark.createDataFrame([("a", 1, 10)], "k string, seq int, v int")
    incoming = spark.createDataFrame([("a", 2, 20), ("b", 4, 40), ("b", 3, 30)], "k string, seq int, v int")
    assert sorted(map(tuple, TB.insert_first_wins(target, incoming, ["k"], ["seq"]).collect())) == [("a", 1, 10), ("b", 3, 30)]
    once = TB.upsert_last_wins(target, incoming, ["k"], ["seq"])
    assert sorted(map(tuple, once.collect())) == [("a", 2, 20), ("b", 4, 40)]
    assert sorted(map(tuple, TB.upsert_last_wins(once, incoming, ["k"], ["seq"]).collect())) == [("a", 2, 20), ("b", 4, 40)]
    with pytest.raises(ValueError, match="card numbers"):
        SRC.write_tables(target.withColumnRenamed("v", "CardNumber"), str(tmp_path / "x"))
    SRC.write_tables(target, str(tmp_path / "j"), "json")
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"k":"a","seq":1,"v":10}'
    with pytest.raises(Exception, match="lacks"):
        TB.load_feature_corpus(spark.createDataFrame([("u",)], "attempt_uid string"), spark.createDataFrame([("u", 1.0, '{"x": 1}')], "attempt_uid string, score_raw double, feature_snapshot string")).collect()
    same = Q.table_fingerprint(once, "t").first()["fingerprint"]
    assert Q.table_fingerprint(once.repartition(5), "t").first()["fingerprint"] == same
    assert Q.table_fingerprint(target, "t").first()["fingerprint"] != same
    old = spark.createDataFrame([("a.b", 1.0, None), ("a.c", None, "x"), ("gone", 2.0, None), ("skip.x[0]", 1.0, None)], "path string, value double, text string")
    new = spark.createDataFrame([("a.b", 1.0 + 1e-12, None), ("a.c", None, "y"), ("new", float("nan"), None)], "path string, value double, text string")
    got = {r["path"]: (r["change"], r["abs_delta"]) for r in Q.frame_diff(old, new, ignore=["skip"], rtol=1e-9).collect()}
    assert got == {"a.c": ("changed", 0.0), "gone": ("removed", None), "new": ("added", None)}
    winner = REP.model_vs_rules_winner(spark.createDataFrame([("t", "model", 0.5), ("t", "b0", 0.5), ("u", "model", 0.1)], "tier string, scorer string, ap double"))
    assert {r["tier"]: r["winner"] for r in winner.collect()} == {"t": "tie", "u": None}
