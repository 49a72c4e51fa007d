"""Settings that each row brings, as those of its merchant's pinned version, give what each version gives alone."""

import pytest
from pyspark.sql import functions as F
from test_operators import evidence, frame

from riskloom import constants as K
from riskloom.operators import incidents as I
from riskloom.operators import policy as P
from riskloom.operators.tables import pinned_version

VERSIONS = {
    ("m0", 1): ({"throttle": 0.2, "challenge": 0.5, "step_up": 0.7, "block": 0.9}, {"hysteresis_gap": 0.08, "k_max": 3, "control_fraction": 0.25, "auto_ceiling": "block"}),
    ("m0", 2): ({"throttle": 0.3, "challenge": 0.6, "step_up": 0.8, "block": 0.95}, {"hysteresis_gap": 0.0, "k_max": 2, "control_fraction": 0.0, "auto_ceiling": "challenge"}),
    ("m1", 7): ({"throttle": 0.1, "challenge": 0.4, "step_up": 0.6, "block": 0.8}, {"hysteresis_gap": 0.2, "k_max": 1, "control_fraction": 0.5, "auto_ceiling": "step_up"}),
}
OUT = ["attempt_uid", "proposed_tier", "in_force_tier", "control_arm", "advisory", "requires_confirmation", "l2_tier"]


@pytest.mark.parametrize("second", [1, 2])
def test_settings_as_columns(spark, second):
    cooldown = 4_000
    df = I.incident_sessions(frame(spark, evidence(8, 400)), cooldown)
    df = I.live_incident_count(I.corroborated(df), cooldown)
    # One version per entity, as entities are independent; those of m0 differ by key.
    even = F.pmod(F.crc32(F.col("entity_key").cast("binary")), F.lit(2)) == 0
    df = df.filter("merchant_id in ('m0', 'm1')").withColumn("pinned_policy_version", F.when(F.col("merchant_id") == "m1", 7).when(even, 1).otherwise(second))
    configs = spark.createDataFrame(
        [(m, v, t, *(p[k] for k in ("hysteresis_gap", "k_max", "control_fraction", "auto_ceiling"))) for (m, v), (t, p) in VERSIONS.items()],
        "merchant_id string, version int, thetas map<string,double>, hysteresis_gap double, k_max int, control_fraction double, auto_ceiling string",
    )
    rows = pinned_version(df, configs).withColumn("policy_version", F.col("pinned_policy_version"))
    settings = {**K.POLICY, **{k: F.col(k) for k in ("hysteresis_gap", "k_max", "control_fraction", "auto_ceiling")}, "version": F.col("policy_version")}
    got = {r.attempt_uid: tuple(r) for r in P.policy_resolve(rows, F.col("thetas"), settings).select(*OUT).collect()}
    want = {}
    for (merchant, version), (thetas, policy) in VERSIONS.items():
        part = df.withColumn("policy_version", F.col("pinned_policy_version")).filter((F.col("merchant_id") == merchant) & (F.col("pinned_policy_version") == version))
        alone = P.policy_resolve(part, thetas, {**K.POLICY, **policy, "version": version}).select(*OUT)
        want |= {r.attempt_uid: tuple(r) for r in alone.collect()}
    assert got.keys() == want.keys() and len(got) > 100
    # The control arm counts a merchant's attempts over all its versions, so m0 is compared without it where it has two.
    one = {r.attempt_uid for r in df.filter("merchant_id = 'm1'").select("attempt_uid").collect()} if second == 2 else set(got)
    for uid, row in got.items():
        assert row == want[uid] if uid in one else (row[1], *row[5:]) == (want[uid][1], *want[uid][5:]), uid


def _versions(spark, rows):
    fields = ("hysteresis_gap", "k_max", "control_fraction", "auto_ceiling")
    made = [(m, v, at, VERSIONS[m, k][0], *(VERSIONS[m, k][1][f] for f in fields)) for m, v, at, k in rows]
    return spark.createDataFrame(made, "merchant_id string, version int, created_ms long, thetas map<string,double>, hysteresis_gap double, k_max int, control_fraction double, auto_ceiling string")


@pytest.mark.parametrize("plan", [{}, {"hot_rows": 5, "chunk_ms": 3_000}])
def test_incidents_keep_the_version_they_opened_under(spark, plan):
    cooldown = 4_000
    df = I.incident_sessions(frame(spark, evidence(8, 400)), cooldown, **plan)
    df = I.live_incident_count(I.corroborated(df, **plan), cooldown, **plan)
    known = df.select("ingest_ms", "opened_at").collect()
    times = sorted(r.ingest_ms for r in known)
    # One version starts at the very millisecond an incident opens, one before all rows, one after all; m1 has none at first.
    opening = sorted({r.opened_at for r in known if r.opened_at})[len(times) // 60]
    made = [("m0", 1, times[0] - 5, 1), ("m0", 2, opening, 2), ("m0", 3, times[250], 1), ("m0", 4, times[-1] + 1, 2), ("m1", 7, times[150], 7)]
    versions = _versions(spark, made)
    got = P.resolve_pinned(df, versions, VERSIONS["m0", 1][0], {**K.POLICY, "version": 0}, **plan).collect()
    assert len(got) == len(known) and {"_set", "_live"}.isdisjoint(got[0].asDict())
    split = 0
    for r in got:
        moment = r.ingest_ms if r.opened_at is None else r.opened_at
        live = lambda at: max((v for m, v, since, _ in made if m == r.merchant_id and since <= at), default=0)
        assert r.policy_version == live(moment)
        split += live(r.ingest_ms) != live(moment)
    assert split > 0


def test_one_version_with_the_default_settings_changes_nothing(spark):
    cooldown = 4_000
    thetas = VERSIONS["m0", 1][0]
    df = I.incident_sessions(frame(spark, evidence(9, 300)), cooldown)
    df = I.live_incident_count(I.corroborated(df), cooldown)
    policy = {**K.POLICY, "k_max": 3, "control_fraction": 0.25}
    made = [(m, 1, at, thetas, policy["hysteresis_gap"], 3, 0.25, policy["auto_ceiling"]) for m, at in (("m0", 0), ("m1", 1_090_000))]
    versions = spark.createDataFrame(made, "merchant_id string, version int, created_ms long, thetas map<string,double>, hysteresis_gap double, k_max int, control_fraction double, auto_ceiling string")
    plain = P.policy_resolve(df, thetas, policy).select(*OUT)
    for some in (versions, versions.limit(0)):
        pinned = P.resolve_pinned(df, some, thetas, policy).select(*OUT)
        assert sorted(map(tuple, pinned.collect())) == sorted(map(tuple, plain.collect()))


def test_whole_path_with_versions(spark):
    from conftest import SF
    from riskloom.functions import columns as C
    from riskloom.operators.decision import decide
    from riskloom.plans import detect, flow
    from riskloom.plans.views import DAY, attempts
    from riskloom.plans.windows import RULES, WIDTHS

    rows = attempts(spark, SF)
    thetas = {t: float(v) for t, v in C.tier_ladder_values().items()}
    middle = rows.agg(F.percentile_approx("ingest_ms", 0.5)).first()[0]
    policy = flow.POLICY

    def run(versions):
        out = decide(rows, detect._lam(spark, SF), 9.5, widths=WIDTHS, rules=RULES, policy=policy, cusum=flow.CUSUM, ttl_ms=2 * DAY, versions=versions)
        return {r.attempt_uid: r for r in out.collect()}

    def versions(ceiling):
        made = [(f"m{i}", v, at, thetas, policy["hysteresis_gap"], policy["k_max"], 0.0 if v == 2 else policy["control_fraction"], c)
                for i in range(4) for v, at, c in ((1, 0, policy["auto_ceiling"]), (2, middle, ceiling))]
        return spark.createDataFrame(made, "merchant_id string, version int, created_ms long, thetas map<string,double>, hysteresis_gap double, k_max int, control_fraction double, auto_ceiling string")

    plain, pinned = run(None), run(versions("allow"))
    assert plain.keys() == pinned.keys()
    later = 0
    for uid, r in pinned.items():
        moment = r.ingest_ms if r.opened_at is None else r.opened_at
        assert r.policy_version == (2 if moment >= middle else 1)
        assert (r.proposed_tier, r.incident_id) == (plain[uid].proposed_tier, plain[uid].incident_id)
        if r.policy_version == 2:
            assert r.in_force_tier == "allow" and not r.control_arm
            later += r.proposed_tier != "allow"
    assert later > 0 and any(r.in_force_tier != "allow" for r in pinned.values())
