"""Registered queries: incidents, policy, enforcement and read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import columns as C
from riskloom.operators import detectors, features, incidents as I, policy as P, tables as TB
from riskloom.operators.prefix import hot_keys
from riskloom.plans.registry import query, table
from riskloom.plans.views import ATTEMPTS_SQL, HOUR, attempts
from riskloom.plans.windows import RULES_SQL, ruled
from riskloom.session import materialize

COOL = 12 * HOUR
THETAS = {"throttle": 0.1, "challenge": 0.3, "step_up": 0.5, "block": 0.7}
POLICY = {**K.POLICY, "k_max": 40, "control_fraction": 0.2}


def evidence(spark, sf_dir):
    """Attempts with a scope, a detector verdict and rule families, as the scorer hands them over."""
    k = F.col("k")
    fired = F.col("score") >= 0.25
    kind = F.when(~fired, "none").when(k % 3 == 0, "cusum").when(k % 3 == 1, "drift").otherwise("both")
    families = F.array_compact(F.array(F.when(k % 2 == 0, F.lit("velocity")), F.when(k % 5 == 0, F.lit("bin_structure"))))
    return attempts(spark, sf_dir).select(
        "attempt_uid", "seq", "ingest_ms", "merchant_id", "ip", "bin", "card_hash", "k", "user_agent", "score",
        F.when(k % 10 == 7, "bin").otherwise("ip").alias("entity_type"),
        F.when(k % 10 == 7, F.col("bin")).otherwise(F.col("ip")).alias("entity_key"),
        fired.alias("fired"), kind.alias("detector"),
        (F.col("score") * 10).alias("signal_value"), (F.col("score") * 20).alias("cusum_stat"),
        families.alias("families"), C.bucket(F.col("ingest_ms")).alias("bucket"),
        F.when(k >= 97, "challenge").when(k >= 90, "throttle").otherwise("allow").alias("rule_tier"),
    )


EVIDENCE_SQL = f"""
evidence AS (
  SELECT attempt_uid, seq, ingest_ms, merchant_id, ip, bin, card_hash, k, user_agent, score,
    CASE WHEN k % 10 = 7 THEN 'bin' ELSE 'ip' END AS entity_type, CASE WHEN k % 10 = 7 THEN bin ELSE ip END AS entity_key,
    score >= 0.25 AS fired,
    CASE WHEN score < 0.25 THEN 'none' WHEN k % 3 = 0 THEN 'cusum' WHEN k % 3 = 1 THEN 'drift' ELSE 'both' END AS detector,
    score * 10 AS signal_value, score * 20 AS cusum_stat, k % 2 = 0 AS f_v, k % 5 = 0 AS f_b, ingest_ms // 10000 AS bucket,
    CASE WHEN k >= 97 THEN 'challenge' WHEN k >= 90 THEN 'throttle' ELSE 'allow' END AS rule_tier
  FROM attempts),
prevs AS (SELECT *, max(CASE WHEN fired THEN ingest_ms END) OVER (PARTITION BY merchant_id, entity_type, entity_key ORDER BY ingest_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM evidence),
opened AS (SELECT *, fired AND (prev IS NULL OR ingest_ms - prev >= {2 * COOL}) AS opens, fired AND (prev IS NULL OR ingest_ms - prev >= {COOL}) AS warms FROM prevs),
walked AS (
  SELECT *, max(CASE WHEN opens THEN ingest_ms END) OVER w AS o, max(CASE WHEN warms THEN ingest_ms END) OVER w AS wm, greatest(prev, CASE WHEN fired THEN ingest_ms END) AS lf
  FROM opened WINDOW w AS (PARTITION BY merchant_id, entity_type, entity_key ORDER BY ingest_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sess AS (
  SELECT *, CASE WHEN inside THEN 'I' || upper(sha1(merchant_id || '|' || entity_type || '|' || entity_key || '|' || o)[1:25]) END AS incident_id
  FROM (SELECT *, coalesce(o IS NOT NULL AND ingest_ms < lf + {2 * COOL}, false) AS inside FROM walked)),
inc AS (
  SELECT incident_id, merchant_id, entity_type, entity_key, o AS opened_at, count(*) AS attempts_total, max(lf) AS last_fire_ms, max(ingest_ms) AS last_seen,
    max(CASE WHEN opens THEN cusum_stat END) AS cusum_stat_at_alert, max(CASE WHEN opens THEN detector END) AS d0, max(CASE WHEN opens THEN attempt_uid END) AS open_uid,
    max(wm) AS latest_warm
  FROM sess WHERE inside GROUP BY ALL)
"""
BASE = f"WITH {ATTEMPTS_SQL}, {EVIDENCE_SQL}"


def sessions(spark, sf_dir, **kw):
    return I.incident_sessions(evidence(spark, sf_dir), COOL, **kw)


def inside(spark, sf_dir):
    return sessions(spark, sf_dir).filter(F.col("incident_id").isNotNull())


def incident_table(spark, sf_dir):
    """Incidents with the columns that need no history join."""
    rows = inside(spark, sf_dir).withColumns(
        {c: F.lit(None).cast("long") for c in ("attempts_before", "cards_before", "entity_first_seen")}
    )
    return I.incident_metrics(rows)


@query(
    "resolve_entity",
    f"""WITH {ATTEMPTS_SQL}, {RULES_SQL} SELECT attempt_uid, CASE WHEN rules_fired = 'distinct_cards_per_bin_5m' THEN 'bin' ELSE 'ip' END AS entity_type,
    CASE WHEN rules_fired = 'distinct_cards_per_bin_5m' THEN bin ELSE ip END AS entity_key FROM ruled""",
)
def _entity(spark, sf_dir):
    df = ruled(spark, sf_dir).withColumn("ua_class", F.lit("unparseable"))
    return I.resolve_entity(df, I.evidence_scope(F.col("rules_fired"))).select("attempt_uid", "entity_type", "entity_key")


@query("incident_sessions", f"{BASE} SELECT attempt_uid, opens, CASE WHEN inside THEN o END AS opened_at, CASE WHEN inside THEN lf END AS last_fire_ms, incident_id FROM sess")
def _sessions(spark, sf_dir):
    return sessions(spark, sf_dir).select("attempt_uid", "opens", "opened_at", "last_fire_ms", "incident_id")


@query("incident_ids", f"{BASE} SELECT incident_id, 'T' || upper(sha1(incident_id || '|0')[1:25]) AS transition_id, 'A' || upper(sha1(incident_id || '|' || entity_type || '|' || entity_key || '|challenge')[1:25]) AS action_id FROM inc")
def _ids(spark, sf_dir):
    opened = sessions(spark, sf_dir).filter("opens")
    return opened.select(
        "incident_id", I.transition_id(F.col("incident_id"), F.lit(0)).alias("transition_id"),
        I.action_id(F.col("incident_id"), F.col("entity_type"), F.col("entity_key"), F.lit("challenge")).alias("action_id"),
    )


NOW_SQL = "now AS (SELECT merchant_id, max(ingest_ms) AS now_ms FROM attempts GROUP BY 1)"
MERGE_SQL = """
mixed AS (SELECT s.incident_id, min(seq) AS first_seq, arg_min(ingest_ms, seq) AS first_ms FROM sess s JOIN inc i ON s.incident_id = i.incident_id
  WHERE s.fired AND NOT s.opens AND s.detector <> i.d0 GROUP BY 1),
merges AS (SELECT s.*, m.first_seq IS NOT NULL AS has_mix, coalesce(s.seq = m.first_seq OR (s.fired AND NOT s.opens AND s.seq > m.first_seq AND s.detector <> 'both'), false) AS merges
  FROM sess s LEFT JOIN mixed m ON s.incident_id = m.incident_id WHERE s.inside),
esc1 AS (SELECT incident_id, wm, min(ingest_ms) AS moment FROM merges WHERE merges AND ingest_ms - lf < %d GROUP BY 1, 2),
esc AS (SELECT e.incident_id, arg_max(moment, wm) AS escalated_at, max(wm) = max(i.latest_warm) AS escalated FROM esc1 e JOIN inc i ON e.incident_id = i.incident_id GROUP BY 1),
det AS (SELECT incident_id, bool_or(has_mix) AS mix FROM merges GROUP BY 1),
states AS (
  SELECT i.*, now_ms - last_fire_ms AS idle, e.escalated_at, coalesce(e.escalated, false) AS esc, CASE WHEN det.mix THEN 'both' ELSE d0 END AS detector
  FROM inc i JOIN now USING (merchant_id) JOIN det USING (incident_id) LEFT JOIN esc e USING (incident_id)),
stated AS (
  SELECT *, CASE WHEN idle >= %d THEN 'CLOSED' WHEN idle >= %d THEN 'COOLING' WHEN esc THEN 'ESCALATED' ELSE 'OPEN' END AS state,
    CASE WHEN idle >= %d THEN last_fire_ms + %d END AS cooling_at, CASE WHEN idle >= %d THEN last_fire_ms + %d END AS closed_at FROM states)
""" % (COOL, 2 * COOL, COOL, COOL, COOL, 2 * COOL, 2 * COOL)


def stated(spark, sf_dir):
    rows = I.detector_merges(inside(spark, sf_dir)).withColumns(
        {c: F.lit(None).cast("long") for c in ("attempts_before", "cards_before", "entity_first_seen")}
    )
    label = rows.groupBy("incident_id").agg(F.max_by("incident_detector", F.struct("ingest_ms", "seq")).alias("detector"))
    out = I.incident_metrics(rows).join(label, "incident_id").join(I.escalations(rows, F.col("merges"), COOL), "incident_id")
    now = attempts(spark, sf_dir).groupBy("merchant_id").agg(F.max("ingest_ms").alias("now_ms"))
    return I.incident_state_at(out.join(now, "merchant_id"), F.col("now_ms"), COOL)


@query("incident_state_at", f"{BASE}, {NOW_SQL}, {MERGE_SQL} SELECT incident_id, state, detector, escalated_at, cooling_at, closed_at FROM stated")
def _state(spark, sf_dir):
    return stated(spark, sf_dir).select("incident_id", "state", "detector", "escalated_at", "cooling_at", "closed_at")


HIST_SQL = """
h AS (SELECT attempt_uid, row_number() OVER w - 1 AS attempts_before,
    count(DISTINCT card_hash) OVER (PARTITION BY merchant_id, entity_type, entity_key ORDER BY ingest_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cards_before,
    min(ingest_ms) OVER (PARTITION BY merchant_id, entity_type, entity_key) AS first_seen
  FROM evidence WINDOW w AS (PARTITION BY merchant_id, entity_type, entity_key ORDER BY ingest_ms, seq))
"""


@query(
    "incident_metrics",
    f"""{BASE}, {HIST_SQL} SELECT incident_id, opened_at, attempts_total, last_seen, attempts_before AS attempts_before_alert, cards_before AS cards_exposed_before_alert,
    round((opened_at - first_seen) / 1000.0, 3) AS time_to_detect_s, round(cusum_stat_at_alert, 6) AS cusum_stat_at_alert FROM inc JOIN h ON h.attempt_uid = open_uid""",
)
def _metrics(spark, sf_dir):
    rows = detectors.entity_history(evidence(spark, sf_dir), I.ENTITY)
    out = I.incident_metrics(I.incident_sessions(rows, COOL).filter(F.col("incident_id").isNotNull()))
    return out.select(
        "incident_id", "opened_at", "attempts_total", "last_seen", "attempts_before_alert", "cards_exposed_before_alert",
        F.round("time_to_detect_s", 3).alias("time_to_detect_s"), F.round("cusum_stat_at_alert", 6).alias("cusum_stat_at_alert"),
    )


CORR_SQL = """
corr AS (SELECT attempt_uid, coalesce(bool_or(f_v) OVER w AND bool_or(f_b) OVER w AND max(CASE WHEN f_v OR f_b THEN bucket END) OVER w > min(CASE WHEN f_v OR f_b THEN bucket END) OVER w, false) AS corroborated
  FROM sess WHERE inside WINDOW w AS (PARTITION BY incident_id ORDER BY ingest_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


@query("corroborated", f"{BASE}, {CORR_SQL} SELECT * FROM corr")
def _corroborated(spark, sf_dir):
    return I.corroborated(inside(spark, sf_dir)).select("attempt_uid", "corroborated")


@query(
    "pseudonyms",
    f"""{BASE}, f AS (SELECT merchant_id, entity_type, entity_key, min(opened_at) AS t FROM inc GROUP BY ALL)
    SELECT merchant_id, entity_type, entity_key, entity_type || '_' || row_number() OVER (PARTITION BY merchant_id, entity_type ORDER BY t, entity_key) AS pseudonym FROM f""",
)
def _pseudonyms(spark, sf_dir):
    return I.pseudonyms(sessions(spark, sf_dir).filter("opens"))


@query(
    "worst_threat_state",
    f"""{BASE}, {NOW_SQL}, {MERGE_SQL} SELECT merchant_id, (['calm', 'resolved', 'elevated', 'under_attack'])[max(CASE state WHEN 'ESCALATED' THEN 4 WHEN 'OPEN' THEN 3 WHEN 'COOLING' THEN 2 ELSE 1 END)] AS threat_state FROM stated GROUP BY 1""",
)
def _worst(spark, sf_dir):
    return I.worst_threat_state(stated(spark, sf_dir))


@query("list_incidents", f"{BASE}, {NOW_SQL}, {MERGE_SQL} SELECT incident_id, merchant_id, state, detector, opened_at FROM stated WHERE state <> 'CLOSED'")
def _list(spark, sf_dir):
    return I.list_incidents(stated(spark, sf_dir)).select("incident_id", "merchant_id", "state", "detector", "opened_at")


# --- tiers and policy -------------------------------------------------------------------
@query(
    "tier_ladder",
    """WITH m AS (SELECT DISTINCT 'm' || c_nationkey AS merchant_id, 100000 + 1000 * c_nationkey AS aov FROM customer),
    t AS (SELECT * FROM (VALUES ('throttle', 0.01), ('challenge', 0.05), ('step_up', 0.15), ('block', 1.0)) v(tier, ab))
    SELECT merchant_id, tier, round(aov * 0.3e0 * ab / (aov * 0.3e0 * ab + 5200), 6) AS theta FROM m CROSS JOIN t""",
)
def _ladder(spark, sf_dir):
    m = K.COST_MODEL
    merchants = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey").distinct()
    tiers = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(a).alias("abandonment")) for t, a in m["abandonment"].items()]))
    costs = merchants.select(
        F.concat(F.lit("m"), "c_nationkey").alias("merchant_id"), (100_000 + 1_000 * F.col("c_nationkey")).alias("aov_minor"),
        F.lit(m["margin_pct"]).alias("margin_pct"), F.lit(m["auth_fee_minor"]).alias("auth_fee_minor"),
        F.lit(m["downstream_exposure_minor"]).alias("downstream_exposure_minor"), tiers.alias("_t"),
    ).select("*", "_t.tier", "_t.abandonment")
    return P.tier_ladder(costs).withColumn("theta", F.round("theta", 6))


@query(
    "tier_from_score",
    f"""WITH {ATTEMPTS_SQL} SELECT attempt_uid, CASE WHEN score >= 0.7 THEN 'block' WHEN score >= 0.5 AND k % 2 = 0 THEN 'step_up'
    WHEN score >= 0.3 THEN 'challenge' WHEN score >= 0.1 THEN 'throttle' ELSE 'monitor' END AS tier FROM attempts""",
)
def _from_score(spark, sf_dir):
    ladder = F.when(F.col("k") % 2 == 0, "foreign").otherwise("domestic")
    rank = C.tier_from_score(F.col("score"), {t: F.lit(v) for t, v in THETAS.items()}, ladder)
    return attempts(spark, sf_dir).select("attempt_uid", C.tier_name(rank).alias("tier"))


@query(
    "control_arm",
    f"""WITH {ATTEMPTS_SQL}, e AS (SELECT attempt_uid, merchant_id, score >= 0.1 AS el, coalesce(sum(CASE WHEN score >= 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY merchant_id ORDER BY ingest_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM attempts)
    SELECT attempt_uid, el AND (o % 20) = CAST(('0x' || sha256(merchant_id || ':1:' || CAST(o // 20 AS BIGINT))[1:16]) AS UBIGINT) % 20 AS control_arm FROM e""",
)
def _control(spark, sf_dir):
    df = attempts(spark, sf_dir).select("attempt_uid", "merchant_id", "seq", "ingest_ms", "score")
    return P.control_arm(df, F.col("score") >= 0.1, F.lit(1)).select("attempt_uid", "control_arm")


def counted(spark, sf_dir):
    """Options of a chain of running aggregates over ``evidence``, whose hot keys are counted once."""
    return {"hot": hot_keys(evidence(spark, sf_dir), [["merchant_id"], I.ENTITY])}


def live_rows(spark, sf_dir, **kw):
    """Attempts with sessions, corroboration and the merchant's live incident count."""
    kw = kw or counted(spark, sf_dir)
    rows = I.corroborated(sessions(spark, sf_dir, **kw), **kw).withColumn("p", F.col("score"))
    return I.live_incident_count(rows, COOL, **kw)


def resolved(spark, sf_dir):
    kw = counted(spark, sf_dir)
    return P.policy_resolve(live_rows(spark, sf_dir, **kw), THETAS, POLICY, **kw)


LIVE_SQL = f"""
ev AS (
  SELECT merchant_id, ingest_ms AS t, seq, CASE WHEN opens THEN 1 ELSE 0 END AS d, attempt_uid FROM sess
  UNION ALL SELECT merchant_id, last_fire_ms + {2 * COOL}, -1, -1, NULL FROM inc),
live AS (SELECT attempt_uid, n FROM (SELECT attempt_uid, CAST(sum(d) OVER (PARTITION BY merchant_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM ev) WHERE attempt_uid IS NOT NULL)
"""


@query("k_max_advisory", f"{BASE}, {LIVE_SQL} SELECT attempt_uid, n AS live_incidents, n >= 40 AS at_cap FROM live")
def _k_max(spark, sf_dir):
    return live_rows(spark, sf_dir).select("attempt_uid", "live_incidents", (F.col("live_incidents") >= 40).alias("at_cap"))


# The state machine, attempt by attempt: tier memory per entity in the order the entity's attempts arrive.
POLICY_SQL = f"""
tgt AS (
  SELECT s.*, coalesce(c.corroborated, false) AS corr, l.n >= 40 AS cap,
    CASE WHEN NOT s.inside THEN 0 WHEN NOT coalesce(c.corroborated, false) THEN 1
         WHEN score >= 0.7 THEN 5 WHEN score >= 0.3 THEN 3 WHEN score >= 0.1 THEN 2 ELSE 1 END AS target,
    row_number() OVER (PARTITION BY merchant_id, entity_type, entity_key ORDER BY ingest_ms, seq) AS rn
  FROM sess s LEFT JOIN corr c USING (attempt_uid) JOIN live l USING (attempt_uid)),
fold AS (
  SELECT merchant_id, entity_type, entity_key, rn, attempt_uid, target AS l2, cap AS advisory, CASE WHEN cap THEN 0 ELSE target END AS cur FROM tgt WHERE rn = 1
  UNION ALL
  SELECT t.merchant_id, t.entity_type, t.entity_key, t.rn, t.attempt_uid,
    CASE WHEN NOT t.inside THEN 0 WHEN t.target < f.cur AND f.cur >= 2 AND NOT t.score < (CASE f.cur WHEN 2 THEN 0.1 WHEN 3 THEN 0.3 WHEN 4 THEN 0.5 ELSE 0.7 END) - 0.08 THEN f.cur ELSE t.target END,
    t.cap AND f.cur = 0,
    CASE WHEN t.cap AND f.cur = 0 THEN 0 WHEN NOT t.inside THEN 0 WHEN t.target < f.cur AND f.cur >= 2 AND NOT t.score < (CASE f.cur WHEN 2 THEN 0.1 WHEN 3 THEN 0.3 WHEN 4 THEN 0.5 ELSE 0.7 END) - 0.08 THEN f.cur ELSE t.target END
  FROM fold f JOIN tgt t ON t.merchant_id = f.merchant_id AND t.entity_type = f.entity_type AND t.entity_key = f.entity_key AND t.rn = f.rn + 1),
prop AS (
  SELECT t.*, f.l2, f.advisory, greatest(f.l2, CASE rule_tier WHEN 'challenge' THEN 3 WHEN 'throttle' THEN 2 ELSE 0 END) AS pr FROM tgt t JOIN fold f USING (attempt_uid)),
elig AS (SELECT *, least(pr, 3) > 0 AND NOT advisory AS el FROM prop),
ord AS (SELECT *, coalesce(sum(CASE WHEN el THEN 1 ELSE 0 END) OVER (PARTITION BY merchant_id ORDER BY ingest_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS od FROM elig),
arm AS (SELECT *, el AND (od % 5) = CAST(('0x' || sha256(merchant_id || ':1:' || CAST(od // 5 AS BIGINT))[1:16]) AS UBIGINT) % 5 AS control FROM ord),
tiers AS (SELECT ['allow', 'monitor', 'throttle', 'challenge', 'step_up', 'block'] AS names),
decided AS (
  SELECT arm.*, names[pr + 1] AS proposed_tier, names[CASE WHEN advisory OR control THEN 0 ELSE least(pr, 3) END + 1] AS in_force_tier, pr > 3 AS needs FROM arm, tiers)
"""
DECIDED = f"WITH RECURSIVE {ATTEMPTS_SQL}, {EVIDENCE_SQL}, {CORR_SQL}, {LIVE_SQL}, {POLICY_SQL}"


@query(
    "policy_resolve",
    f"{DECIDED} SELECT attempt_uid, proposed_tier, in_force_tier, control AS control_arm, advisory, needs AS requires_confirmation FROM decided",
)
def _resolve(spark, sf_dir):
    return resolved(spark, sf_dir).select(
        "attempt_uid", "proposed_tier", "in_force_tier", "control_arm", "advisory", "requires_confirmation"
    )


# Customers as policy versions of their nation's merchant, one every two days from its second day on.
VERSION_SQL = f"""
starts AS (SELECT merchant_id, min(ingest_ms) AS t0 FROM attempts GROUP BY 1),
vers AS (
  SELECT merchant_id, version, t0 + {24 * HOUR} + CAST(version - 1 AS BIGINT) * {48 * HOUR} AS created_ms, 0.02e0 * (c_custkey % 5) AS d, 0.04e0 * (c_custkey % 3) AS gap, 20 + 10 * (c_custkey % 3) AS k_max,
    CASE c_custkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 0 END AS size, CASE c_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 2 END AS ceil
  FROM (SELECT 'm' || c_nationkey AS merchant_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS version, c_custkey FROM customer) JOIN starts USING (merchant_id)),
pins AS (
  SELECT attempt_uid, s.merchant_id, max(version) AS version FROM sess s LEFT JOIN vers v ON v.merchant_id = s.merchant_id AND v.created_ms <= CASE WHEN inside THEN o ELSE ingest_ms END GROUP BY ALL),
setting AS (
  SELECT attempt_uid, coalesce(p.version, 1) AS version, coalesce(d, 0e0) AS d, coalesce(gap, 0.08e0) AS gap, coalesce(k_max, 40) AS k_max, coalesce(size, 5) AS size, coalesce(ceil, 3) AS ceil
  FROM pins p LEFT JOIN vers v ON v.merchant_id = p.merchant_id AND v.version = p.version),
tgt AS (
  SELECT s.*, g.* EXCLUDE (attempt_uid), l.n >= k_max AS cap,
    CASE WHEN NOT s.inside THEN 0 WHEN NOT coalesce(c.corroborated, false) THEN 1
         WHEN score >= 0.7e0 + d THEN 5 WHEN score >= 0.3e0 + d THEN 3 WHEN score >= 0.1e0 + d THEN 2 ELSE 1 END AS target,
    row_number() OVER (PARTITION BY s.merchant_id, entity_type, entity_key ORDER BY ingest_ms, seq) AS rn
  FROM sess s LEFT JOIN corr c USING (attempt_uid) JOIN live l USING (attempt_uid) JOIN setting g USING (attempt_uid)),
fold AS (
  SELECT merchant_id, entity_type, entity_key, rn, attempt_uid, target AS l2, cap AS advisory, CASE WHEN cap THEN 0 ELSE target END AS cur FROM tgt WHERE rn = 1
  UNION ALL
  SELECT merchant_id, entity_type, entity_key, rn, attempt_uid, l2, cap AND was = 0, CASE WHEN cap AND was = 0 THEN 0 ELSE l2 END
  FROM (
    SELECT t.*, f.cur AS was, CASE WHEN NOT t.inside THEN 0
      WHEN t.target < f.cur AND f.cur >= 2 AND score >= (CASE f.cur WHEN 2 THEN 0.1e0 WHEN 3 THEN 0.3e0 WHEN 4 THEN 0.5e0 ELSE 0.7e0 END) + d - gap THEN f.cur ELSE t.target END AS l2
    FROM fold f JOIN tgt t ON t.merchant_id = f.merchant_id AND t.entity_type = f.entity_type AND t.entity_key = f.entity_key AND t.rn = f.rn + 1)),
prop AS (
  SELECT t.*, f.advisory, greatest(f.l2, CASE rule_tier WHEN 'challenge' THEN 3 WHEN 'throttle' THEN 2 ELSE 0 END) AS pr FROM tgt t JOIN fold f USING (attempt_uid)),
elig AS (SELECT *, least(pr, ceil) > 0 AND NOT advisory AS el, greatest(size, 1) AS n FROM prop),
ord AS (SELECT *, coalesce(sum(CASE WHEN el THEN 1 ELSE 0 END) OVER (PARTITION BY merchant_id ORDER BY ingest_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS od FROM elig),
arm AS (SELECT *, el AND size > 0 AND (od % n) = CAST(('0x' || sha256(merchant_id || ':' || version || ':' || CAST(od // n AS BIGINT))[1:16]) AS UBIGINT) % n AS control FROM ord),
tiers AS (SELECT ['allow', 'monitor', 'throttle', 'challenge', 'step_up', 'block'] AS names)
"""


def policy_versions(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("m"), "c_nationkey").alias("merchant_id"), "c_custkey")
    empty = spark.createDataFrame([], "merchant_id string, c_custkey long, version int")
    numbered = TB.append_version(empty, rows, ["c_custkey"])
    starts = attempts(spark, sf_dir).groupBy("merchant_id").agg(F.min("ingest_ms").alias("t0"))
    step, kind = F.lit(0.02) * (F.col("c_custkey") % 5), F.col("c_custkey") % 3
    by_kind = lambda *values: F.element_at(F.array(*map(F.lit, values)), (kind + 1).cast("int"))
    return numbered.join(starts, "merchant_id").select(
        "merchant_id", "version", (F.col("t0") + 24 * HOUR + (F.col("version").cast("long") - 1) * F.lit(48 * HOUR)).alias("created_ms"),
        F.create_map(*(x for tier, theta in THETAS.items() for x in (F.lit(tier), F.lit(theta) + step))).alias("thetas"),
        (F.lit(0.04) * kind).alias("hysteresis_gap"), (20 + 10 * kind).cast("int").alias("k_max"),
        by_kind(0.2, 0.5, 0.0).alias("control_fraction"), by_kind("challenge", "block", "throttle").alias("auto_ceiling"),
    )


@query(
    "policy_resolve_versions",
    f"""WITH RECURSIVE {ATTEMPTS_SQL}, {EVIDENCE_SQL}, {CORR_SQL}, {LIVE_SQL}, {VERSION_SQL} SELECT attempt_uid, version AS policy_version, names[pr + 1] AS proposed_tier,
    names[CASE WHEN advisory OR control THEN 0 ELSE least(pr, ceil) END + 1] AS in_force_tier, control AS control_arm, advisory, pr > ceil AS requires_confirmation FROM arm, tiers""",
)
def _resolve_versions(spark, sf_dir):
    kw = counted(spark, sf_dir)
    out = P.resolve_pinned(live_rows(spark, sf_dir, **kw), policy_versions(spark, sf_dir), THETAS, POLICY, **kw)
    return out.select("attempt_uid", "policy_version", "proposed_tier", "in_force_tier", "control_arm", "advisory", "requires_confirmation")


@query("hysteresis", f"{DECIDED} SELECT attempt_uid, CAST(l2 AS INTEGER) AS l2_tier FROM decided")
def _hysteresis(spark, sf_dir):
    return resolved(spark, sf_dir).select("attempt_uid", F.col("l2_tier").cast("int").alias("l2_tier"))


TRANSITION_SQL = """
pk AS (SELECT *, greatest(1, coalesce(max(pr) OVER (PARTITION BY incident_id ORDER BY ingest_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS peak FROM decided WHERE inside),
tr AS (
  SELECT incident_id, CAST(NULL AS VARCHAR) AS from_tier, 'monitor' AS to_tier, 'open:' || detector AS trigger, signal_value, ingest_ms AS moment, seq, 0 AS z FROM pk WHERE opens
  UNION ALL SELECT incident_id, names[peak + 1], proposed_tier, 'policy:' || detector || ':in_control', signal_value, ingest_ms, seq, 1 FROM pk, tiers WHERE pr > peak),
trans AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY moment, seq, z) - 1 AS ordinal FROM tr)
"""


@query(
    "tier_transitions",
    f"""{DECIDED}, {TRANSITION_SQL} SELECT 'T' || upper(sha1(incident_id || '|' || ordinal)[1:25]) AS transition_id, incident_id, CAST(ordinal AS INTEGER) AS ordinal, from_tier, to_tier, trigger,
    round(signal_value, 6) AS signal_value, moment AS "at" FROM trans""",
)
def _transitions(spark, sf_dir):
    rows = resolved(spark, sf_dir).filter(F.col("incident_id").isNotNull())
    return P.tier_transitions(rows).withColumn("signal_value", F.round("signal_value", 6))


ACTION_SQL = """
acts AS (
  SELECT 'A' || upper(sha1(incident_id || '|' || entity_type || '|' || entity_key || '|' || proposed_tier)[1:25]) AS action_id, incident_id, merchant_id, entity_type, entity_key,
    proposed_tier AS tier, pr > 3 AS requires_confirmation, min(ingest_ms) AS t
  FROM decided WHERE inside AND pr >= 2 AND NOT control AND NOT advisory GROUP BY ALL),
actions AS (SELECT *, CASE WHEN NOT requires_confirmation THEN 'auto' END AS confirmed_by, CASE WHEN NOT requires_confirmation THEN t END AS applied_at, t + 900000 AS expires_at FROM acts)
"""


@query("enforcement_rows", f"{DECIDED}, {ACTION_SQL} SELECT action_id, incident_id, merchant_id, entity_type, entity_key, tier, requires_confirmation, confirmed_by, applied_at, expires_at FROM actions")
def _enforcement(spark, sf_dir):
    return P.enforcement_rows(resolved(spark, sf_dir)).drop("released_at", "applied_by")


LIFE_SQL = """
conf AS (SELECT row_number() OVER (ORDER BY action_id) AS event_id, incident_id, action_id, CASE WHEN action_id < 'A4' THEN 'block' ELSE tier END AS tier, t + 1000 AS moment FROM actions WHERE tier IN ('block', 'challenge')),
ok AS (SELECT c.action_id, min(c.moment) AS moment FROM conf c JOIN actions a USING (action_id) WHERE c.tier = a.tier AND a.requires_confirmation AND c.tier IN ('step_up', 'block') GROUP BY 1),
res AS (SELECT incident_id, min(t) + 5000 AS moment FROM actions WHERE incident_id < 'I4' GROUP BY 1),
life AS (SELECT a.action_id, a.merchant_id, a.entity_type, a.entity_key, a.requires_confirmation AND o.action_id IS NULL AS requires_confirmation,
  CASE WHEN o.action_id IS NOT NULL THEN 'operator' ELSE a.confirmed_by END AS confirmed_by, coalesce(o.moment, a.applied_at) AS applied_at, r.moment AS released_at
  FROM actions a LEFT JOIN ok o USING (action_id) LEFT JOIN res r ON r.incident_id = a.incident_id)
"""


def lifecycle(spark, sf_dir):
    """Enforcement rows after an operator confirmed every blocking row and resolved some of the incidents."""
    rows = materialize(resolved(spark, sf_dir).filter(F.col("incident_id").isNotNull()), "decided")
    actions = P.enforcement_rows(rows)
    start = F.col("expires_at") - POLICY["enforcement_ttl_ms"]
    confirmations = actions.filter(F.col("tier").isin("block", "challenge")).select(
        F.col("action_id").alias("event_id"), "incident_id", "action_id",
        F.when(F.col("action_id") < "A4", "block").otherwise(F.col("tier")).alias("tier"), (start + 1000).alias("at"),
    )
    resolutions = actions.filter(F.col("incident_id") < "I4").groupBy("incident_id").agg((F.min(start) + 5000).alias("at")).select(
        F.col("incident_id").alias("event_id"), "incident_id", F.lit("false_positive").alias("resolution"), "at"
    )
    table = rows.filter("opens").select(
        "incident_id", F.lit("OPEN").alias("state"), F.lit(None).cast("long").alias("closed_at"),
        F.lit(None).cast("string").alias("resolution"), F.lit(None).cast("string").alias("resolved_by"),
    )
    return P.enforcement_lifecycle(actions, table, confirmations, resolutions)


@query("enforcement_lifecycle", f"{DECIDED}, {ACTION_SQL}, {LIFE_SQL} SELECT action_id, requires_confirmation, confirmed_by, applied_at, released_at FROM life")
def _lifecycle(spark, sf_dir):
    return lifecycle(spark, sf_dir)[0].select("action_id", "requires_confirmation", "confirmed_by", "applied_at", "released_at")


@query(
    "enforcement_lifecycle_incidents",
    f"""{DECIDED}, {ACTION_SQL}, {LIFE_SQL} SELECT incident_id, CASE WHEN r.moment IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS state, r.moment AS closed_at, CASE WHEN r.moment IS NOT NULL THEN 'false_positive' END AS resolution,
    CASE WHEN r.moment IS NOT NULL THEN 'operator' END AS resolved_by FROM decided LEFT JOIN res r USING (incident_id) WHERE opens AND inside""",
)
def _lifecycle_incidents(spark, sf_dir):
    return lifecycle(spark, sf_dir)[1]


@query(
    "enforcement_lifecycle_rejects",
    f"""{DECIDED}, {ACTION_SQL}, {LIFE_SQL} SELECT action_id AS event_id, 'confirm' AS kind, CASE WHEN c.tier <> a.tier OR c.tier NOT IN ('step_up', 'block') THEN 'tier is not a proposed enforcement' ELSE 'not awaiting confirmation' END AS reason
    FROM conf c JOIN actions a USING (action_id) WHERE c.tier <> a.tier OR c.tier NOT IN ('step_up', 'block') OR NOT a.requires_confirmation""",
)
def _lifecycle_rejects(spark, sf_dir):
    return lifecycle(spark, sf_dir)[2]


@query(
    "active_enforcement_count",
    f"{DECIDED}, {ACTION_SQL}, {LIFE_SQL} SELECT merchant_id, count(DISTINCT entity_type || ':' || entity_key) AS active FROM life WHERE released_at IS NULL GROUP BY 1",
)
def _active(spark, sf_dir):
    return P.active_enforcement_count(lifecycle(spark, sf_dir)[0])


@query(
    "incident_narratives",
    f"""{BASE}, n AS (
      SELECT i.incident_id, i.entity_type, s.rule_tier AS tier, s.k, s.k % 7 AS v1, s.k % 5 AS v2, s.k % 4 AS v3, i.entity_type || '_' || s.k AS pseudonym FROM inc i JOIN sess s ON s.attempt_uid = i.open_uid),
    r AS (SELECT *, v1 >= 4 AS f1, v2 >= 3 AS f2, v3 >= 2 AS f3 FROM n),
    q AS (SELECT *, (f1 OR f2 OR f3) AS anyf, CASE WHEN f1 OR NOT (f1 OR f2 OR f3) THEN v1 / 4.0 ELSE -1 END AS r1, CASE WHEN f2 OR NOT (f1 OR f2 OR f3) THEN v2 / 3.0 ELSE -1 END AS r2,
      CASE WHEN f3 OR NOT (f1 OR f2 OR f3) THEN v3 / 2.0 ELSE -1 END AS r3 FROM r),
    p AS (SELECT *, CASE WHEN r1 >= r2 AND r1 >= r3 THEN 1 WHEN r2 >= r3 THEN 2 ELSE 3 END AS best FROM q)
    SELECT incident_id, 'Entity ' || pseudonym || ' (' || entity_type || ') was assigned tier "' || tier || '". Triggering signal: ' ||
      CASE best WHEN 1 THEN 'attempt volume from one IP within 60 seconds' WHEN 2 THEN 'distinct cards attempted from one IP within 5 minutes' ELSE 'distinct cards attempted against one BIN within 5 minutes' END
      || ', value ' || CASE best WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END || ' against threshold ' || CASE best WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 2 END || '. Rules fired: '
      || CASE WHEN anyf THEN concat_ws(', ', CASE WHEN f1 THEN 'attempts_per_ip_60s' END, CASE WHEN f2 THEN 'distinct_cards_per_ip_5m' END, CASE WHEN f3 THEN 'distinct_cards_per_bin_5m' END) ELSE 'none' END || '.' AS narrative FROM p""",
)
def _narratives(spark, sf_dir):
    opened = sessions(spark, sf_dir).filter("opens")
    heads = opened.select("incident_id", "entity_type", F.concat_ws("_", "entity_type", "k").alias("pseudonym"), F.col("rule_tier").alias("tier"))
    marks = [(r[0], d, t) for r, d, t in zip(K.RULES, (7, 5, 4), (4, 3, 2))]
    rules = F.explode(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("name"), (F.col("k") % d).alias("value"), F.lit(t).alias("threshold"), ((F.col("k") % d) >= t).alias("fired"))
        for i, (n, d, t) in enumerate(marks)
    ]))
    results = opened.select("incident_id", rules.alias("_r")).select("incident_id", "_r.*")
    return I.incident_narratives(heads, results).select("incident_id", "narrative")


@query(
    "incident_detail",
    f"""{DECIDED}, {TRANSITION_SQL}, {ACTION_SQL},
    nw AS (SELECT incident_id, arg_max(in_force_tier, seq) AS in_force_tier FROM decided WHERE inside GROUP BY 1),
    tl AS (SELECT incident_id, count(*) AS n_transitions, max(ordinal) AS last_ordinal FROM trans GROUP BY 1),
    ac AS (SELECT incident_id, string_agg(tier, ',' ORDER BY tier) AS action_tiers FROM actions GROUP BY 1),
    kv AS (SELECT 'ip' AS entity_type, ip AS entity_key, user_agent, ingest_ms FROM attempts UNION ALL SELECT 'bin', bin, user_agent, ingest_ms FROM attempts),
    ua AS (SELECT entity_type, entity_key, arg_max(user_agent, ingest_ms) AS user_agent FROM kv GROUP BY 1, 2)
    SELECT i.incident_id, nw.in_force_tier, n_transitions, coalesce(action_tiers, '') AS action_tiers, ua.user_agent
    FROM inc i JOIN nw USING (incident_id) JOIN tl USING (incident_id) LEFT JOIN ac USING (incident_id) JOIN ua ON ua.entity_type = i.entity_type AND ua.entity_key = i.entity_key""",
)
def _detail(spark, sf_dir):
    rows = materialize(resolved(spark, sf_dir).filter(F.col("incident_id").isNotNull()), "decided")
    heads = rows.filter("opens").select("incident_id", "merchant_id", "opened_at")
    entities = rows.groupBy("incident_id", "entity_type", "entity_key").agg(
        F.count(F.lit(1)).alias("attempt_count"), F.min("ingest_ms").alias("first_seen"), F.max("ingest_ms").alias("last_seen")
    ).withColumn("pseudonym", F.concat_ws("_", "entity_type", "entity_key"))
    scores = rows.select(
        "incident_id", "attempt_uid", F.col("ingest_ms").alias("scored_at"), F.col("in_force_tier").alias("decision"),
        F.lit(None).cast("string").alias("top_contributors"),
    )
    base = attempts(spark, sf_dir).withColumn("ipua_key", F.lit(None).cast("string"))
    out = I.incident_detail(heads, entities, P.tier_transitions(rows), P.enforcement_rows(rows), scores, base)
    tiers = F.array_join(F.transform(F.coalesce("enforcement", F.array()), lambda a: a["tier"]), ",")
    return out.select(
        "incident_id", "in_force_tier", F.size("timeline").cast("long").alias("n_transitions"), tiers.alias("action_tiers"),
        F.col("client_evidence.user_agent").alias("user_agent"),
    )
