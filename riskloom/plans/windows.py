"""Registered queries: derived columns, window statistics, counters, rules, live views."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.operators import counters, features
from riskloom.operators.sweep import Concentration, Count, Distinct, add_window_stats, max_sliding_distinct_per_key
from riskloom.plans.registry import query
from riskloom.plans.views import ATTEMPTS_SQL, DAY, HOUR, LONG, MID, SHORT, attempts

WIDTHS = {"short": SHORT, "mid": MID, "long": LONG, "card_ttl": 2 * DAY}
RULES = (
    ("attempts_per_ip_60s", 3, "throttle", "velocity"),
    ("distinct_cards_per_ip_5m", 4, "challenge", "velocity"),
    ("distinct_cards_per_bin_5m", 8, "challenge", "bin_structure"),
)


def enriched(spark, sf_dir):
    return features.enrich_attempts(attempts(spark, sf_dir))


_J = lambda c: f"""CASE WHEN {c} IS NULL THEN 'null' ELSE '"' || {c} || '"' END"""
_N = lambda c: f"coalesce(CAST({c} AS VARCHAR), 'null')"
ENRICHED_SQL = ATTEMPTS_SQL + f""",
digested AS (
  SELECT *,
    sha256('{{"amount_minor": ' || {_N('amount_minor')} || ', "bin": ' || {_J('bin')} || ', "card_hash": ' || {_J('card_hash')}
      || ', "currency": ' || {_J('currency')} || ', "exp_month": ' || {_N('exp_month')} || ', "exp_year": ' || {_N('exp_year')}
      || ', "last4": ' || {_J('last4')} || ', "session_id": ' || {_J('session_id')} || '}}') AS payload_digest,
    CASE WHEN user_agent ILIKE '%headless%' OR user_agent ILIKE '%phantomjs%' THEN 'headless'
         WHEN regexp_matches(lower(user_agent), 'bot|spider|crawler|curl|python-requests') THEN 'known_bot'
         WHEN regexp_matches(lower(user_agent), 'mobile|android|iphone|ipad') THEN 'mobile_browser'
         WHEN regexp_matches(lower(user_agent), 'mozilla|chrome|safari|firefox|edg') THEN 'desktop_browser'
         ELSE 'unparseable' END AS ua_class
  FROM attempts),
enriched AS (
  SELECT *, sha256(merchant_id || '|' || event_id || '|' || payload_digest) AS idem_digest,
    sha1(ip || '|' || ua_class) AS ipua_key,
    coalesce(nullif(session_id, ''), 'nosession:' || ip) AS session_key,
    ingest_ms // 10000 AS bucket
  FROM digested)
"""


@query(
    "enrich_attempts",
    f"WITH {ENRICHED_SQL} SELECT attempt_uid, payload_digest, idem_digest, ua_class, ipua_key, session_key, bucket FROM enriched",
)
def _enrich(spark, sf_dir):
    return enriched(spark, sf_dir).select(
        "attempt_uid", "payload_digest", "idem_digest", "ua_class", "ipua_key", "session_key", "bucket"
    )


# --- one query per window statistic -----------------------------------------------------
def _over(key: str, width: int) -> str:
    part = "merchant_id" if key == "merchant_id" else f"merchant_id, {key}"
    return f"OVER (PARTITION BY {part} ORDER BY ingest_ms RANGE BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"


def _count_query(name: str, key: str, width: int) -> None:
    sql = f"WITH {ENRICHED_SQL} SELECT attempt_uid, count(*) {_over(key, width)} AS {name} FROM enriched"

    @query(name, sql)
    def _run(spark, sf_dir):
        keys = ["merchant_id"] if key == "merchant_id" else ["merchant_id", key]
        columns = list(dict.fromkeys(["attempt_uid", "seq", "ingest_ms", *keys]))
        df = enriched(spark, sf_dir).select(*columns)
        return add_window_stats(df, keys, [Count(name, width)]).select("attempt_uid", name)


def _distinct_query(name: str, key: str, member: str, width: int, out: str | None = None) -> None:
    out = out or name
    sql = f"WITH {ATTEMPTS_SQL} SELECT attempt_uid, count(DISTINCT {member}) {_over(key, width)} AS {out} FROM attempts"

    @query(name, sql)
    def _run(spark, sf_dir):
        df = attempts(spark, sf_dir).select("attempt_uid", "seq", "ingest_ms", "merchant_id", key, member)
        return add_window_stats(df, ["merchant_id", key], [Distinct(out, member, width)]).select("attempt_uid", out)


for _name, _key, _width in (
    ("attempts_per_ip_60s", "ip", SHORT),
    ("attempts_per_ip_5m", "ip", MID),
    ("attempts_per_ipua_5m", "ipua_key", MID),
    ("attempts_per_session", "session_key", LONG),
    ("attempts_per_merchant_5m", "merchant_id", HOUR),
):
    _count_query(_name, _key, _width)
for _name, _key, _member, _width in (
    ("distinct_cards_per_ip_5m", "ip", "card_hash", MID),
    ("distinct_cards_per_ip_30m", "ip", "card_hash", LONG),
    ("distinct_bins_per_ip_5m", "ip", "bin", MID),
    ("distinct_ips_per_bin_5m", "bin", "ip", MID),
    ("distinct_cards_per_bin_5m", "bin", "card_hash", MID),
    ("distinct_amounts_per_ip_5m", "ip", "amount_minor", LONG),
):
    _distinct_query(_name, _key, _member, _width)
_distinct_query("sliding_distinct", "bin", "ip", LONG, "n_distinct")

CONCENTRATION_SQL = f""",
pairs AS (
  SELECT a.attempt_uid, b.bin, count(*) AS c
  FROM attempts a JOIN attempts b ON a.merchant_id = b.merchant_id AND a.ip = b.ip
   AND b.ingest_ms > a.ingest_ms - {MID} AND b.ingest_ms <= a.ingest_ms
  GROUP BY a.attempt_uid, b.bin),
sized AS (SELECT *, sum(c) OVER (PARTITION BY attempt_uid) AS n FROM pairs),
conc AS (
  SELECT attempt_uid, sum((c / n) * (c / n)) AS hhi,
    CASE WHEN count(*) = 1 THEN 0.0 ELSE -sum((c / n) * ln(c / n)) END AS entropy
  FROM sized GROUP BY attempt_uid)
"""


def _concentration(name: str, columns: dict[str, str]) -> None:
    picks = ", ".join(f"round({src}, 6) AS {dst}" for src, dst in columns.items())

    @query(name, f"WITH {ATTEMPTS_SQL}{CONCENTRATION_SQL} SELECT attempt_uid, {picks} FROM conc")
    def _run(spark, sf_dir):
        df = attempts(spark, sf_dir).select("attempt_uid", "seq", "ingest_ms", "merchant_id", "ip", "bin")
        out = add_window_stats(df, ["merchant_id", "ip"], [Concentration("hhi", "entropy", "bin", MID)])
        return out.select("attempt_uid", *[F.round(src, 6).alias(dst) for src, dst in columns.items()])


_concentration("bin_hhi_5m", {"hhi": "bin_hhi_5m"})
_concentration("bin_entropy_5m", {"entropy": "bin_entropy_5m"})
_concentration("sliding_concentration", {"hhi": "hhi", "entropy": "entropy"})


@query(
    "max_sliding_distinct_per_key",
    f"""WITH {ATTEMPTS_SQL}, d AS (SELECT merchant_id, ip, count(DISTINCT card_hash) {_over('ip', LONG)} AS n FROM attempts)
    SELECT merchant_id, ip, max(n) AS peak FROM d GROUP BY merchant_id, ip""",
)
def _peak(spark, sf_dir):
    df = attempts(spark, sf_dir).select("seq", "ingest_ms", "merchant_id", "ip", "card_hash")
    return max_sliding_distinct_per_key(df, ["merchant_id", "ip"], "card_hash", LONG)


# --- counters ---------------------------------------------------------------------------
_ANCHOR_SQL = """
{prefix},
ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ingest_ms, seq) AS rn FROM {source}),
walk AS (
  SELECT {keys}, rn, seq, attempt_uid, ingest_ms, ingest_ms AS anchor_ms, attempt_uid AS anchor_uid, CAST(1 AS BIGINT) AS ordinal
  FROM ranked WHERE rn = 1
  UNION ALL
  SELECT {rkeys}, r.rn, r.seq, r.attempt_uid, r.ingest_ms,
    CASE WHEN r.ingest_ms >= w.anchor_ms + {ttl} THEN r.ingest_ms ELSE w.anchor_ms END,
    CASE WHEN r.ingest_ms >= w.anchor_ms + {ttl} THEN r.attempt_uid ELSE w.anchor_uid END,
    CASE WHEN r.ingest_ms >= w.anchor_ms + {ttl} THEN 1 ELSE w.ordinal + 1 END
  FROM walk w JOIN ranked r ON {join} AND r.rn = w.rn + 1)
"""


def anchor_sql(prefix: str, source: str, keys: list[str], ttl: int) -> str:
    return _ANCHOR_SQL.format(
        prefix=prefix, source=source, keys=", ".join(keys), rkeys=", ".join(f"r.{k}" for k in keys), ttl=ttl,
        join=" AND ".join(f"r.{k} = w.{k}" for k in keys),
    )


@query(
    "anchored_ttl_counter",
    f"WITH RECURSIVE {anchor_sql(ATTEMPTS_SQL, 'attempts', ['merchant_id', 'ip'], 5 * DAY)} SELECT attempt_uid, anchor_ms, ordinal FROM walk",
)
def _anchored(spark, sf_dir):
    df = attempts(spark, sf_dir).select("attempt_uid", "seq", "ingest_ms", "merchant_id", "ip")
    return counters.anchored_ttl_counter(df, ["merchant_id", "ip"], 5 * DAY).select("attempt_uid", "anchor_ms", "ordinal")


_SAME_SQL = ATTEMPTS_SQL + ", same AS (SELECT *, sha256(ip || '|' || card_hash) AS digest FROM attempts)"


def _same_card(spark, sf_dir):
    return attempts(spark, sf_dir).withColumn("digest", F.sha2(F.concat_ws("|", "ip", "card_hash"), 256))


@query(
    "idempotent_accept",
    f"""WITH RECURSIVE {anchor_sql(_SAME_SQL, 'same', ['merchant_id', 'digest'], 3 * DAY)}
    SELECT attempt_uid, ordinal = 1 AS accepted, anchor_uid AS stored_attempt_uid FROM walk""",
)
def _accept(spark, sf_dir):
    df = _same_card(spark, sf_dir).select("attempt_uid", "merchant_id", "seq", "ingest_ms", "digest")
    out = counters.idempotent_accept(df, "digest", 3 * DAY)
    return out.select("attempt_uid", "accepted", "stored_attempt_uid")


@query(
    "stored_decision_reply",
    f"""WITH RECURSIVE {anchor_sql(_SAME_SQL, 'same', ['merchant_id', 'digest'], 3 * DAY)}
    SELECT w.attempt_uid, w.anchor_uid AS stored_attempt_uid,
      CASE WHEN a.score >= 0.3 THEN 'challenge' ELSE 'allow' END AS decision
    FROM walk w JOIN attempts a ON a.attempt_uid = w.anchor_uid WHERE w.ordinal > 1""",
)
def _reply(spark, sf_dir):
    df = _same_card(spark, sf_dir)
    accepted = counters.idempotent_accept(df.select("attempt_uid", "merchant_id", "seq", "ingest_ms", "digest"), "digest", 3 * DAY)
    decisions = df.select("attempt_uid", F.when(F.col("score") >= 0.3, "challenge").otherwise("allow").alias("decision"))
    return counters.stored_decision_reply(accepted, decisions).select("attempt_uid", "stored_attempt_uid", "decision")


@query(
    "event_id_reuse",
    f"WITH {ENRICHED_SQL} SELECT attempt_uid, count(DISTINCT payload_digest) OVER (PARTITION BY merchant_id, event_id ORDER BY ingest_ms) AS event_id_reuse_count FROM enriched",
)
def _reuse(spark, sf_dir):
    df = enriched(spark, sf_dir).select("attempt_uid", "merchant_id", "event_id", "seq", "ingest_ms", "payload_digest")
    return counters.event_id_reuse(df).select("attempt_uid", "event_id_reuse_count")


@query(
    "card_seen_24h",
    f"WITH RECURSIVE {anchor_sql(ATTEMPTS_SQL, 'attempts', ['merchant_id', 'card_hash'], 2 * DAY)} SELECT attempt_uid, ordinal AS card_seen_24h FROM walk",
)
def _card(spark, sf_dir):
    df = attempts(spark, sf_dir).select("attempt_uid", "merchant_id", "card_hash", "seq", "ingest_ms")
    return counters.card_seen(df, 2 * DAY).select("attempt_uid", "card_seen_24h")


@query(
    "card_seen_24h_refresh",
    f"""WITH {ATTEMPTS_SQL}, g AS (
      SELECT *, CASE WHEN ingest_ms - lag(ingest_ms) OVER w < {8 * HOUR} THEN 0 ELSE 1 END AS fresh
      FROM attempts WINDOW w AS (PARTITION BY merchant_id, card_hash ORDER BY ingest_ms, seq)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY merchant_id, card_hash ORDER BY ingest_ms, seq) AS part FROM g)
    SELECT attempt_uid, row_number() OVER (PARTITION BY merchant_id, card_hash, part ORDER BY ingest_ms, seq) AS card_seen_24h FROM s""",
)
def _card_refresh(spark, sf_dir):
    df = attempts(spark, sf_dir).select("attempt_uid", "merchant_id", "card_hash", "seq", "ingest_ms")
    return counters.card_seen(df, 8 * HOUR, "refresh").select("attempt_uid", "card_seen_24h")


@query(
    "shed_counter",
    f"WITH RECURSIVE {anchor_sql(ATTEMPTS_SQL, 'attempts', ['merchant_id', 'ip'], DAY)} SELECT attempt_uid, ordinal AS shed_count FROM walk",
)
def _shed(spark, sf_dir):
    df = attempts(spark, sf_dir).select("attempt_uid", "merchant_id", "ip", "seq", "ingest_ms")
    return counters.shed_counter(df, DAY).select("attempt_uid", "shed_count")


@query(
    "shed_rung",
    f"""WITH RECURSIVE {anchor_sql(ATTEMPTS_SQL, 'attempts', ['merchant_id', 'ip'], DAY)}
    SELECT attempt_uid, CAST(ordinal AS DOUBLE) AS attempts_per_ip_60s, CASE WHEN ordinal >= 4 THEN 'throttle' ELSE 'allow' END AS decision FROM walk""",
)
def _rung(spark, sf_dir):
    df = attempts(spark, sf_dir).select("attempt_uid", "merchant_id", "ip", "seq", "ingest_ms")
    return counters.shed_rung(df, 4, DAY).select("attempt_uid", "attempts_per_ip_60s", "decision")


# --- features and rules -----------------------------------------------------------------
_FED_SQL = f"""
windowed AS (
  SELECT attempt_uid,
    count(*) {_over('ip', SHORT)} AS attempts_per_ip_60s,
    count(*) {_over('ip', MID)} AS attempts_per_ip_5m,
    count(*) {_over('ipua_key', MID)} AS attempts_per_ipua_5m,
    count(DISTINCT bin) {_over('ip', MID)} AS distinct_bins_per_ip_5m,
    count(DISTINCT ip) {_over('bin', MID)} AS distinct_ips_per_bin_5m,
    count(DISTINCT card_hash) {_over('bin', MID)} AS distinct_cards_per_bin_5m,
    count(*) {_over('session_key', LONG)} AS attempts_per_session,
    count(DISTINCT amount_minor) {_over('ip', MID)} AS distinct_amounts_per_ip_5m,
    count(DISTINCT payload_digest) OVER (PARTITION BY merchant_id, event_id ORDER BY ingest_ms) AS event_id_reuse_count,
    count(DISTINCT card_hash) {_over('ip', MID)} AS distinct_cards_per_ip_5m,
    count(DISTINCT card_hash) {_over('ip', LONG)} AS distinct_cards_per_ip_30m,
    count(*) {_over('merchant_id', MID)} AS attempts_per_merchant_5m
  FROM enriched)
"""


def feature_sql() -> str:
    picks = []
    for name in K.FEATURE_NAMES:
        if name in K.UNFED_FEATURES:
            picks.append(f"CAST(0.0 AS DOUBLE) AS {name}")
        elif name == "card_seen_24h":
            picks.append("CAST(c.ordinal AS DOUBLE) AS card_seen_24h")
        elif name in ("bin_hhi_5m", "bin_entropy_5m"):
            picks.append(f"round(k.{'hhi' if 'hhi' in name else 'entropy'}, 6) AS {name}")
        else:
            picks.append(f"CAST(w.{name} AS DOUBLE) AS {name}")
    extra = "w.distinct_cards_per_ip_5m, w.distinct_cards_per_ip_30m, w.attempts_per_merchant_5m"
    walk = anchor_sql(ENRICHED_SQL, "enriched", ["merchant_id", "card_hash"], 2 * DAY)
    return (
        f"WITH RECURSIVE {walk}{CONCENTRATION_SQL}, {_FED_SQL} SELECT w.attempt_uid, {', '.join(picks)}, {extra} "
        "FROM windowed w JOIN walk c USING (attempt_uid) JOIN conc k USING (attempt_uid)"
    )


@query("feature_vector", feature_sql())
def _features(spark, sf_dir):
    out = features.feature_vector(enriched(spark, sf_dir), WIDTHS)
    rounded = {n: F.round(n, 6) for n in ("bin_hhi_5m", "bin_entropy_5m")}
    extra = ["distinct_cards_per_ip_5m", "distinct_cards_per_ip_30m", "attempts_per_merchant_5m"]
    return out.withColumns(rounded).select("attempt_uid", *K.FEATURE_NAMES, *extra)


RULES_SQL = f"""
stats AS (
  SELECT attempt_uid, seq, ingest_ms, merchant_id, ip, bin, card_hash, score, user_id, is_attack, episode_id,
    count(*) {_over('ip', SHORT)} AS attempts_per_ip_60s,
    count(DISTINCT card_hash) {_over('ip', MID)} AS distinct_cards_per_ip_5m,
    count(DISTINCT card_hash) {_over('bin', MID)} AS distinct_cards_per_bin_5m
  FROM attempts),
ruled AS (
  SELECT *, attempts_per_ip_60s >= 3 AS r1, distinct_cards_per_ip_5m >= 4 AS r2, distinct_cards_per_bin_5m >= 8 AS r3,
    concat_ws(',', CASE WHEN attempts_per_ip_60s >= 3 THEN 'attempts_per_ip_60s' END,
      CASE WHEN distinct_cards_per_ip_5m >= 4 THEN 'distinct_cards_per_ip_5m' END,
      CASE WHEN distinct_cards_per_bin_5m >= 8 THEN 'distinct_cards_per_bin_5m' END) AS rules_fired,
    CASE WHEN distinct_cards_per_ip_5m >= 4 OR distinct_cards_per_bin_5m >= 8 THEN 'challenge'
         WHEN attempts_per_ip_60s >= 3 THEN 'throttle' ELSE 'allow' END AS rule_tier,
    least(1.0, greatest(attempts_per_ip_60s / 3.0, distinct_cards_per_ip_5m / 4.0, distinct_cards_per_bin_5m / 8.0)) AS rule_score
  FROM stats)
"""


def ruled(spark, sf_dir):
    """Attempts with rule statistics and verdicts, at the widths the shared data needs."""
    df = attempts(spark, sf_dir).select(
        "attempt_uid", "seq", "ingest_ms", "merchant_id", "ip", "bin", "card_hash", "score", "user_id", "is_attack", "episode_id"
    )
    return features.apply_rules(features.rule_statistics(df, WIDTHS), RULES)


@query(
    "rules_r1_r2_r3",
    f"""WITH {ATTEMPTS_SQL}, {RULES_SQL} SELECT attempt_uid, merchant_id, ingest_ms, attempts_per_ip_60s, distinct_cards_per_ip_5m,
    distinct_cards_per_bin_5m, rules_fired, rule_tier AS decision FROM ruled""",
)
def _rules(spark, sf_dir):
    return ruled(spark, sf_dir).select(
        "attempt_uid", "merchant_id", "ingest_ms", "attempts_per_ip_60s", "distinct_cards_per_ip_5m",
        "distinct_cards_per_bin_5m", F.array_join("rules_fired", ",").alias("rules_fired"),
        features.capped_tier(F.col("rule_tier")).alias("decision"),
    )


@query("rule_minimum_tier", f"WITH {ATTEMPTS_SQL}, {RULES_SQL} SELECT rule_tier, count(*) AS n FROM ruled GROUP BY rule_tier")
def _minimum(spark, sf_dir):
    return ruled(spark, sf_dir).groupBy("rule_tier").agg(F.count(F.lit(1)).alias("n"))


@query("rule_score", f"WITH {ATTEMPTS_SQL}, {RULES_SQL} SELECT attempt_uid, round(CAST(rule_score AS DOUBLE), 6) AS rule_score FROM ruled")
def _score(spark, sf_dir):
    return ruled(spark, sf_dir).select("attempt_uid", F.round("rule_score", 6).alias("rule_score"))


THREAT_SQL = f"""
sev AS (SELECT *, CASE WHEN r2 OR r3 THEN 2 WHEN r1 THEN 1 ELSE 0 END AS severity FROM ruled),
lvl AS (
  SELECT *, coalesce(max(severity) OVER (PARTITION BY merchant_id ORDER BY ingest_ms RANGE BETWEEN {2 * HOUR - 1} PRECEDING AND CURRENT ROW), 0) AS lv FROM sev),
grp AS (SELECT *, max(CASE WHEN lv > 0 THEN ingest_ms END) OVER (PARTITION BY merchant_id ORDER BY ingest_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS loud FROM lvl),
quiet AS (SELECT *, min(CASE WHEN lv = 0 THEN ingest_ms END) OVER (PARTITION BY merchant_id, loud) AS q FROM grp)
"""


@query(
    "threat_rollup",
    f"""WITH {ATTEMPTS_SQL}, {RULES_SQL}, {THREAT_SQL}
    SELECT attempt_uid, CASE WHEN lv = 2 THEN 'under_attack' WHEN lv = 1 THEN 'elevated' WHEN loud IS NULL THEN 'calm'
      WHEN ingest_ms - q >= {HOUR // 2} THEN 'calm' ELSE 'resolved' END AS threat_state FROM quiet""",
)
def _threat(spark, sf_dir):
    df = ruled(spark, sf_dir)
    df = df.select(
        "attempt_uid", "merchant_id", "seq", "ingest_ms", features.severity(F.col("rules_fired"), F.col("rule_tier")).alias("severity")
    )
    return features.threat_rollup(df, 2 * HOUR, HOUR // 2).select("attempt_uid", "threat_state")


@query(
    "recent_events",
    f"""WITH {ATTEMPTS_SQL}, buf AS (SELECT * FROM attempts ORDER BY seq DESC LIMIT 200)
    SELECT attempt_uid, ip, bin, ingest_ms FROM buf
    WHERE seq > coalesce((SELECT max(seq) FROM buf WHERE attempt_uid = (SELECT max(attempt_uid) - 50 FROM attempts)), -1)""",
)
def _recent(spark, sf_dir):
    df = attempts(spark, sf_dir).select("attempt_uid", "seq", "ip", "bin", "ingest_ms")
    cursor = df.agg(F.max("attempt_uid")).first()[0] - 50
    return features.recent_events(df, after=cursor).select("attempt_uid", "ip", "bin", "ingest_ms")


@query(
    "live_tiles",
    f"""WITH {ENRICHED_SQL}, {_FED_SQL}, buf AS (SELECT * FROM attempts ORDER BY seq DESC LIMIT 200)
    SELECT b.merchant_id, arg_max(w.attempts_per_merchant_5m, b.seq) AS attempts_5m, max(w.distinct_cards_per_ip_5m) AS cards_per_ip_top
    FROM buf b JOIN windowed w USING (attempt_uid) GROUP BY b.merchant_id""",
)
def _tiles(spark, sf_dir):
    df = attempts(spark, sf_dir).select("attempt_uid", "seq", "ingest_ms", "merchant_id", "ip", "card_hash")
    df = add_window_stats(df, ["merchant_id", "ip"], [Distinct("distinct_cards_per_ip_5m", "card_hash", MID)])
    df = add_window_stats(df, ["merchant_id"], [Count("attempts_per_merchant_5m", MID)])
    return features.live_tiles(features.recent_events(df))
