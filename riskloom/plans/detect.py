"""Registered queries: admission, baselines, order profiles and sequential detectors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import columns as C
from riskloom.operators import admission, baseline, detectors
from riskloom.operators.sweep import Distinct, add_window_stats
from riskloom.plans.registry import query, table
from riskloom.plans.views import ATTEMPTS_SQL, DAY, HOUR, LONG, MID, attempts
from riskloom.plans.windows import _over

TAU = 0.2
BUCKET_S = 1_800
RHO, H, LAMBDA_MIN = 2.0, 3.0, 0.01
LOG_RHO = f"{math.log(RHO)!r}e0"


def _narrow(spark, sf_dir, *columns):
    return attempts(spark, sf_dir).select("attempt_uid", "seq", "ingest_ms", "merchant_id", *columns)


# --- admission --------------------------------------------------------------------------
@query(
    "token_bucket",
    f"""WITH RECURSIVE {ATTEMPTS_SQL}, t AS (
      SELECT attempt_uid, merchant_id, ingest_ms // 100000 AS ms, row_number() OVER (PARTITION BY merchant_id ORDER BY ingest_ms // 100000, seq) AS rn FROM attempts),
    walk AS (
      SELECT attempt_uid, merchant_id, ms, rn, CAST(5 AS DOUBLE) AS level FROM t WHERE rn = 1
      UNION ALL SELECT t.attempt_uid, t.merchant_id, t.ms, t.rn, least(5, round(w.level - CASE WHEN w.level >= 1 THEN 1 ELSE 0 END + (t.ms - w.ms) * 20 / 1000, 6))
      FROM walk w JOIN t ON t.merchant_id = w.merchant_id AND t.rn = w.rn + 1)
    SELECT attempt_uid, merchant_id, level >= 1 AS admitted FROM walk""",
)
def _tokens(spark, sf_dir):
    # One thousandth of real time, so that a month of events contends for tokens like a busy hour.
    df = _narrow(spark, sf_dir).withColumn("ingest_ms", F.expr("ingest_ms div 100000"))
    return admission.token_bucket(df, rate_per_s=20, burst=5).select("attempt_uid", "merchant_id", "admitted")


@query(
    "availability_alert",
    f"""WITH {ATTEMPTS_SQL}, f AS (
      SELECT attempt_uid, merchant_id, seq, ingest_ms,
        count(*) OVER (PARTITION BY merchant_id ORDER BY ingest_ms RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND CURRENT ROW) AS fail_opens
      FROM attempts WHERE gateway_status = 'declined'),
    g AS (SELECT *, fail_opens >= 5 AS alerting, ingest_ms // {6 * HOUR} AS slot FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY merchant_id, slot, alerting ORDER BY ingest_ms, seq) AS rn FROM g)
    SELECT attempt_uid, fail_opens, alerting, alerting AND rn = 1 AS alert_emitted FROM r""",
)
def _alert(spark, sf_dir):
    df = _narrow(spark, sf_dir, "gateway_status").filter("gateway_status = 'declined'")
    return admission.availability_alert(df, 5, 6 * HOUR).select("attempt_uid", "fail_opens", "alerting", "alert_emitted")


# --- baselines --------------------------------------------------------------------------
def _profile_sql(source: str = "attempts", key: str = "merchant_id") -> str:
    return f"""
hours AS (SELECT {key} AS merchant_id, ingest_ms // {HOUR} AS hr, count(*) AS n FROM {source} GROUP BY 1, 2),
rates AS (SELECT merchant_id, hr % 24 AS hod, sum(n) / count(*) AS rate FROM hours GROUP BY 1, 2),
prof AS (
  SELECT m.merchant_id, CAST(h.hod AS INTEGER) AS hour_of_day, round(CAST(coalesce(r.rate, m.mean) AS DOUBLE), 6) AS rate
  FROM (SELECT merchant_id, avg(rate) AS mean FROM rates GROUP BY 1) m CROSS JOIN (SELECT range AS hod FROM range(24)) h
  LEFT JOIN rates r ON r.merchant_id = m.merchant_id AND r.hod = h.hod)
"""


@query(
    "hourly_volume_profile",
    f"WITH {ATTEMPTS_SQL}, {_profile_sql('attempts', 'ip')} SELECT merchant_id AS ip, hour_of_day, rate FROM prof",
)
def _profile(spark, sf_dir):
    df = attempts(spark, sf_dir).select(F.col("ip").alias("merchant_id"), "ingest_ms")
    return baseline.hourly_volume_profile(df).select(
        F.col("merchant_id").alias("ip"), F.posexplode("hourly_volume_profile").alias("hour_of_day", "rate")
    )


def _grid_sql(source: str, by: str, value: str) -> str:
    qs = ", ".join(str(q) for q in K.QUANTILE_GRID)
    return f"""SELECT {by}, unnest(range(11)) AS idx, round(unnest(quantile_cont({value}, [{qs}])), 6) AS v FROM {source} GROUP BY {by}"""


@query(
    "quantile_grid",
    f"""WITH {ATTEMPTS_SQL}, g AS ({_grid_sql('attempts', 'ip', 'CAST(amount_minor AS DOUBLE)')})
    SELECT ip, CAST(idx AS INTEGER) AS idx, v AS value FROM g""",
)
def _grid(spark, sf_dir):
    df = attempts(spark, sf_dir).select("ip", "amount_minor")
    return baseline.quantile_grid(df, ["ip"], "amount_minor", "grid").select("ip", F.posexplode("grid").alias("idx", "value"))


@query(
    "amount_percentiles",
    f"""WITH {ATTEMPTS_SQL}, q AS (SELECT merchant_id, quantile_cont(CAST(amount_minor AS DOUBLE), [0.05, 0.5, 0.95]) AS p FROM attempts GROUP BY 1)
    SELECT merchant_id, CAST(trunc(p[1]) AS BIGINT) AS amount_p05_minor, CAST(trunc(p[2]) AS BIGINT) AS amount_p50_minor,
      CAST(trunc(p[3]) AS BIGINT) AS amount_p95_minor FROM q""",
)
def _percentiles(spark, sf_dir):
    return baseline.amount_percentiles(attempts(spark, sf_dir), ["merchant_id"])


@query(
    "flagged_rate",
    f"""WITH {ATTEMPTS_SQL}, z AS (SELECT merchant_id, 1 / (1 + exp(-(1.2 * (8 * score - 3) - 0.5))) AS p FROM attempts),
    y AS (SELECT merchant_id, ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) + ln(0.3 / 0.7) - ln(0.6 / 0.4) AS w FROM z)
    SELECT merchant_id, round(avg(CASE WHEN 1 / (1 + exp(-w)) >= {TAU} THEN 1.0 ELSE 0.0 END), 6) AS flagged_rate_mean, count(*) AS sample_count
    FROM y GROUP BY merchant_id""",
)
def _flagged(spark, sf_dir):
    p = C.apply_calibrator(8 * F.col("score") - 3, 1.2, -0.5, 0.6, 0.3)
    return baseline.flagged_rate(attempts(spark, sf_dir), ["merchant_id"], p, TAU)


@query(
    "interp_quantile",
    f"""WITH {ATTEMPTS_SQL}, g AS ({_grid_sql('attempts', 'ip', 'CAST(amount_minor AS DOUBLE)')})
    SELECT ip, round(max(CASE WHEN idx = 9 THEN v END) + 0.5 * (max(CASE WHEN idx = 10 THEN v END) - max(CASE WHEN idx = 9 THEN v END)), 4) AS q95
    FROM g GROUP BY ip""",
)
def _interp(spark, sf_dir):
    grid = baseline.quantile_grid(attempts(spark, sf_dir).select("ip", "amount_minor"), ["ip"], "amount_minor", "grid")
    return grid.select("ip", F.round(C.interp_quantile(F.col("grid"), 0.95), 4).alias("q95"))


_PAIR = "ctl AS (SELECT * FROM attempts WHERE user_id % 10 = 1), rows2 AS (SELECT * FROM ctl UNION ALL SELECT * REPLACE ('pooled' AS merchant_id) FROM ctl)"


def _peaks_sql(width: int, name: str) -> str:
    return f"""{name}_w AS (SELECT merchant_id, ip, count(DISTINCT card_hash) {_over('ip', width)} AS n FROM rows2),
    {name}_p AS (SELECT merchant_id, ip, CAST(max(n) AS DOUBLE) AS peak FROM {name}_w GROUP BY 1, 2),
    {name} AS (SELECT merchant_id, array_to_string(list_transform(quantile_cont(peak, [{', '.join(str(q) for q in K.QUANTILE_GRID)}]), lambda x: CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR)), ',') AS g FROM {name}_p GROUP BY 1)"""


@query(
    "learn_store_baseline",
    f"""WITH {ATTEMPTS_SQL}, {_PAIR}, {_profile_sql('rows2')}, {_peaks_sql(MID, 'g5')}, {_peaks_sql(LONG, 'g30')},
    a AS (SELECT merchant_id, quantile_cont(CAST(amount_minor AS DOUBLE), [0.05, 0.5, 0.95]) AS p, count(*) AS sample_count,
      round(avg(CASE WHEN score >= {TAU} THEN 1.0 ELSE 0.0 END), 6) AS flagged_rate_mean FROM rows2 GROUP BY 1),
    pr AS (SELECT merchant_id, round(sum(rate * (hour_of_day + 1)), 3) AS profile_sum FROM prof GROUP BY 1)
    SELECT a.merchant_id, sample_count, flagged_rate_mean, CAST(trunc(p[1]) AS BIGINT) AS amount_p05_minor, CAST(trunc(p[2]) AS BIGINT) AS amount_p50_minor,
      CAST(trunc(p[3]) AS BIGINT) AS amount_p95_minor, profile_sum, g5.g AS cards_5m, g30.g AS cards_30m
    FROM a JOIN pr USING (merchant_id) JOIN g5 USING (merchant_id) JOIN g30 USING (merchant_id)""",
)
def _learn(spark, sf_dir):
    controls = attempts(spark, sf_dir).filter("user_id % 10 = 1")
    out = baseline.learn_store_baseline(controls, F.col("score"), TAU, MID, LONG)
    grid = lambda k: F.array_join(
        F.transform(F.col("cards_per_ip_quantiles")[k], lambda x: F.round(x * 1000).cast("long").cast("string")), ","
    )
    weighted = F.aggregate(
        F.transform("hourly_volume_profile", lambda r, i: r * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return out.select(
        "merchant_id", "sample_count", "flagged_rate_mean", "amount_p05_minor", "amount_p50_minor", "amount_p95_minor",
        F.round(weighted, 3).alias("profile_sum"), grid("5m").alias("cards_5m"), grid("30m").alias("cards_30m"),
    )


# --- order profiles ---------------------------------------------------------------------
_ORDERS_SQL = """
lines AS (
  SELECT CASE WHEN o_orderstatus = 'P' THEN 'C' ELSE '' END || l_orderkey AS invoice, CAST(l_quantity AS DOUBLE) AS qty,
    l_extendedprice / l_quantity AS price, l_shipdate AS shipped
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
dist AS (
  SELECT invoice, sum(qty * price) AS order_total, min(shipped) AS first_ts FROM lines
  WHERE invoice NOT LIKE 'C%' AND qty IS NOT NULL AND price IS NOT NULL AND shipped IS NOT NULL GROUP BY invoice HAVING sum(qty * price) > 0)
"""


def _orders(spark, sf_dir):
    """Line items as invoices; partly shipped orders play the cancelled ones."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.when(F.col("o_orderstatus") == "P", "C").otherwise(""), F.col("l_orderkey")).alias("invoice"),
        F.col("l_quantity").cast("double").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_shipdate").alias("at"),
    )
    return baseline.distill_orders(lines, "invoice", "qty", "price", "at")


@query("distill_orders", f"WITH {_ORDERS_SQL} SELECT invoice, round(order_total, 2) AS order_total, CAST(first_ts AS VARCHAR)[1:10] AS first_day FROM dist")
def _distill(spark, sf_dir):
    return _orders(spark, sf_dir).select(
        "invoice", F.round("order_total", 2).alias("order_total"), F.date_format("first_ts", "yyyy-MM-dd").alias("first_day")
    )


@query(
    "hour_of_week_weights",
    """WITH d AS (
      SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS first_ts FROM events WHERE event_type <> 'error' AND value IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2 HAVING sum(value) > 0),
    w AS (SELECT (isodow(first_ts) - 1) * 24 + hour(first_ts) AS hw, count(*) AS n FROM d GROUP BY 1)
    SELECT CAST(range AS INTEGER) AS hour_of_week, coalesce(n, 0) AS weight FROM range(168) LEFT JOIN w ON hw = range""",
)
def _weights(spark, sf_dir):
    """A user's events of a day as the lines of one invoice; errors play the cancelled ones."""
    kind = F.when(F.col("event_type") == "error", "C").otherwise("")
    lines = table(spark, sf_dir, "events").select(
        F.concat(kind, F.col("user_id"), F.lit("-"), F.to_date("ts")).alias("invoice"), F.lit(1).alias("qty"), F.col("value").alias("price"), F.col("ts").alias("at")
    )
    return baseline.hour_of_week_weights(baseline.distill_orders(lines, "invoice", "qty", "price", "at"))


@query(
    "order_value_quantiles",
    f"""WITH {_ORDERS_SQL}, c AS (SELECT round(order_total, 2) AS t FROM dist),
    q AS (SELECT quantile_cont(t, list_transform(range(1001), lambda i: i / 1000)) AS v, CAST(round_even(round(avg(t) * 100, 6), 0) AS BIGINT) AS mean_minor FROM c),
    r AS (SELECT unnest(range(1001)) AS idx, unnest(v) AS v, mean_minor FROM q),
    s AS (SELECT CAST(idx AS INTEGER) AS idx, CAST(round_even(round(v * 100, 6), 0) AS BIGINT) AS value_minor, mean_minor FROM r)
    SELECT *, (value_minor * 120000 + mean_minor // 2) // mean_minor AS amount_minor FROM s""",
)
def _values(spark, sf_dir):
    orders = _orders(spark, sf_dir).withColumn("order_total", F.round("order_total", 2))
    return baseline.order_value_quantiles(orders, points=1001, store_aov_minor=K.COST_MODEL["aov_minor"])


# --- CUSUM ------------------------------------------------------------------------------
def _baseline(spark, sf_dir):
    df = _narrow(spark, sf_dir, "score")
    profile = baseline.hourly_volume_profile(df)
    return profile.join(baseline.flagged_rate(df, ["merchant_id"], F.col("score"), TAU), "merchant_id")


def _lam(spark, sf_dir):
    return detectors.baseline_lambda0(_baseline(spark, sf_dir), BUCKET_S, LAMBDA_MIN)


def _counts(spark, sf_dir):
    return detectors.cusum_bucket_counts(_narrow(spark, sf_dir, "score"), F.col("score") >= TAU, BUCKET_S)


LAM_SQL = f"""
{_profile_sql()},
fr AS (SELECT merchant_id, round(avg(CASE WHEN score >= {TAU} THEN 1.0 ELSE 0.0 END), 6) AS flagged_rate FROM attempts GROUP BY 1),
lam AS (SELECT merchant_id, hour_of_day, greatest(greatest(rate, 0) / 3600.0 * {BUCKET_S} * flagged_rate, {LAMBDA_MIN}) AS lam0 FROM prof JOIN fr USING (merchant_id)),
cnt AS (SELECT merchant_id, ingest_ms // {BUCKET_S * 1000} AS bucket, count(*) AS attempts, CAST(sum(CASE WHEN score >= {TAU} THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM attempts GROUP BY 1, 2),
span AS (SELECT merchant_id, unnest(range(min(bucket), max(bucket) + 1)) AS bucket FROM cnt GROUP BY 1),
dense AS (
  SELECT s.merchant_id, s.bucket, coalesce(c.flagged, 0) AS flagged, l.lam0, c.bucket IS NOT NULL AS seen
  FROM span s LEFT JOIN cnt c USING (merchant_id, bucket)
  JOIN lam l ON l.merchant_id = s.merchant_id AND l.hour_of_day = (s.bucket * {BUCKET_S * 1000} // {HOUR}) % 24)
"""
# The recursion itself, bucket by bucket, including the restart length of observed_arl0.
WALK_SQL = f"""{LAM_SQL},
cusum AS (
  SELECT merchant_id, bucket, flagged, lam0, seen, CAST(0 AS DOUBLE) AS s_before,
    greatest(0.0, flagged * {LOG_RHO} - {RHO - 1} * lam0) AS s,
    greatest(0.0, flagged * {LOG_RHO} - {RHO - 1} * lam0) AS r, CAST(1 AS BIGINT) AS len, CAST(0.0 AS DOUBLE) AS prior_ratio
  FROM dense WHERE (merchant_id, bucket) IN (SELECT (merchant_id, min(bucket)) FROM dense GROUP BY merchant_id)
  UNION ALL
  SELECT d.merchant_id, d.bucket, d.flagged, d.lam0, d.seen, c.s,
    greatest(0.0, c.s + d.flagged * {LOG_RHO} - {RHO - 1} * d.lam0),
    greatest(0.0, CASE WHEN c.r > {H} THEN 0.0 ELSE c.r END + d.flagged * {LOG_RHO} - {RHO - 1} * d.lam0),
    CASE WHEN c.r > {H} THEN 1 ELSE c.len + 1 END, c.flagged / c.lam0
  FROM cusum c JOIN dense d ON d.merchant_id = c.merchant_id AND d.bucket = c.bucket + 1)
"""
_CUSUM_PREFIX = f"WITH RECURSIVE {ATTEMPTS_SQL}, {WALK_SQL}"


@query(
    "baseline_lambda0",
    f"WITH {ATTEMPTS_SQL}, {LAM_SQL} SELECT merchant_id, hour_of_day, round(CAST(lam0 AS DOUBLE), 6) AS lam0 FROM lam",
)
def _lambda(spark, sf_dir):
    return _lam(spark, sf_dir).select("merchant_id", F.posexplode("lam").alias("hour_of_day", "lam0")).withColumn("lam0", F.round("lam0", 6))


@query(
    "detection_delay_table",
    f"""WITH {ATTEMPTS_SQL}, {LAM_SQL} SELECT merchant_id, hour_of_day AS hour, round(CAST(lam0 AS DOUBLE), 6) AS lam0, round(CAST({RHO} * lam0 AS DOUBLE), 6) AS lam1,
    round({H} / ({RHO} * lam0 * {LOG_RHO} - ({RHO} * lam0 - lam0)), 6) AS buckets_to_alarm FROM lam""",
)
def _delay(spark, sf_dir):
    out = detectors.detection_delay_table(_baseline(spark, sf_dir), RHO, H, bucket_s=BUCKET_S, lambda_min=LAMBDA_MIN)
    return out.select("merchant_id", "hour", *[F.round(c, 6).alias(c) for c in ("lam0", "lam1", "buckets_to_alarm")])


@query(
    "poisson_cusum",
    f"{_CUSUM_PREFIX} SELECT merchant_id, bucket, flagged, round(CAST(s AS DOUBLE), 6) AS s, s > {H} AS alarm, round(CAST(flagged / lam0 AS DOUBLE), 6) AS rate_ratio FROM cusum",
)
def _cusum(spark, sf_dir):
    out = detectors.poisson_cusum(_counts(spark, sf_dir), _lam(spark, sf_dir), rho=RHO, h=H, bucket_s=BUCKET_S)
    return out.select("merchant_id", "bucket", "flagged", F.round("s", 6).alias("s"), "alarm", F.round("rate_ratio", 6).alias("rate_ratio"))


@query(
    "poisson_cusum_sparse",
    f"{_CUSUM_PREFIX} SELECT merchant_id, bucket, round(CAST(s_before AS DOUBLE), 6) AS s_before, round(CAST(s AS DOUBLE), 6) AS s FROM cusum WHERE seen",
)
def _sparse(spark, sf_dir):
    out = detectors.poisson_cusum_sparse(_counts(spark, sf_dir), _lam(spark, sf_dir), RHO, H, BUCKET_S)
    return out.select("merchant_id", "bucket", F.round("s_before", 6).alias("s_before"), F.round("s", 6).alias("s"))


@query(
    "cusum_live_peek",
    f"""{_CUSUM_PREFIX}, x AS (
      SELECT attempt_uid, merchant_id, ingest_ms // {BUCKET_S * 1000} AS bucket,
        sum(CASE WHEN score >= {TAU} THEN 1 ELSE 0 END) OVER (PARTITION BY merchant_id, ingest_ms // {BUCKET_S * 1000} ORDER BY ingest_ms, seq) AS k FROM attempts)
    SELECT attempt_uid, round(CAST(greatest(0.0, s_before + k * {LOG_RHO} - {RHO - 1} * lam0) AS DOUBLE), 6) AS s_live FROM x JOIN cusum USING (merchant_id, bucket)""",
)
def _peek(spark, sf_dir):
    df = _narrow(spark, sf_dir, "score")
    out = detectors.cusum_live_peek(df, F.col("score") >= TAU, _lam(spark, sf_dir), RHO, H, BUCKET_S)
    return out.select("attempt_uid", F.round("s_live", 6).alias("s_live"))


@query(
    "regime",
    f"""{_CUSUM_PREFIX} SELECT merchant_id, bucket, CASE WHEN s_before > {H} THEN 'alarm' ELSE 'in_control' END AS regime,
    round(CAST(prior_ratio AS DOUBLE), 6) AS prior_rate_ratio FROM cusum WHERE seen""",
)
def _regime(spark, sf_dir):
    out = detectors.regime(_counts(spark, sf_dir), _lam(spark, sf_dir), rho=RHO, h=H, bucket_s=BUCKET_S)
    return out.select("merchant_id", "bucket", "regime", F.round("prior_rate_ratio", 6).alias("prior_rate_ratio"))


@query(
    "tune_cusum_h",
    f"{_CUSUM_PREFIX} SELECT round(CAST(max(s) AS DOUBLE), 6) AS peak, round(CAST(greatest(0.25, least(400.0, max(s))) AS DOUBLE), 6) AS h FROM cusum",
)
def _tune(spark, sf_dir):
    out = detectors.tune_cusum_h(_counts(spark, sf_dir), _lam(spark, sf_dir), rho=RHO, bucket_s=BUCKET_S)
    return out.select(F.round("peak", 6).alias("peak"), F.round("h", 6).alias("h"))


@query(
    "observed_arl0",
    f"""{_CUSUM_PREFIX} SELECT merchant_id, count(*) FILTER (r > {H}) AS alarms,
    round(CAST(coalesce(avg(len) FILTER (r > {H}), count(*)) AS DOUBLE), 6) AS arl0 FROM cusum GROUP BY merchant_id""",
)
def _arl0(spark, sf_dir):
    out = detectors.observed_arl0(_counts(spark, sf_dir), _lam(spark, sf_dir), RHO, H, BUCKET_S)
    return out.select("merchant_id", "alarms", F.round("arl0", 6).alias("arl0"))


@query(
    "cusum_bucket_counts",
    f"""WITH {ATTEMPTS_SQL} SELECT attempt_uid, ingest_ms // {12 * HOUR} AS bucket,
      count(*) OVER w AS attempts_so_far, CAST(sum(CASE WHEN score >= {TAU} THEN 1 ELSE 0 END) OVER w AS BIGINT) AS flagged_so_far
    FROM attempts WINDOW w AS (PARTITION BY merchant_id, ingest_ms // {12 * HOUR} ORDER BY ingest_ms, seq)""",
)
def _in_bucket(spark, sf_dir):
    out = detectors.count_in_bucket(_narrow(spark, sf_dir, "score"), F.col("score") >= TAU, 12 * 3600)
    return out.select("attempt_uid", "bucket", "attempts_so_far", "flagged_so_far")


_CLOCK = "CASE WHEN (seq // 1000) % 3 = 1 THEN ingest_ms - 3456000000 ELSE ingest_ms END"


@query(
    "time_domain_segments",
    f"""WITH {ATTEMPTS_SQL}, c AS (SELECT attempt_uid, merchant_id, seq, ({_CLOCK}) // 10000 AS bucket FROM attempts),
    j AS (SELECT *, CASE WHEN bucket - lag(bucket) OVER (PARTITION BY merchant_id ORDER BY seq) < -17280 THEN 1 ELSE 0 END AS jump FROM c)
    SELECT attempt_uid, CAST(sum(jump) OVER (PARTITION BY merchant_id ORDER BY seq) AS BIGINT) AS segment FROM j""",
)
def _segments(spark, sf_dir):
    # Some stretches of arrivals carry a clock forty days behind, as a replay beside live traffic would.
    df = _narrow(spark, sf_dir).withColumn("ingest_ms", F.expr(_CLOCK.replace("(seq // 1000)", "(seq div 1000)")))
    return detectors.time_domain_segments(df).select("attempt_uid", "segment")


@query("closed_loop_regime")
def _loop(spark, sf_dir):
    df = _narrow(spark, sf_dir, "score").withColumn("margin", 8 * F.col("score") - 1.5)
    out = detectors.closed_loop_regime(
        df, "margin", _lam(spark, sf_dir), 1.1, -0.2, 0.5, 0.02, RHO, H, BUCKET_S, pi0=0.05
    )
    return out.select("merchant_id", "bucket", "regime", F.round("prior", 6).alias("prior"), "flagged", F.round("s", 6).alias("s"))


# --- SPRT and entity evidence -----------------------------------------------------------
_P0, _P1 = 1.0 - K.DRIFT["exceedance_quantile"], K.DRIFT["p1"]
_UP, _DOWN = f"{math.log(_P1 / _P0)!r}e0", f"{math.log((1 - _P1) / (1 - _P0))!r}e0"
_LIMIT = f"{math.log((1 - K.DRIFT['beta']) / K.DRIFT['alpha'])!r}e0"
SPRT_SQL = f"""
st AS (SELECT attempt_uid, merchant_id, ip, seq, ingest_ms, count(DISTINCT card_hash) {_over('ip', LONG)} AS stat FROM attempts),
sr AS (SELECT *, CASE WHEN stat >= 9.5 THEN 1 ELSE 0 END AS z, row_number() OVER (PARTITION BY merchant_id, ip ORDER BY ingest_ms, seq) AS rn FROM st),
drift AS (
  SELECT attempt_uid, merchant_id, ip, rn, z, greatest(0.0, CASE WHEN z = 1 THEN {_UP} ELSE {_DOWN} END) AS lam FROM sr WHERE rn = 1
  UNION ALL
  SELECT s.attempt_uid, s.merchant_id, s.ip, s.rn, s.z, greatest(0.0, d.lam + CASE WHEN s.z = 1 THEN {_UP} ELSE {_DOWN} END)
  FROM drift d JOIN sr s ON s.merchant_id = d.merchant_id AND s.ip = d.ip AND s.rn = d.rn + 1)
"""


def drift_rows(spark, sf_dir, *columns):
    df = _narrow(spark, sf_dir, "ip", "card_hash", *columns)
    df = add_window_stats(df, ["merchant_id", "ip"], [Distinct("stat", "card_hash", LONG)])
    return detectors.sprt_drift(df, ["merchant_id", "ip"], "stat", F.lit(9.5))


@query(
    "sprt_drift",
    f"WITH RECURSIVE {ATTEMPTS_SQL}, {SPRT_SQL} SELECT attempt_uid, z, round(CAST(lam AS DOUBLE), 6) AS drift_lambda, lam >= {_LIMIT} AS drift_fired FROM drift",
)
def _sprt(spark, sf_dir):
    return drift_rows(spark, sf_dir).select("attempt_uid", "z", F.round("drift_lambda", 6).alias("drift_lambda"), "drift_fired")


LABEL_SQL = f"""
bk AS (SELECT attempt_uid, merchant_id, ingest_ms // {BUCKET_S * 1000} AS bucket,
  sum(CASE WHEN score >= {TAU} THEN 1 ELSE 0 END) OVER (PARTITION BY merchant_id, ingest_ms // {BUCKET_S * 1000} ORDER BY ingest_ms, seq) AS k FROM attempts),
lv AS (SELECT attempt_uid, greatest(0.0, s_before + k * {LOG_RHO} - {RHO - 1} * lam0) AS s_live, k / lam0 AS ratio FROM bk JOIN cusum USING (merchant_id, bucket)),
lb AS (
  SELECT attempt_uid, s_live, ratio, d.lam AS drift_lambda, s_live > {H} AS c, d.lam >= {_LIMIT} AS f FROM lv JOIN drift d USING (attempt_uid)),
signals AS (
  SELECT attempt_uid, s_live, CASE WHEN c AND f THEN 'both' WHEN c THEN 'cusum' WHEN f THEN 'drift' ELSE 'none' END AS detector, c OR f AS fired,
    CASE WHEN c THEN ratio ELSE drift_lambda END AS signal_value FROM lb)
"""
SIGNAL_PREFIX = f"{_CUSUM_PREFIX}, {SPRT_SQL}, {LABEL_SQL}"


def signals(spark, sf_dir, *columns):
    """Attempts with both detectors evaluated and labelled."""
    df = drift_rows(spark, sf_dir, "score", *columns)
    df = detectors.cusum_live_peek(df, F.col("score") >= TAU, _lam(spark, sf_dir), RHO, H, BUCKET_S)
    return detectors.detector_label(df)


@query("detector_label", f"{SIGNAL_PREFIX} SELECT attempt_uid, detector, fired, round(CAST(signal_value AS DOUBLE), 6) AS signal_value FROM signals")
def _label(spark, sf_dir):
    return signals(spark, sf_dir).select("attempt_uid", "detector", "fired", F.round("signal_value", 6).alias("signal_value"))


HISTORY_SQL = """
hist AS (
  SELECT attempt_uid, row_number() OVER w - 1 AS attempts_before,
    count(DISTINCT card_hash) OVER (PARTITION BY merchant_id, ip ORDER BY ingest_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cards_before,
    min(ingest_ms) OVER (PARTITION BY merchant_id, ip) AS entity_first_seen
  FROM attempts WINDOW w AS (PARTITION BY merchant_id, ip ORDER BY ingest_ms, seq))
"""


@query("entity_history", f"WITH {ATTEMPTS_SQL}, {HISTORY_SQL} SELECT * FROM hist")
def _history(spark, sf_dir):
    out = detectors.entity_history(_narrow(spark, sf_dir, "ip", "card_hash"), ["merchant_id", "ip"])
    return out.select("attempt_uid", "attempts_before", "cards_before", "entity_first_seen")
