"""Registered queries: training, scoring, calibration and outcome reports."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators import layer1 as L, outcomes as O, ranking as R
from riskloom.plans.evaluate import scored
from riskloom.plans.registry import query
from riskloom.plans.views import ATTEMPTS_SQL, HOUR, attempts
from riskloom.plans.evaluate import SCORED_SQL

FEATURES = ["card_number", "amount", "hour", "declined", "session_open"]
ROUNDS, DEPTH = 4, 3


def _features(spark, sf_dir):
    """Attempt features with a target that depends on them."""
    rows = attempts(spark, sf_dir)
    label = (F.col("k") > 60) & (F.col("amount_minor") > 3000) | (F.col("k") % 11 == 0)
    return rows.select(
        "attempt_uid", "seq", "ingest_ms", label.alias("is_attack"), F.col("k").alias("card_number"), F.col("amount_minor").alias("amount"),
        C.hour_of_day(F.col("ingest_ms")).alias("hour"), (F.col("gateway_status") == "declined").cast("int").alias("declined"),
        F.col("session_id").isNotNull().cast("int").alias("session_open"),
    )


def matrix(spark, sf_dir):
    rows = _features(spark, sf_dir)
    samples = rows.select("attempt_uid", "seq", "is_attack")
    return L.training_matrix(samples, rows.select("attempt_uid", *FEATURES), ["attempt_uid"], FEATURES, ("hour",))


def model(spark, sf_dir):
    return L.train_gbt(matrix(spark, sf_dir), ROUNDS, DEPTH)


@query(
    "training_matrix",
    f"WITH {ATTEMPTS_SQL} SELECT attempt_uid, CASE WHEN (k > 60 AND amount_minor > 3000) OR k % 11 = 0 THEN 1.0e0 ELSE 0.0e0 END AS target, CAST(k AS DOUBLE) AS card_number, CAST(amount_minor AS DOUBLE) AS amount, 0.0e0 AS \"hour\" FROM attempts",
)
def _matrix(spark, sf_dir):
    return matrix(spark, sf_dir).select("attempt_uid", "target", "card_number", "amount", "hour")


@query("train_gbt")
def _train(spark, sf_dir):
    fitted = model(spark, sf_dir)
    margins = L.score_margin(fitted, matrix(spark, sf_dir))
    return R.roc_auc(margins.withColumn("label", F.col("target") == 1.0), score="margin").select(F.round("auc", 6).alias("auc"), "n_pos", "n_neg")


@query("score_margin")
def _margin(spark, sf_dir):
    out = L.score_margin(model(spark, sf_dir), matrix(spark, sf_dir))
    return out.select("attempt_uid", F.round("margin", 6).alias("margin"))


@query("early_stop_trace")
def _trace(spark, sf_dir):
    data = matrix(spark, sf_dir)
    return L.early_stop_trace(L.train_gbt(data.filter("seq % 5 <> 0"), ROUNDS, DEPTH), data.filter("seq % 5 = 0"), 0.05)


@query("top_contributors")
def _top(spark, sf_dir):
    out = L.top_contributors(model(spark, sf_dir), matrix(spark, sf_dir), FEATURES, 3)
    best = F.element_at("top_contributors", 1)
    return out.select("attempt_uid", F.round("margin", 6).alias("margin"), best["feature"].alias("feature"), best["contribution"].alias("contribution"))


@query("fit_platt")
def _platt(spark, sf_dir):
    df = scored(spark, sf_dir).select((8 * F.col("score") - 2).alias("margin"), ((F.col("k") + 60 * F.col("score")) > 70).alias("label"))
    a, b, prevalence, n = L.fit_platt(df)
    return df.limit(1).select(F.lit(round(a, 6)).alias("a"), F.lit(round(b, 6)).alias("b"), F.lit(round(prevalence, 6)).alias("pi_train"), F.lit(n).cast("long").alias("n"))


# A score starts a step when every slope up to its place in the cumulative diagram is below every slope from there on.
ISO_SQL = """
g AS (SELECT score, count(*) AS n, count(*) FILTER (k > 40 + 30 * (score < 0.2)::INT) AS p FROM scored GROUP BY 1),
d AS (
  SELECT score, CAST(sum(n) OVER w - n AS BIGINT) AS x, CAST(sum(p) OVER w - p AS BIGINT) AS y FROM g WINDOW w AS (ORDER BY score)
  UNION ALL SELECT CAST('inf' AS DOUBLE), CAST(sum(n) AS BIGINT), CAST(sum(p) AS BIGINT) FROM g),
sl AS (SELECT b.x, max(CASE WHEN a.x < b.x THEN (b.y - a.y) / (b.x - a.x) END) AS before, min(CASE WHEN a.x > b.x THEN (a.y - b.y) / (a.x - b.x) END) AS after FROM d a, d b GROUP BY 1),
corner AS (SELECT d.* FROM d JOIN sl USING (x) WHERE before IS NULL OR after IS NULL OR before < after),
iso AS (SELECT score AS start, value FROM (SELECT score, (lead(y) OVER (ORDER BY x) - y) / (lead(x) OVER (ORDER BY x) - x) AS value FROM corner) WHERE value IS NOT NULL)
"""


def _iso_rows(spark, sf_dir):
    df = scored(spark, sf_dir)
    return df.withColumn("label", F.col("k") > 40 + 30 * (F.col("score") < 0.2).cast("int"))


@query("predict_isotonic", f"WITH {SCORED_SQL}, {ISO_SQL} SELECT ordinal, round(value, 9) AS calibrated FROM scored ASOF JOIN iso ON scored.score >= iso.start")
def _predict(spark, sf_dir):
    df = _iso_rows(spark, sf_dir)
    return L.predict_isotonic(df, L.fit_isotonic(df)).select("ordinal", F.round("calibrated", 9).alias("calibrated"))


@query("fit_isotonic", f"WITH {SCORED_SQL}, {ISO_SQL} SELECT start, round(value, 9) AS value FROM iso")
def _iso(spark, sf_dir):
    return L.fit_isotonic(_iso_rows(spark, sf_dir)).withColumn("value", F.round("value", 9))


_Q = "least(greatest(score, 1e-6), 1 - 1e-6)"


@query("prior_correct", f"WITH {ATTEMPTS_SQL} SELECT attempt_uid, round(1 / (1 + exp(-(ln({_Q} / (1 - {_Q})) + ln(0.001e0 / 0.999e0) - ln(0.6e0 / 0.4e0)))), 9) AS p FROM attempts")
def _prior(spark, sf_dir):
    return attempts(spark, sf_dir).select("attempt_uid", F.round(C.prior_correct(F.col("score"), 0.6, 0.001), 9).alias("p"))


@query(
    "serving_prior",
    f"WITH {ATTEMPTS_SQL}, o AS (SELECT attempt_uid, k, CASE WHEN k % 2 = 0 THEN 'alarm' ELSE 'in_control' END AS regime, greatest(k * k - 50, 0) * 0.001e0 / 0.999e0 AS odds FROM attempts) SELECT attempt_uid, round(CASE WHEN regime = 'alarm' THEN least(greatest(odds / (1 + odds), 0.001), 0.95) ELSE 0.001 END, 9) AS prior FROM o",
)
def _serving(spark, sf_dir):
    regime = F.when(F.col("k") % 2 == 0, "alarm").otherwise("in_control")
    prior = C.serving_prior(regime, (F.col("k") * F.col("k") - 50).cast("double"))
    return attempts(spark, sf_dir).select("attempt_uid", F.round(prior, 9).alias("prior"))


@query(
    "apply_calibrator",
    f"WITH {ATTEMPTS_SQL}, z AS (SELECT attempt_uid, 1 / (1 + exp(-(1.03522e0 * (8 * score - 3) - 1.83302e0))) AS score FROM attempts) SELECT attempt_uid, round(1 / (1 + exp(-(ln({_Q} / (1 - {_Q})) + ln(0.001e0 / 0.999e0) - ln(0.72508e0 / (1 - 0.72508e0))))), 9) AS p FROM z",
)
def _calibrate(spark, sf_dir):
    p = C.apply_calibrator(8 * F.col("score") - 3, 1.03522, -1.83302, 0.72508, 0.001)
    return attempts(spark, sf_dir).select("attempt_uid", F.round(p, 9).alias("p"))


# --- outcome reports --------------------------------------------------------------------
SECRET = "outcome-demo-secret"


def outcome_reports(spark, sf_dir):
    """A signed report per declined or approved attempt, some of them spoiled in each possible way."""
    k = F.col("k")
    rows = attempts(spark, sf_dir).select(
        "seq", "attempt_uid", "merchant_id", "k", F.col("attempt_uid").cast("string").alias("event_id"), "gateway_status", "decline_code",
        F.lit(340).cast("long").alias("gateway_latency_ms"), F.lit(200).cast("long").alias("auth_fee_minor"), F.lit(True).alias("reached_gateway"),
        (F.col("ingest_ms") + 1000).alias("sent"), F.concat(F.lit("n"), F.when(k == 70, F.col("ip")).otherwise(F.col("seq").cast("string"))).alias("nonce"),
    ).withColumn("event_id", F.when(k == 60, F.concat(F.lit("x"), "event_id")).otherwise(F.col("event_id")))
    signed = rows.withColumn("signature", O.hmac_sha256(SECRET)(O.signing_text(F.col("merchant_id"), F.col("sent"), F.col("nonce"))))
    return signed.select(
        "seq", (F.col("sent") + F.when(k == 20, 300_001).otherwise(300_000)).alias("now_ms"),
        F.when(k == 30, "key-nobody").otherwise(F.concat(F.lit("key-"), "merchant_id")).alias("api_key"),
        F.when(k == 50, "0" * 64).otherwise(F.col("signature")).alias("signature"),
        F.when(k == 11, "soon").otherwise(F.col("sent").cast("string")).alias("timestamp"),
        F.when(k == 10, "").otherwise(F.col("nonce")).alias("nonce"),
        "event_id", "gateway_status", "decline_code", "gateway_latency_ms", "auth_fee_minor", "reached_gateway",
    )


def outcome_merchants(spark, sf_dir):
    bound = hashlib.sha256(SECRET.encode()).hexdigest()
    return attempts(spark, sf_dir).select("merchant_id").distinct().select(
        "merchant_id", F.sha2(F.concat(F.lit("key-"), "merchant_id"), 256).alias("api_key_hash"),
        F.when(F.col("merchant_id") == "m3", "other").otherwise(bound).alias("outcome_hmac_key_hash"),
    )


@query(
    "verify_outcomes",
    f"""WITH {ATTEMPTS_SQL}, r AS (SELECT seq, k, ip, CASE WHEN k IN (10, 11) THEN 'unsigned' WHEN k = 20 THEN 'stale' WHEN k = 30 THEN 'unknown key' WHEN merchant_id = 'm3' THEN 'secret not bound to merchant'
      WHEN k = 50 THEN 'bad signature' WHEN k = 60 THEN 'unknown event_id' END AS reason FROM attempts)
    SELECT seq, CASE WHEN k = 70 AND reason IS NULL AND row_number() OVER (PARTITION BY k = 70, reason IS NULL, ip ORDER BY seq) > 1 THEN 'replayed nonce' ELSE reason END AS reason FROM r""",
)
def _verify(spark, sf_dir):
    targets = attempts(spark, sf_dir).select("merchant_id", F.col("attempt_uid").cast("string").alias("event_id"), "attempt_uid", "seq")
    out = O.verify_outcomes(outcome_reports(spark, sf_dir), outcome_merchants(spark, sf_dir), targets, SECRET)
    return out.select("seq", "reason")
