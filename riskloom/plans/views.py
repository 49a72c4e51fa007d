"""Payment-attempt views over the generic ``events`` table, as DataFrames and as the same SQL text.

The shared data has no payment table, so each event stands for one attempt: the user is the source
address, ``props.k`` the card, its tens digit the issuer prefix. Events are minutes apart, so registered
queries use window widths of hours; library defaults are the contract's own values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.plans.registry import table

HOUR = K.HOUR_MS
DAY = K.DAY_MS
SHORT, MID, LONG = 6 * HOUR, 24 * HOUR, 72 * HOUR


def _epoch_ms(df: DataFrame):
    if dict(df.dtypes)["ts"] == "timestamp":
        return F.unix_millis("ts")
    return F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")


def shape_attempts(df: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    user, kind = F.col("user_id"), F.col("event_type")
    base = df.select(
        F.col("event_id").alias("attempt_uid"),
        F.col("event_id").alias("seq"),
        _epoch_ms(df).cast("long").alias("ingest_ms"),
        "user_id", "event_type", "value", k.alias("k"),
    )
    day = F.expr("ingest_ms div 86400000")
    attack = user % 10 == 0
    return base.select(
        "attempt_uid", "seq", "ingest_ms", "user_id", "k",
        F.concat(F.lit("m"), user % 4).alias("merchant_id"),
        F.concat(F.lit("e"), user, F.lit("-"), F.col("k")).alias("event_id"),
        F.concat(F.lit("ip"), user).alias("ip"),
        F.concat(F.lit("b"), F.floor(F.col("k") / 10)).alias("bin"),
        F.concat(F.lit("c"), F.col("k")).alias("card_hash"),
        F.round(F.col("value") * 100).cast("long").alias("amount_minor"),
        F.lit("INR").alias("currency"),
        F.when(kind == "view", F.lit(None)).when(kind == "click", "")
        .otherwise(F.concat(F.lit("s"), user, F.lit("-"), day)).alias("session_id"),
        F.when(F.col("k") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("00"), F.col("k"))).alias("last4"),
        F.when(F.col("k") % 5 == 0, F.lit(None)).otherwise(F.col("k") % 12 + 1).cast("int").alias("exp_month"),
        F.when(F.col("k") % 5 == 0, F.lit(None)).otherwise(F.lit(2030)).cast("int").alias("exp_year"),
        F.when(kind == "purchase", "Mozilla/5.0 (iPhone) Mobile Safari")
        .when(kind == "view", "HeadlessChrome/120")
        .when(kind == "click", "Mozilla/5.0 Chrome")
        .when(kind == "signup", "python-requests/2.31").otherwise("").alias("user_agent"),
        F.when(kind == "error", "declined").otherwise("approved").alias("gateway_status"),
        F.when(kind == "error", "do_not_honor").alias("decline_code"),
        attack.alias("is_attack"),
        F.when(attack, F.concat(F.lit("ep"), user, F.lit("-"), day))
        .when(user % 10 == 1, F.concat(F.lit("nc"), user)).alias("episode_id"),
        F.least(F.col("value") / 500.0, F.lit(1.0)).alias("score"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_attempts(table(spark, sf_dir, "events"))


ATTEMPTS_SQL = """
base AS (
  SELECT event_id AS attempt_uid, event_id AS seq, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ingest_ms, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
attempts AS (
  SELECT attempt_uid, seq, ingest_ms, user_id, k,
    'm' || (user_id % 4) AS merchant_id,
    'e' || user_id || '-' || k AS event_id,
    'ip' || user_id AS ip,
    'b' || (k // 10) AS bin,
    'c' || k AS card_hash,
    CAST(round(value * 100) AS BIGINT) AS amount_minor,
    'INR' AS currency,
    CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN ''
         ELSE 's' || user_id || '-' || (ingest_ms // 86400000) END AS session_id,
    CASE WHEN k % 3 = 0 THEN NULL ELSE '00' || k END AS last4,
    CASE WHEN k % 5 = 0 THEN NULL ELSE k % 12 + 1 END AS exp_month,
    CASE WHEN k % 5 = 0 THEN NULL ELSE 2030 END AS exp_year,
    CASE event_type WHEN 'purchase' THEN 'Mozilla/5.0 (iPhone) Mobile Safari' WHEN 'view' THEN 'HeadlessChrome/120'
         WHEN 'click' THEN 'Mozilla/5.0 Chrome' WHEN 'signup' THEN 'python-requests/2.31' ELSE '' END AS user_agent,
    CASE WHEN event_type = 'error' THEN 'declined' ELSE 'approved' END AS gateway_status,
    CASE WHEN event_type = 'error' THEN 'do_not_honor' END AS decline_code,
    user_id % 10 = 0 AS is_attack,
    CASE WHEN user_id % 10 = 0 THEN 'ep' || user_id || '-' || (ingest_ms // 86400000)
         WHEN user_id % 10 = 1 THEN 'nc' || user_id END AS episode_id,
    least(value / 500.0, 1.0) AS score
  FROM base)
"""


def labels(attempts_df: DataFrame) -> DataFrame:
    return attempts_df.select(
        "merchant_id", "event_id", "attempt_uid", "is_attack", "episode_id", "gateway_status", "decline_code"
    )


def episodes(attempts_df: DataFrame) -> DataFrame:
    """Truth rows of the labelled activity: one per attack user and day, one per control user."""
    user = F.first("user_id")
    names = F.array(*[F.lit(s) for s in K.SCENARIOS])
    tiers = F.array(*[F.lit(t) for t in K.STREAM_TIERS])
    grouped = attempts_df.filter(F.col("episode_id").isNotNull()).groupBy("episode_id").agg(
        F.max("user_id").alias("_u"),
        F.min("ingest_ms").alias("started_at"),
        F.max("ingest_ms").alias("ended_at"),
        F.count(F.lit(1)).alias("attempt_count"),
        F.countDistinct("card_hash").alias("distinct_cards"),
    )
    control = F.col("_u") % 10 == 1
    slot = F.floor(F.col("_u") / 10)
    return grouped.select(
        "episode_id",
        F.when(control, "negative_control").otherwise("attack").alias("kind"),
        F.when(~control, F.element_at(tiers, (slot % 4 + 1).cast("int"))).alias("tier"),
        F.when(control, F.element_at(names, (slot % 7 + 1).cast("int"))).alias("scenario"),
        "started_at", "ended_at", "attempt_count", "distinct_cards",
    )


EPISODES_SQL = """
episodes AS (
  SELECT episode_id,
    CASE WHEN max(user_id) % 10 = 1 THEN 'negative_control' ELSE 'attack' END AS kind,
    CASE WHEN max(user_id) % 10 <> 1 THEN (['easy','medium','hard','evasive'])[(max(user_id) // 10) % 4 + 1] END AS tier,
    CASE WHEN max(user_id) % 10 = 1 THEN (['flash_sale','corporate_nat','cgnat','retry_storm','subscription_batch','nri_traffic','shared_ip_legit'])[(max(user_id) // 10) % 7 + 1] END AS scenario,
    min(ingest_ms) AS started_at, max(ingest_ms) AS ended_at, count(*) AS attempt_count,
    count(DISTINCT card_hash) AS distinct_cards
  FROM attempts WHERE episode_id IS NOT NULL GROUP BY episode_id)
"""
