"""Verification of signed gateway outcome reports."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.columns import json_number, json_text


def canonical_body() -> Column:
    """The report body as compact JSON with sorted keys."""
    reached = F.when(F.col("reached_gateway"), "true").otherwise("false")
    parts = [
        ('{"auth_fee_minor":', json_number(F.col("auth_fee_minor"))),
        (',"decline_code":', json_text(F.col("decline_code"))),
        (',"event_id":', json_text(F.col("event_id"))),
        (',"gateway_latency_ms":', json_number(F.col("gateway_latency_ms"))),
        (',"gateway_status":', json_text(F.col("gateway_status"))),
        (',"reached_gateway":', reached),
    ]
    return F.concat(*[x for label, value in parts for x in (F.lit(label), value)], F.lit("}"))


def signing_text(merchant: Column, timestamp: Column, nonce: Column) -> Column:
    return F.concat_ws("\n", merchant, timestamp.cast("long").cast("string"), nonce, F.sha2(canonical_body(), 256))


def hmac_sha256(secret: str):
    """Column function: hex HMAC-SHA256 of a text under ``secret``."""
    key = secret.encode("utf-8")

    @F.pandas_udf("string")
    def sign(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else hmac.new(key, t.encode("utf-8"), hashlib.sha256).hexdigest())

    return sign


def verify_outcomes(
    reports: DataFrame, merchants: DataFrame, attempts: DataFrame, secret: str, staleness_ms: int = K.OUTCOME_STALENESS_MS,
    seen_nonces: DataFrame | None = None,
) -> DataFrame:
    """Adds ``attempt_uid`` and ``reason``; null means recorded.

    ``reports``: seq, now_ms, api_key, signature, timestamp (text), nonce and the body fields. ``merchants``:
    merchant_id, api_key_hash, outcome_hmac_key_hash. Checks stop at the first failure. Of the reports that
    pass everything else, the first one with a nonce wins.
    """
    known = merchants.select("merchant_id", F.col("api_key_hash").alias("_key"), F.col("outcome_hmac_key_hash").alias("_bound"))
    lookup = attempts.groupBy("merchant_id", "event_id").agg(F.min_by("attempt_uid", "seq").alias("attempt_uid"))
    stamp = F.expr("try_cast(timestamp as bigint)")
    missing = F.lit(False)
    for name in ("api_key", "signature", "timestamp", "nonce"):
        missing = missing | F.col(name).isNull() | (F.length(name) == 0)
    rows = reports.withColumn("_key", F.sha2("api_key", 256)).join(known, "_key", "left")
    rows = rows.join(lookup, ["merchant_id", "event_id"], "left")
    expected = hmac_sha256(secret)(signing_text(F.col("merchant_id"), stamp, F.col("nonce")))
    bound = hashlib.sha256(secret.encode("utf-8")).hexdigest()
    reason = (
        F.when(missing | stamp.isNull(), "unsigned")
        .when(F.abs(F.col("now_ms") - stamp) > staleness_ms, "stale")
        .when(F.col("merchant_id").isNull(), "unknown key")
        .when(F.coalesce(F.col("_bound"), F.lit("")) != bound, "secret not bound to merchant")
        .when(F.coalesce(F.col("_expected"), F.lit("")) != F.col("signature"), "bad signature")
        .when(F.col("attempt_uid").isNull(), "unknown event_id")
    )
    judged = rows.withColumn("_expected", expected).withColumn("_reason", reason)
    # The winner is matched on nonce and position, so the copies of one nonce stay spread out.
    winners = judged.filter(F.col("_reason").isNull()).groupBy("nonce").agg(F.min("seq").alias("seq")).withColumn("_wins", F.lit(True))
    if seen_nonces is not None:
        winners = winners.join(seen_nonces.select("nonce"), "nonce", "left_anti")
    judged = judged.join(winners, ["nonce", "seq"], "left")
    replay = F.col("_reason").isNull() & F.col("_wins").isNull()
    return judged.select(
        *reports.columns, "merchant_id", F.when(F.col("_reason").isNull() & ~replay, F.col("attempt_uid")).alias("attempt_uid"),
        F.when(replay, "replayed nonce").otherwise(F.col("_reason")).alias("reason"),
    )


def recorded_outcomes(verified: DataFrame) -> DataFrame:
    """One outcome per attempt: the first recorded report."""
    body = ["gateway_status", "decline_code", "gateway_latency_ms", "auth_fee_minor", "reached_gateway"]
    first = verified.filter(F.col("reason").isNull()).groupBy("attempt_uid").agg(F.min_by(F.struct(*body, F.col("now_ms").alias("ingest_time")), "seq").alias("_r"))
    return first.select("attempt_uid", "_r.*", F.lit(True).alias("sig_verified"))
