"""The whole decision path as one batch job: accept, features, rules, score, detectors, incidents, policy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import columns as C
from riskloom.operators import detectors as D, incidents as I, policy as P
from riskloom.operators.counters import idempotent_accept
from riskloom.operators.features import COUNTS, INPUTS, WIDTHS, apply_rules, enrich_attempts, feature_vector
from riskloom.operators.prefix import hot_keys
from riskloom.session import materialize


def decide(
    attempts: DataFrame,
    lam: DataFrame,
    q_hi: float,
    score: Callable[[DataFrame], DataFrame] | None = None,
    thetas: dict[str, float] | None = None,
    widths: dict = WIDTHS,
    rules: tuple = K.RULES,
    policy: dict = K.POLICY,
    cusum: dict = K.CUSUM,
    drift: dict = K.DRIFT,
    ttl_ms: int = K.IDEM_TTL_MS,
    versions: DataFrame | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """One decided row per accepted attempt.

    ``score`` adds the calibrated probability ``p`` to the feature rows; without it the rule score stands in
    under the steady-state prior. ``lam`` comes from ``baseline_lambda0``, ``q_hi`` from the learned card
    quantiles. With ``versions`` (see ``resolve_pinned``) attempts are flagged by the throttle threshold of the version live at their
    time and resolved by the one their incident pins. The regime does not feed back into ``p`` here; ``closed_loop_regime`` covers that loop.
    The feature table is written once because rows and bucket counts both read it. ``columns`` names the columns of the attempts and
    of the feature table that the caller reads; without it all stay. Whatever is worked out on the way is worked out all the same,
    but the others do not travel any farther than they are read.
    """
    thetas = thetas or C.tier_ladder_values()
    base = enrich_attempts(attempts).select(*INPUTS, "idem_digest")
    # What is not hot among all attempts is not hot among the accepted ones.
    hot = hot_keys(base, [["merchant_id", "idem_digest"], ["merchant_id", "event_id"], ["merchant_id", "card_hash"]])
    accepted = idempotent_accept(base, ttl_ms=ttl_ms, hot=hot).filter("accepted")
    ruled = apply_rules(feature_vector(accepted, widths, hot=hot), rules)
    scored = score(ruled) if score is not None else ruled.withColumn("p", F.col("rule_score"))
    rows = I.resolve_entity(scored.withColumn("ua_class", F.lit(None).cast("string")), I.evidence_scope(F.col("rules_fired")))
    read = {"attempt_uid", "merchant_id", "seq", "ingest_ms", "card_hash", "distinct_cards_per_ip_30m", *(columns or ())}
    spare = [] if columns is None else [c for c in (*INPUTS, *K.FEATURE_NAMES, *COUNTS) if c not in read]
    rows = materialize(rows.drop("ua_class", *(c for c in spare if c in INPUTS)), "features").drop(*spare)

    hot = hot_keys(rows, [["merchant_id"], I.ENTITY])
    cooldown = policy["cooldown_s"] * 1000
    flagged = F.col("p") >= thetas["throttle"]
    if versions is not None:
        rows, limits, _ = P.version_settings(P.live_version(rows, versions, F.col("ingest_ms"), "_live", hot=hot), versions, thetas, policy, "_live")
        flagged = F.col("p") >= F.try_element_at(limits, F.lit("throttle"))
    rows = D.cusum_live_peek(rows, flagged, lam, cusum["rho"], cusum["h"], cusum["bucket_s"], hot=hot)
    # From here to the incidents all goes by entity, so the rows are dealt once.
    rows = D.sprt_drift(rows, I.ENTITY, "distinct_cards_per_ip_30m", F.lit(float(q_hi)), drift, hot=hot)
    sourced = F.col("entity_type").isin("ip", "ipua")
    rows = rows.withColumns({"drift_fired": F.col("drift_fired") & sourced, "drift_lambda": F.when(sourced, F.col("drift_lambda")).otherwise(0.0)})
    rows = D.entity_history(D.detector_label(rows), I.ENTITY, dealt=True, hot=hot).withColumn("cusum_stat", F.col("s_live"))
    rows = I.corroborated(I.incident_sessions(rows, cooldown, hot=hot), hot=hot)
    rows = I.live_incident_count(rows, cooldown, hot=hot)
    if versions is None:
        return P.policy_resolve(rows, thetas, policy, hot=hot)
    return P.resolve_pinned(rows.drop("_live", "_set"), versions, thetas, policy, hot=hot)


def score_records(decided: DataFrame, prior: Column | float = K.COST_MODEL["prior_steady_state"]) -> DataFrame:
    """The score table's columns of decided rows."""
    return decided.select(
        "attempt_uid", F.col("rule_score").alias("score_raw"), F.col("p").alias("score_calibrated"),
        (prior if isinstance(prior, Column) else F.lit(prior)).alias("prior_used"), F.col("in_force_tier").alias("decision"),
        F.lit("domestic").alias("tier_ladder"), "control_arm", F.lit(False).alias("shed"), "rules_fired", *K.FEATURE_NAMES,
        "incident_id", F.col("ingest_ms").alias("scored_at"),
    )
