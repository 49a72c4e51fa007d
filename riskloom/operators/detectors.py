"""Sequential change detection: Poisson CUSUM per merchant bucket and an SPRT on distinct cards per entity.

``S = max(0, S + x)`` is evaluated as ``C - min(0, running min of C)``, so no detector needs a loop.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import constants as K
from riskloom.functions import columns as C
from riskloom.operators.fold import ordered_fold
from riskloom.operators.prefix import HOT_ROWS, _resolve, counted_once, first_of_member, reflected_walk, running


# --- buckets and base rate --------------------------------------------------------------
def cusum_bucket_counts(df: DataFrame, flagged: Column, bucket_s: int = K.CUSUM_BUCKET_S, by: list[str] = ["merchant_id"]):
    """Attempts and flagged attempts per merchant and bucket; combined before the shuffle."""
    return df.groupBy(*by, C.bucket(F.col("ingest_ms"), bucket_s).alias("bucket")).agg(
        F.count(F.lit(1)).alias("attempts"), F.sum(flagged.cast("long")).alias("flagged")
    )


def count_in_bucket(df: DataFrame, flagged: Column, bucket_s: int = K.CUSUM_BUCKET_S, **kw) -> DataFrame:
    """Running attempts and flagged attempts inside the row's own bucket."""
    placed = df.withColumn("bucket", C.bucket(F.col("ingest_ms"), bucket_s))
    kw.setdefault("chunk_ms", max(1, bucket_s * 10))
    return running(
        placed, ["merchant_id", "bucket"],
        {"attempts_so_far": ("sum", F.lit(1).cast("long")), "flagged_so_far": ("sum", flagged.cast("long"))}, **kw,
    )


def _rate(profile: Column, hour: Column, flagged_rate: Column, bucket_s: int, lambda_min: float) -> Column:
    per_second = F.greatest(F.element_at(profile, hour + 1), F.lit(0.0)) / 3600.0
    return F.greatest(per_second * bucket_s * F.greatest(flagged_rate, F.lit(0.0)), F.lit(lambda_min))


def baseline_lambda0(baseline: DataFrame, bucket_s: int = K.CUSUM_BUCKET_S, lambda_min: float = K.CUSUM["lambda_min"]) -> DataFrame:
    """Expected flagged attempts per bucket for each hour of day, floored; array of 24 per merchant."""
    lam = F.transform(
        F.sequence(F.lit(0), F.lit(23)),
        lambda h: _rate(F.col("hourly_volume_profile"), h, F.col("flagged_rate_mean"), bucket_s, lambda_min),
    )
    return baseline.select("merchant_id", lam.alias("lam"))


def detection_delay_table(baseline: DataFrame, rho: float = K.CUSUM["rho"], h: float = K.CUSUM["h"], **kw) -> DataFrame:
    """Rates and buckets to alarm under a sustained attack, per merchant and hour of day."""
    rows = baseline_lambda0(baseline, **kw).select("merchant_id", F.posexplode("lam").alias("hour", "lam0"))
    lam1 = F.col("lam0") * rho
    drift = lam1 * F.ln(lam1 / F.col("lam0")) - (lam1 - F.col("lam0"))
    bad = lam1 <= F.col("lam0")
    return rows.select(
        "merchant_id", "hour", "lam0", lam1.alias("lam1"),
        F.when(~bad, F.lit(float(h)) / F.nullif(drift, F.lit(0.0))).alias("buckets_to_alarm"),
        F.when(bad, "lam1 must exceed lam0").alias("error"),
    )


# --- CUSUM ------------------------------------------------------------------------------
def time_domain_segments(df: DataFrame, bucket_s: int = K.CUSUM_BUCKET_S, horizon: int = K.CATCHUP_BUCKETS, **kw) -> DataFrame:
    """Numbers the stretches between backward clock jumps of more than ``horizon`` buckets, in arrival order.

    Arrival order is ``seq``; a jump is measured against the attempt that arrived just before.
    """
    kw.setdefault("chunk_ms", 1_000_000)
    placed = df.withColumns({"bucket": C.bucket(F.col("ingest_ms"), bucket_s), "_pos": F.col("seq")})
    kw = counted_once(placed, ["merchant_id"], kw)
    prior = running(
        placed, ["merchant_id"], {"_prev": ("max", F.struct("_pos", "bucket"), "before")}, ts="_pos", seq="_pos", **kw
    )
    jump = F.coalesce(F.col("bucket") - F.col("_prev.bucket") < -horizon, F.lit(False))
    marked = prior.select(*df.columns, "bucket", "_pos", jump.cast("long").alias("_jump"))
    return running(marked, ["merchant_id"], {"segment": ("sum", F.col("_jump"))}, ts="_pos", seq="_pos", **kw).drop("_pos", "_jump")


def _cumulative_rate(b: Column, per_hour: int) -> Column:
    """Sum of lambda0 over buckets ``[0, b)``, in closed form over the daily profile (``lam`` and ``lam_cum``)."""
    day, rest = F.floor(b / F.lit(24 * per_hour)), b % (24 * per_hour)
    hour = F.floor(rest / F.lit(per_hour)).cast("int")
    at = lambda arr, i: F.element_at(F.col(arr), i)
    return per_hour * (day * at("lam_cum", F.lit(25)) + at("lam_cum", hour + 1)) + (rest % per_hour) * at("lam", hour + 1)


def poisson_cusum_sparse(
    counts: DataFrame, lam: DataFrame, rho: float = K.CUSUM["rho"], h: float = K.CUSUM["h"],
    bucket_s: int = K.CUSUM_BUCKET_S, by: list[str] = ["merchant_id"],
) -> DataFrame:
    """CUSUM at the non-empty buckets; the decay over empty ones comes from the closed-form rate sum.

    Adds ``lam0``, ``s_before`` (after the gap, before the bucket), ``s``, ``alarm``, ``rate_ratio``. The
    input has at most one row per merchant and bucket, so a key's row count is bounded by time.
    """
    per_hour = 3600 // bucket_s
    cum = F.transform(
        F.sequence(F.lit(0), F.lit(24)), lambda i: F.aggregate(F.slice(F.col("lam"), F.lit(1), i), F.lit(0.0), lambda a, x: a + x)
    )
    rows = counts.join(lam.withColumn("lam_cum", cum), "merchant_id")
    order = Window.partitionBy(*by).orderBy("bucket")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lam0 = F.element_at(F.col("lam"), (F.floor((F.col("bucket") % (24 * per_hour)) / per_hour) + 1).cast("int"))
    prev = F.lag("bucket").over(order)
    gap = F.when(prev.isNull(), 0.0).otherwise(
        (rho - 1) * (_cumulative_rate(F.col("bucket"), per_hour) - _cumulative_rate(F.col("_prev") + 1, per_hour))
    )
    rows = rows.withColumns({"lam0": lam0, "_prev": prev})
    rows = rows.withColumns({"_gap": F.when(F.col("_prev") + 1 == F.col("bucket"), 0.0).otherwise(gap), "_inc": F.col("flagged") * math.log(rho) - (rho - 1) * F.col("lam0")})
    rows = rows.withColumns({"_i": F.sum("_inc").over(upto), "_d": F.sum("_gap").over(upto)})
    after = F.col("_i") - F.col("_d")
    before = after - F.col("_inc")
    rows = rows.withColumns({"_before": before, "_after": after})
    rows = rows.withColumns(
        {
            "_low_after": F.min(F.least("_before", "_after")).over(upto),
            "_low_prior": F.min(F.least("_before", "_after")).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    zero = F.lit(0.0)
    s_before = F.col("_before") - F.least(zero, F.col("_before"), F.coalesce("_low_prior", zero))
    s = F.col("_after") - F.least(zero, F.col("_low_after"))
    return rows.select(
        *counts.columns, "lam0", s_before.alias("s_before"), s.alias("s"), (s > h).alias("alarm"),
        (F.col("flagged") / F.col("lam0")).alias("rate_ratio"),
    )


def dense_buckets(counts: DataFrame, by: list[str] = ["merchant_id"]) -> DataFrame:
    """Inserts the empty buckets between the first and the last one of each key."""
    order = Window.partitionBy(*by).orderBy("bucket")
    until = F.coalesce(F.lead("bucket").over(order) - 1, F.col("bucket"))
    filled = counts.withColumn("_until", until).select(
        *counts.columns, F.explode(F.sequence("bucket", "_until")).alias("_b")
    )
    own = F.col("_b") == F.col("bucket")
    blanks = {c: F.when(own, F.col(c)).otherwise(0) for c in ("attempts", "flagged") if c in counts.columns}
    return filled.withColumns(blanks).withColumn("bucket", F.col("_b")).drop("_b")


def poisson_cusum(counts: DataFrame, lam: DataFrame, **kw) -> DataFrame:
    """CUSUM over every bucket, empty ones included."""
    return poisson_cusum_sparse(dense_buckets(counts, kw.get("by", ["merchant_id"])), lam, **kw)


def regime(counts: DataFrame, lam: DataFrame, h: float = K.CUSUM["h"], **kw) -> DataFrame:
    """Regime of each non-empty bucket: the committed alarm and rate ratio of the bucket just before it."""
    by = kw.get("by", ["merchant_id"])
    scored = poisson_cusum_sparse(counts, lam, h=h, **kw)
    order = Window.partitionBy(*by).orderBy("bucket")
    touching = F.lag("bucket").over(order) == F.col("bucket") - 1
    first = F.lag("bucket").over(order).isNull()
    return scored.withColumns(
        {
            "regime": F.when(~first & (F.col("s_before") > h), "alarm").otherwise("in_control"),
            "prior_rate_ratio": F.when(touching, F.lag("rate_ratio").over(order)).otherwise(0.0),
        }
    )


def cusum_live_peek(
    df: DataFrame, flagged: Column, lam: DataFrame, rho: float = K.CUSUM["rho"], h: float = K.CUSUM["h"],
    bucket_s: int = K.CUSUM_BUCKET_S, **kw,
) -> DataFrame:
    """Provisional statistic at each attempt: the committed value plus the flagged attempts of its bucket so far."""
    committed = poisson_cusum_sparse(cusum_bucket_counts(df, flagged, bucket_s), lam, rho=rho, h=h, bucket_s=bucket_s)
    rows = count_in_bucket(df, flagged, bucket_s, **kw).join(
        committed.select("merchant_id", "bucket", "lam0", "s_before"), ["merchant_id", "bucket"]
    )
    live = F.greatest(
        F.lit(0.0), F.col("s_before") + F.col("flagged_so_far") * math.log(rho) - (rho - 1) * F.col("lam0")
    )
    return rows.withColumns(
        {"s_live": live, "cusum_fired": live > h, "live_rate_ratio": F.col("flagged_so_far") / F.col("lam0")}
    )


def tune_cusum_h(counts: DataFrame, lam: DataFrame, bounds: tuple[float, float] = K.H_SEARCH, **kw) -> DataFrame:
    """Smallest h without an alarm on control traffic: the peak statistic, clamped to the search range."""
    peak = poisson_cusum_sparse(counts, lam, **kw).agg(F.max("s").alias("peak"))
    return peak.select("peak", F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), F.col("peak"))).alias("h"))


def observed_arl0(
    counts: DataFrame, lam: DataFrame, rho: float = K.CUSUM["rho"], h: float = K.CUSUM["h"], bucket_s: int = K.CUSUM_BUCKET_S
) -> DataFrame:
    """Mean run length in buckets to an alarm, restarting after each; the bucket count when there is none.

    The ordered pass reads one row per non-empty bucket, with the decay of the gap already summed.
    """
    rows = poisson_cusum_sparse(counts, lam, rho=rho, h=h, bucket_s=bucket_s)
    per_hour = 3600 // bucket_s
    order = Window.partitionBy("merchant_id").orderBy("bucket")
    cum = F.transform(
        F.sequence(F.lit(0), F.lit(24)), lambda i: F.aggregate(F.slice(F.col("lam"), F.lit(1), i), F.lit(0.0), lambda a, x: a + x)
    )
    rows = rows.join(lam.withColumn("lam_cum", cum), "merchant_id").withColumn("_prev", F.lag("bucket").over(order))
    rows = rows.select(
        "merchant_id", "bucket",
        F.coalesce(F.col("bucket") - F.col("_prev"), F.lit(1)).alias("steps"),
        F.coalesce((rho - 1) * (_cumulative_rate(F.col("bucket"), per_hour) - _cumulative_rate(F.col("_prev") + 1, per_hour)), F.lit(0.0)).alias("gap"),
        (F.col("flagged") * math.log(rho) - (rho - 1) * F.col("lam0")).alias("inc"),
    )
    schema = T.StructType(
        [rows.schema["merchant_id"], T.StructField("run_length", T.LongType()), T.StructField("seen", T.LongType())]
    )

    def step(key, part, state):
        s, length, made = state[0], state[1], []
        seen = 0
        for steps, gap, inc in zip(part["steps"], part["gap"], part["inc"]):
            s = max(0.0, max(0.0, s - gap) + inc)
            length += int(steps)
            seen += int(steps)
            if s > h:
                made.append(length)
                s, length = 0.0, 0
        frame = pd.DataFrame({"merchant_id": key[0], "run_length": [*made, None], "seen": [0] * len(made) + [seen]})
        return frame.astype({"run_length": "Int64"}), (s, length)

    runs = ordered_fold(rows, ["merchant_id"], ["bucket"], lambda: (0.0, 0), step, schema)
    return runs.groupBy("merchant_id").agg(
        F.count("run_length").alias("alarms"),
        F.coalesce(F.avg("run_length"), F.sum("seen").cast("double")).alias("arl0"),
    )


def closed_loop_regime(
    df: DataFrame, margin: str, lam: DataFrame, a: float, b: float, pi_train: float, tau: float,
    rho: float = K.CUSUM["rho"], h: float = K.CUSUM["h"], bucket_s: int = K.CUSUM_BUCKET_S,
    pi0: float = K.COST_MODEL["prior_steady_state"],
) -> DataFrame:
    """Per bucket: regime, prior and gated count when an alarm raises the prior that gates the next count.

    Under a prior, an attempt is flagged when its margin reaches a cutoff. Margins above the steady-state
    cutoff always count and margins below the cutoff of the largest prior never do; both are summed before
    the shuffle. Only the margins between travel, grouped by value, so the ordered pass is small.
    """
    def logit(p):
        q = min(max(p, K.PROBABILITY_EPS), 1 - K.PROBABILITY_EPS)
        return math.log(q / (1 - q))

    def cutoff(prior):
        """Margin at which the corrected posterior equals tau."""
        return (logit(tau) - logit(prior) + logit(pi_train) - b) / a

    always, never = cutoff(pi0), cutoff(0.95)
    value = F.col(margin)
    between = F.when((value < always) & (value >= never), value)
    counts = df.groupBy("merchant_id", C.bucket(F.col("ingest_ms"), bucket_s).alias("bucket"), between.alias("_m")).agg(
        F.sum((value >= always).cast("long")).alias("_sure"), F.count(F.lit(1)).alias("_n")
    )
    rows = counts.join(lam, "merchant_id").select(
        "merchant_id", "bucket", F.col("_m").alias("m"), F.col("_sure").alias("sure"), F.col("_n").alias("n"),
        F.col("lam"),
    )
    schema = T.StructType(
        [
            df.schema["merchant_id"],
            T.StructField("bucket", T.LongType()),
            T.StructField("regime", T.StringType()),
            T.StructField("prior", T.DoubleType()),
            T.StructField("flagged", T.LongType()),
            T.StructField("s", T.DoubleType()),
        ]
    )
    per_hour = 3600 // bucket_s
    log_rho = math.log(rho)

    def fold(batches):
        from riskloom.operators.fold import sorted_runs

        key, rates, s, held, made = None, None, 0.0, None, []

        def rate(bucket):
            return float(rates[(bucket // per_hour) % 24])

        def close(s, held):
            """Commits a bucket: its row, the new statistic and its rate ratio."""
            bucket, name, prior, n = held["bucket"], held["regime"], held["prior"], held["n"]
            lam0 = rate(bucket)
            s = max(0.0, s + n * log_rho - (rho - 1) * lam0)
            return [key, bucket, name, prior, n, s], s, n / lam0

        def decay(s, first, last):
            for bucket in range(first, last):
                if s <= 0.0:
                    break
                s = max(0.0, s - (rho - 1) * rate(bucket))
            return s

        for (merchant, bucket), part, opens in sorted_runs(batches, ["merchant_id", "bucket"]):
            bucket = int(bucket)
            if opens:
                ratio = 0.0
                if held is not None:
                    row, s, ratio = close(s, held)
                    made.append(row)
                if merchant != key:
                    key, rates, s, alarm = merchant, np.asarray(part["lam"].iloc[0]), 0.0, False
                else:
                    if bucket > held["bucket"] + 1:
                        s, ratio = decay(s, held["bucket"] + 1, bucket), 0.0
                    alarm = s > h
                odds = max(ratio, 0.0) * pi0 / (1 - pi0)
                prior = min(max(odds / (1 + odds), pi0), 0.95) if alarm else pi0
                held = {"bucket": bucket, "regime": "alarm" if alarm else "in_control", "prior": prior, "n": 0, "cut": cutoff(prior)}
            m = part["m"].to_numpy(dtype=float)
            held["n"] += int(part["sure"].sum()) + int(part["n"].to_numpy()[np.nan_to_num(m, nan=-np.inf) >= held["cut"]].sum())
            if len(made) >= 10_000:
                yield pd.DataFrame(made, columns=schema.names)
                made = []
        if held is not None:
            yield pd.DataFrame([*made, close(s, held)[0]], columns=schema.names)

    return rows.repartition("merchant_id").sortWithinPartitions("merchant_id", "bucket").mapInPandas(fold, schema)


# --- SPRT -------------------------------------------------------------------------------
def sprt_drift(
    df: DataFrame, keys: list[str], stat: str, q_hi: Column, params: dict = K.DRIFT, enabled: bool = True, **kw
) -> DataFrame:
    """Adds ``z``, ``drift_lambda`` and ``drift_fired`` per entity, in arrival order."""
    p0, p1 = 1.0 - params["exceedance_quantile"], params["p1"]
    z = ((q_hi > 0) & (F.col(stat) >= q_hi)).cast("int")
    step = F.when(F.col("z") == 1, math.log(p1 / p0)).otherwise(math.log((1 - p1) / (1 - p0)))
    walked = reflected_walk(df.withColumn("z", F.coalesce(z, F.lit(0))), keys, step, "drift_lambda", **kw)
    limit = math.log((1.0 - params["beta"]) / params["alpha"])
    return walked.withColumn("drift_fired", (F.col("drift_lambda") >= limit) & F.lit(enabled))


def detector_label(df: DataFrame) -> DataFrame:
    """Which detector fired and its signal value; needs the CUSUM and SPRT columns."""
    cusum, drift = F.col("cusum_fired"), F.coalesce("drift_fired", F.lit(False))
    return df.withColumns(
        {
            "detector": F.when(cusum & drift, "both").when(cusum, "cusum").when(drift, "drift").otherwise("none"),
            "fired": cusum | drift,
            "signal_value": F.when(cusum, F.col("live_rate_ratio")).otherwise(F.coalesce("drift_lambda", F.lit(0.0))),
        }
    )


def entity_history(df: DataFrame, keys: list[str], card: str = "card_hash", dealt: bool = False, **kw) -> DataFrame:
    """Attempts and distinct cards on the entity before this attempt, and when it was first seen.

    ``dealt``: a step over ``keys`` came just before, whose partitioning is reused."""
    kw = counted_once(df, keys, kw)
    found = _resolve(df, keys, kw["hot"], kw.get("hot_rows", HOT_ROWS))
    flagged = first_of_member(df, keys, card, "_is_new", found, dealt=dealt)
    return running(
        flagged, keys,
        {
            "attempts_before": ("sum", F.lit(1).cast("long"), "before"),
            "cards_before": ("sum", F.col("_is_new").cast("long"), "before"),
            "entity_first_seen": ("min", F.col("ingest_ms")),
        },
        **kw,
    ).drop("_is_new")
