"""The per-attempt feature vector, the rules over it, and the live views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import columns as C
from riskloom.operators.counters import card_seen, event_id_reuse
from riskloom.operators.prefix import counted_once, hot_keys, running
from riskloom.operators.sweep import Concentration, Count, Distinct, add_window_stats

WIDTHS = {"short": K.WINDOW_60S_MS, "mid": K.WINDOW_5M_MS, "long": K.WINDOW_30M_MS, "card_ttl": K.CARD_TTL_MS}


def enrich_attempts(df: DataFrame) -> DataFrame:
    """Adds payload and idempotency digests, agent class, window keys and the 10 s bucket."""
    with_digest = df.withColumns({"payload_digest": C.payload_digest(), "ua_class": C.ua_class(F.col("user_agent"))})
    return with_digest.withColumns(
        {
            "idem_digest": C.idem_digest(F.col("payload_digest")),
            "ipua_key": C.ipua_key(F.col("ip"), F.col("ua_class")),
            "session_key": C.session_key(F.col("session_id"), F.col("ip")),
            "bucket": C.bucket(F.col("ingest_ms")),
        }
    )


#: What the feature vector reads and passes on.
INPUTS = (
    "attempt_uid", "merchant_id", "seq", "ingest_ms", "event_id", "ip", "ipua_key", "session_key", "bin", "card_hash", "amount_minor", "payload_digest",
)
#: The counts beside the features that rules and detectors read.
COUNTS = ("distinct_cards_per_ip_5m", "distinct_cards_per_ip_30m", "attempts_per_merchant_5m")
#: Key spaces in the order in which columns become free: what only one space reads goes first, the many statistics of ``ip`` come last.
ORDER = (("merchant_id", "ipua_key"), ("merchant_id", "session_key"), ("merchant_id",), ("merchant_id", "bin"), ("merchant_id", "ip"))


def window_spaces(widths: dict) -> dict[tuple[str, ...], list]:
    """The statistics of each key space; one shuffle per space."""
    short, mid, long_ = widths["short"], widths["mid"], widths["long"]
    return {
        ("merchant_id", "ip"): [
            Count("attempts_per_ip_60s", short),
            Count("attempts_per_ip_5m", mid),
            Distinct("distinct_cards_per_ip_5m", "card_hash", mid),
            Distinct("distinct_cards_per_ip_30m", "card_hash", long_),
            Distinct("distinct_bins_per_ip_5m", "bin", mid),
            Distinct("distinct_amounts_per_ip_5m", "amount_minor", mid),
            Concentration("bin_hhi_5m", "bin_entropy_5m", "bin", mid),
        ],
        ("merchant_id", "ipua_key"): [Count("attempts_per_ipua_5m", mid)],
        ("merchant_id", "bin"): [
            Distinct("distinct_ips_per_bin_5m", "ip", mid),
            Distinct("distinct_cards_per_bin_5m", "card_hash", mid),
        ],
        ("merchant_id", "session_key"): [Count("attempts_per_session", long_)],
        ("merchant_id",): [Count("attempts_per_merchant_5m", mid)],
    }


def feature_vector(df: DataFrame, widths: dict = WIDTHS, card_mode: str = "anchored", hot: dict | None = None) -> DataFrame:
    """The 24 features in contract order plus the raw counts the rules and detectors read.

    ``df`` holds accepted attempts with the columns of ``enrich_attempts``. Statistics are added space by
    space while the narrow row is shuffled to that space, so no feature is joined back, and columns that the caller leaves out
    travel no farther than they are read. ``hot`` may pass a result of ``hot_keys`` on ``df`` or on a table that contains it.
    """
    inputs = [*INPUTS]
    hot = hot_keys(df, [["merchant_id", "event_id"], ["merchant_id", "card_hash"]]) if hot is None else hot
    # The counters come first: they need the rows of a key in one place, while those are narrow.
    out = card_seen(df.select(*inputs), widths["card_ttl"], card_mode, hot=hot)
    out = event_id_reuse(out, hot=hot)
    spaces = window_spaces(widths)
    for keys in ORDER:
        out = add_window_stats(out, list(keys), spaces[keys])
    values = {name: F.lit(0.0) for name in K.UNFED_FEATURES}
    features = []
    for name in K.FEATURE_NAMES:
        value = values.get(name, F.col(name).cast("double") if name not in values else None)
        broken = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
        features.append(
            (value if name in values else F.when(broken, F.raise_error(F.lit(f"feature {name} is not finite"))).otherwise(value)).alias(name)
        )
    return out.select(*inputs, *features, *COUNTS)


def rule_statistics(df: DataFrame, widths: dict = WIDTHS) -> DataFrame:
    """Only the three rule statistics: two shuffles instead of the full vector."""
    out = add_window_stats(
        df,
        ["merchant_id", "ip"],
        [Count("attempts_per_ip_60s", widths["short"]), Distinct("distinct_cards_per_ip_5m", "card_hash", widths["mid"])],
    )
    return add_window_stats(
        out, ["merchant_id", "bin"], [Distinct("distinct_cards_per_bin_5m", "card_hash", widths["mid"])]
    )


def apply_rules(df: DataFrame, rules: tuple = K.RULES) -> DataFrame:
    """Adds ``rules_fired``, ``rule_tier`` (highest fired minimum, else allow), ``rule_score`` and ``families``."""
    fired = [F.when(F.col(name) >= threshold, F.lit(name)) for name, threshold, _, _ in rules]
    families = [F.when(F.col(name) >= threshold, F.lit(family)) for name, threshold, _, family in rules]
    rank = F.greatest(
        F.lit(0), *[F.when(F.col(n) >= t, K.TIERS.index(tier)).otherwise(0) for n, t, tier, _ in rules]
    )
    ratios = [F.col(n) / float(t) for n, t, _, _ in rules if t > 0]
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), *ratios))
    return df.withColumns(
        {
            "rules_fired": F.array_compact(F.array(*fired)),
            "families": F.array_distinct(F.array_compact(F.array(*families))),
            "rule_tier": C.tier_name(rank),
            "rule_score": score,
        }
    )


def capped_tier(tier: Column, ceiling: str = K.POLICY["auto_ceiling"]) -> Column:
    return C.tier_name(F.least(C.tier_rank(tier), F.lit(K.TIERS.index(ceiling))))


# --- threat level -----------------------------------------------------------------------
def severity(rules_fired: Column, decision: Column) -> Column:
    serious = [name for name, _, tier, _ in K.RULES if tier == "challenge"]
    mild = [name for name, _, tier, _ in K.RULES if tier == "throttle"]
    hit = lambda names: F.exists(rules_fired, lambda r: r.isin(*names))
    return (
        F.when(hit(serious) | decision.isin("challenge", "step_up", "block"), 2)
        .when(hit(mild) | (decision == "throttle"), 1)
        .otherwise(0)
    )


def threat_rollup(
    df: DataFrame, window_ms: int = K.WINDOW_5M_MS, dismiss_ms: int = 30_000, **kw
) -> DataFrame:
    """Store-wide threat level after each attempt; needs ``severity``.

    The peak over the window is 2 when the latest severity-2 row is younger than the window, so running
    maxima of time replace the deque. Below level 1 the level is resolved until the first row at least
    ``dismiss_ms`` after the first quiet row, then calm.
    """
    ts = F.col("ingest_ms")
    keys = ["merchant_id"]
    kw = counted_once(df, keys, kw)
    last = running(
        df,
        keys,
        {
            "_s2": ("max", F.when(F.col("severity") >= 2, ts)),
            "_s1": ("max", F.when(F.col("severity") >= 1, ts)),
        },
        **kw,
    )
    level = (
        F.when(F.col("_s2") > ts - window_ms, 2).when(F.col("_s1") > ts - window_ms, 1).otherwise(0)
    )
    leveled = last.withColumn("_level", level)
    # The latest loud row precedes a quiet run; the first quiet row after it opens the run.
    loud = running(leveled, keys, {"_loud": ("max", F.when(F.col("_level") > 0, F.struct("ingest_ms", "seq")))}, **kw)
    joined = running(loud, [*keys, "_loud"], {"_quiet": ("min", F.when(F.col("_level") == 0, ts))}, **kw)
    state = (
        F.when(F.col("_level") == 2, "under_attack")
        .when(F.col("_level") == 1, "elevated")
        .when(F.col("_loud").isNull(), "calm")
        .when(ts - F.col("_quiet") >= dismiss_ms, "calm")
        .otherwise("resolved")
    )
    return joined.select(*df.columns, state.alias("threat_state"))


# --- live views -------------------------------------------------------------------------
def recent_events(df: DataFrame, limit: int = K.RECENT_EVENTS, after=None, uid: str = "attempt_uid") -> DataFrame:
    """The newest ``limit`` events; with ``after`` those behind that event, or all when it has left the buffer."""
    buffer = df.orderBy(F.col("seq").desc()).limit(limit)
    if after is None:
        return buffer
    at = buffer.agg(F.max(F.when(F.col(uid) == F.lit(after), F.col("seq")))).scalar()
    return buffer.withColumn("_at", at).filter(F.col("_at").isNull() | (F.col("seq") > F.col("_at"))).drop("_at")


def live_tiles(df: DataFrame, enforced: DataFrame | None = None, k_max: int = K.POLICY["k_max"]) -> DataFrame:
    """Newest merchant count and peak cards per ip over the recent events of a merchant."""
    tiles = df.groupBy("merchant_id").agg(
        F.max_by("attempts_per_merchant_5m", "seq").alias("attempts_5m"),
        F.max("distinct_cards_per_ip_5m").alias("cards_per_ip_top"),
    )
    if enforced is None:
        return tiles
    return tiles.join(enforced, "merchant_id", "left").withColumns(
        {
            "active": F.coalesce(F.col("active"), F.lit(0).cast("long")),
            "at_cap": F.coalesce(F.col("active"), F.lit(0)) >= k_max,
        }
    )
