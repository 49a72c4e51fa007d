"""Labelled samples, contamination flags and leakage-safe splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.operators.prefix import hot_keys, running


class SingleClassSplit(ValueError):
    """A split that must hold both classes holds one."""


def _spread(episode: Column, seq: Column) -> Column:
    """Join key for an optional episode: rows without one get many different keys instead of one null."""
    return F.coalesce(episode, F.concat(F.lit("\0"), F.pmod(F.xxhash64(seq), F.lit(4096)).cast("string")))


def build_samples(
    events: DataFrame, labels: DataFrame, episodes: DataFrame, latency_ms: int = K.GATEWAY_LATENCY_MS
) -> DataFrame:
    """Events with their label and episode; no episode means baseline traffic.

    ``events`` carry ``run_index`` and ``stream_tier``; event ids repeat across runs, so the label key is both.
    """
    truth = episodes.select(F.col("episode_id").alias("_key"), "kind", "scenario", F.col("tier").alias("episode_tier"))
    return (
        events.join(labels, ["run_index", "event_id"])
        .withColumn("_key", _spread(F.col("episode_id"), F.col("seq")))
        .join(truth, "_key", "left")
        .drop("_key")
        .withColumns(
            {
                "kind": F.coalesce("kind", F.lit("baseline")),
                "outcome_visible_ms": F.col("ingest_ms") + latency_ms,
                "entity_overlap": F.lit(False),
            }
        )
    )


def entity_overlap(samples: DataFrame, horizon_ms: int = K.FEATURE_HORIZON_MS, **kw) -> DataFrame:
    """Flags legitimate samples that share an ip or a card with an attack episode inside its extended window.

    The episode windows of a key become open and close events on the key's time line, so a sample is
    covered when more windows have opened than closed. No pair of sample and episode is formed.
    """
    attacks = samples.filter(F.col("is_attack") & F.col("episode_id").isNotNull())
    windows = attacks.groupBy("episode_id").agg(F.min("ingest_ms").alias("_lo"), (F.max("ingest_ms") + horizon_ms).alias("_hi"))
    if not isinstance(kw.get("hot"), dict):
        kw = {**kw, "hot": hot_keys(samples, [["ip"], ["card_hash"]], **({"hot_rows": kw["hot_rows"]} if "hot_rows" in kw else {}))}
    out = samples.withColumn("_overlap", F.lit(False))
    early = F.lit(-1).cast("long")
    for key in ("ip", "card_hash"):
        spans = attacks.select("episode_id", key).distinct().join(windows, "episode_id")
        edges = F.array(
            F.struct(F.col("_lo").alias("ingest_ms"), F.lit(1).alias("_d")), F.struct((F.col("_hi") + 1).alias("ingest_ms"), F.lit(-1).alias("_d"))
        )
        marks = spans.select(key, F.explode(edges).alias("_e")).select(key, "_e.ingest_ms", early.alias("seq"), "_e._d", F.lit(None).alias("_row"))
        probes = out.select(key, "ingest_ms", "seq", F.lit(0).alias("_d"), F.struct(*out.columns).alias("_row"))
        covered = running(probes.unionByName(marks), [key], {"_n": ("sum", F.col("_d"))}, **kw).filter(F.col("_row").isNotNull())
        out = covered.select("_row.*", F.col("_n").alias("_covered")).withColumn("_overlap", F.col("_overlap") | (F.col("_covered") > 0)).drop("_covered")
    return out.withColumn("entity_overlap", F.col("_overlap") & ~F.col("is_attack")).drop("_overlap")


def temporal_split(
    samples: DataFrame, train_fraction: float, embargo_ms: int = K.FEATURE_HORIZON_MS, names: tuple[str, str] = ("train", "test")
) -> DataFrame:
    """Cuts at a fraction of the time range, embargoes the band behind the cut and purges straddling episodes.

    Rows keep a ``split`` name; embargoed and purged rows are gone. The two ends of the time range are worked out once,
    here, and the cut is a constant of the plan.
    """
    low, high = samples.agg(F.min("ingest_ms"), F.max("ingest_ms")).first()
    cut = None if low is None else low + int((high - low) * float(train_fraction))
    early = F.col("ingest_ms") <= F.lit(cut).cast("long")
    late = F.col("ingest_ms") > F.lit(cut).cast("long") + embargo_ms
    sides = samples.filter(F.col("episode_id").isNotNull()).groupBy("episode_id").agg(
        F.bool_or(early).alias("_early"), F.bool_or(~early).alias("_late"), F.bool_or(~early & ~late).alias("_band")
    )
    straddling = sides.filter(F.col("_band") | (F.col("_early") & F.col("_late"))).select(F.col("episode_id").alias("_key"))
    keyed = samples.filter(early | late).withColumn("_key", _spread(F.col("episode_id"), F.col("ingest_ms")))
    kept = keyed.join(straddling, "_key", "left_anti")
    return kept.select(*samples.columns, F.when(early, names[0]).otherwise(names[1]).alias("split"))


def three_way_temporal_slice(samples: DataFrame, embargo_ms: int = K.FEATURE_HORIZON_MS) -> DataFrame:
    """fit 70 %, then the rest halved into earlystop and calib, each cut embargoed and purged."""
    first = temporal_split(samples, 0.70, embargo_ms, ("fit", "rest"))
    rest = first.filter(F.col("split") == "rest").drop("split")
    return first.filter(F.col("split") == "fit").unionByName(temporal_split(rest, 0.50, embargo_ms, ("earlystop", "calib")))


def require_two_classes(split: DataFrame, by: str = "split") -> DataFrame:
    """Raises when a split has one class only; returns the input."""
    bad = split.groupBy(by).agg(F.avg(F.col("is_attack").cast("double")).alias("p")).filter(F.col("p").isin(0.0, 1.0)).collect()
    if bad:
        raise SingleClassSplit(f"single-class split: {[r[by] for r in bad]}")
    return split


def attack_shape_holdout(samples: DataFrame) -> DataFrame:
    """Train on easy and medium streams, test on hard ones."""
    tier = F.col("stream_tier")
    name = F.when(tier.isin("easy", "medium"), "train").when(tier == "hard", "test")
    return samples.withColumn("split", name).filter(F.col("split").isNotNull())


def exclude_negative_controls(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("kind") != "negative_control")


def negative_control_splits(samples: DataFrame) -> DataFrame:
    """One evaluation split per control scenario."""
    kept = samples.filter((F.col("kind") == "negative_control") & F.col("scenario").isin(*K.SCENARIOS))
    return kept.withColumn("split", F.concat(F.lit("negative_control:"), "scenario"))


def tier_e_split(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("stream_tier") == "evasive").withColumn("split", F.lit("tier_e"))


def clean_view(samples: DataFrame) -> DataFrame:
    """Attacks plus the legitimate samples without entity overlap."""
    return samples.filter(F.col("is_attack") | ~F.col("entity_overlap"))


def false_linkage_rate(df: DataFrame, key: str) -> DataFrame:
    """Probability that two rows drawn without replacement share the key."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("c"))
    n = F.sum("c")
    pairs = F.sum(F.col("c") * (F.col("c") - 1))
    return sizes.agg(F.when(n >= 2, pairs / (n * (n - 1))).otherwise(0.0).alias("false_linkage_rate"))


# --- baseline scorers -------------------------------------------------------------------
def b1_decline_velocity(
    samples: DataFrame, threshold: int = K.B1["threshold"], window_ms: int = K.B1["window_ms"], keys: list[str] = ["ip"], **kw
) -> DataFrame:
    """Adds ``b1``: 1.0 when enough declines of the ip had become visible strictly before the attempt.

    A decline counts from the millisecond after it lands until a window later.
    """
    def event(at, order, change, row):
        return F.struct(at.alias("ingest_ms"), order.alias("seq"), F.lit(change).alias("d"), row.alias("row"))

    declined, none, early = F.col("gateway_status") == "declined", F.lit(None), F.lit(-1).cast("long")
    landed = F.col("outcome_visible_ms")
    made = F.array_compact(
        F.array(
            event(F.col("ingest_ms"), F.col("seq"), 0, F.struct(*samples.columns)),
            F.when(declined, event(landed + 1, early, 1, none)),
            F.when(declined, event(landed + window_ms, early, -1, none)),
        )
    )
    events = samples.select(*keys, F.explode(made).alias("_e")).select(*keys, "_e.*")
    counted = running(events, keys, {"_n": ("sum", F.col("d"))}, **kw).filter(F.col("row").isNotNull())
    return counted.select("row.*", F.col("_n").cast("long").alias("visible_declines")).withColumn(
        "b1", F.when(F.col("visible_declines") >= threshold, 1.0).otherwise(0.0)
    )


def b2_bin_concentration(samples: DataFrame, threshold: int = K.B2_THRESHOLD, window_ms: int = K.WINDOW_5M_MS, keys: list[str] = ["bin"]):
    """Adds ``b2``: 1.0 when distinct cards of the bin in the window reach the threshold."""
    from riskloom.operators.sweep import sliding_distinct

    counted = sliding_distinct(samples, keys, "card_hash", window_ms, "_n")
    return counted.withColumn("b2", F.when(F.col("_n") >= threshold, 1.0).otherwise(0.0)).drop("_n")


def b0_rules_scorer(samples: DataFrame, scored: DataFrame, score: str = "rule_score") -> DataFrame:
    """Joins the logged rule score; a sample without one is an error, never a 0."""
    logged = scored.select("run_index", "event_id", F.col(score).alias("_logged"))
    joined = samples.join(logged, ["run_index", "event_id"], "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no logged score for"), "run_index", "event_id"))
    return joined.withColumn("b0", F.when(F.col("_logged").isNull(), missing).otherwise(F.col("_logged"))).drop("_logged")


def sanity_scorers(is_attack: Column, identity: list[Column], seed: int = 42) -> dict[str, Column]:
    """Perfect, inverted, constant and seeded random scores; the random one hashes the row's identity."""
    named = F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in identity))
    bits = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return {
        "perfect": is_attack.cast("double"),
        "inverted": 1.0 - is_attack.cast("double"),
        "always_positive": F.lit(1.0),
        "random": bits / F.lit(float(2**32 - 1)),
    }
