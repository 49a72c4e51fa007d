"""Evaluation tables built from the ranking and calibration metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.joins import join_groups
from riskloom.operators import ranking as R
from riskloom.operators.ranked import exact_quantiles
from riskloom.session import materialize


def score_long(df: DataFrame, scorers: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row per sample and scorer: ``keep`` columns, ``scorer``, ``score``."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("scorer"), c.cast("double").alias("score")) for n, c in scorers.items()]))
    return df.select(*keep, cells.alias("_s")).select(*keep, "_s.scorer", "_s.score")


def metric_table(long: DataFrame, by: list[str], target_fpr: float = K.COST_MODEL["target_fpr"], prevalence: float = K.COST_MODEL["eval_prevalence"]) -> DataFrame:
    """Size, prevalence, recall at the target rate, average precision and AUC of every group.

    The scores are written once and every metric reads that table: score once, slice later.
    """
    return _metrics(materialize(long, "scores"), by, target_fpr, prevalence)


def _metrics(long: DataFrame, by: list[str], target_fpr: float, prevalence: float) -> DataFrame:
    size = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("n_positive"), F.avg(F.col("label").cast("double")).alias("prevalence")
    )
    recall = R.recall_at_fpr(long, target_fpr, by).select(*by, F.col("value").alias("recall"), "resolvable")
    auc = R.roc_auc(long, by).select(*by, "auc")
    for part in (recall, R.average_precision(long, by, prevalence=prevalence), auc):
        size = join_groups(size, part, by)
    return size


def evaluate_all(long: DataFrame, tier: str = "challenge", model: dict = K.COST_MODEL) -> DataFrame:
    """Metrics and cheapest operating costs per split and scorer."""
    by = ["split", "scorer"]
    long = materialize(long, "scores")
    curve = R.cost_curve(R.roc_convex_hull(long, by), {"pi0": model["prior_steady_state"], "pi1": model["prior_under_attack"]}, tier, model)
    best = R.min_cost_point(curve, [*by, "regime"])
    pick = lambda r: F.max(F.when(F.col("regime") == r, F.col("cost"))).alias(f"min_cost_{r}")
    return join_groups(_metrics(long, by, model["target_fpr"], model["eval_prevalence"]), best.groupBy(*by).agg(pick("pi0"), pick("pi1")), by)


def tier_breakdown(long: DataFrame, by: list[str] = ["scorer"], **kw) -> DataFrame:
    """Metrics per stream tier, plus the view without contaminated legitimate samples as tier ``clean``."""
    clean = F.col("label") | ~F.col("entity_overlap")
    views = F.array_compact(F.array(F.when(F.col("stream_tier").isin(*K.STREAM_TIERS), F.col("stream_tier")), F.when(clean, F.lit("clean"))))
    rows = long.withColumn("tier", F.explode(views))
    return metric_table(rows, [*by, "tier"], **kw)


def univariate_audit(
    df: DataFrame, features: list[str], label: str = "label", threshold: float = 0.95, excluded=K.EXCLUDED_FEATURES
) -> DataFrame:
    """AUC of each feature alone, whether it is constant, over the threshold, and newly so; one job for all."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("score")) for n in features]))
    long = df.select(F.col(label).alias("label"), cells.alias("_f")).select("label", "_f.feature", "_f.score")
    auc = R.roc_auc(long, ["feature"])
    constant = F.col("n_values") <= 1
    over = F.coalesce((F.col("auc") > threshold) & ~constant, F.lit(False))
    known = F.col("feature").isin(*excluded) if excluded else F.lit(False)
    return auc.select(
        "feature", "auc", constant.alias("constant"), known.alias("excluded"), over.alias("flagged"), (over & ~known).alias("newly_flagged")
    )


def two_sided_separability(audit: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Distance of the AUC from one half, its direction, and a flag that includes the boundary."""
    gap = F.abs(F.col("auc") - 0.5)
    hit = ~F.col("constant") & (gap >= threshold - 0.5)
    return audit.withColumns(
        {
            "separability": gap,
            "direction": F.when(F.col("auc").isNull() | F.col("constant"), None).when(F.col("auc") < 0.5, "inverted").otherwise("positive"),
            "flagged_two_sided": F.coalesce(hit, F.lit(False)),
        }
    )


def negative_control_fp(samples: DataFrame, theta: float, score: str = "score") -> DataFrame:
    """False positives of legitimate control traffic per scenario, by attempt and by episode."""
    legit = samples.filter((F.col("kind") == "negative_control") & ~F.col("is_attack"))
    hit = F.col(score) >= theta
    episodes = legit.groupBy("scenario", F.coalesce("episode_id", F.col("event_id")).alias("_episode")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(hit.cast("long")).alias("_hits")
    )
    out = episodes.groupBy("scenario").agg(
        F.sum((F.col("_hits") > 0).cast("long")).alias("episode_fp"), F.count(F.lit(1)).alias("episodes"),
        F.sum("_hits").alias("attempt_fp"), F.sum("_n").alias("attempts"),
    )
    return out.withColumns({"rate": F.col("attempt_fp") / F.col("attempts"), "underpowered": F.col("attempts") < 30})


def baseline_summary(scored: DataFrame, scorers: dict[str, float], label: str = "is_attack") -> DataFrame:
    """Operating points of every scorer overall and per stream tier.

    ``scored`` holds scores computed once over the whole timeline; ``scorers`` maps a score column to its
    threshold. Tiers are slices of those scores, so their counts add up to the overall row.
    """
    cells = F.explode(F.array(*[
        F.struct(F.lit(n).alias("scorer"), F.col(n).cast("double").alias("score"), F.lit(float(t)).alias("theta")) for n, t in scorers.items()
    ]))
    views = F.array_compact(F.array(F.lit("overall"), F.when(F.col("stream_tier").isin(*K.STREAM_TIERS), F.col("stream_tier"))))
    rows = scored.select(F.col(label).alias("label"), F.explode(views).alias("tier"), *scorers).select("label", "tier", cells.alias("_s"))
    rows = rows.select("label", "tier", "_s.scorer", "_s.score", "_s.theta")
    return R.operating_point(rows, F.col("theta"), ["scorer", "tier"])


def seed_summary(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Minimum, median and maximum over the runs that have a value."""
    kept = values.filter(F.col(value).isNotNull())
    return kept.groupBy(*by).agg(
        F.min(value).alias("low"), F.percentile(value, 0.5).alias("median"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n_seeds")
    )


def model_vs_rules_winner(metrics: DataFrame, model: str = "model", rules: str = "b0") -> DataFrame:
    """Scorer with the higher average precision per tier; null when one of them has none."""
    pick = lambda s: F.max(F.when(F.col("scorer") == s, F.col("ap")))
    out = metrics.groupBy("tier").agg(pick(model).alias("model_ap"), pick(rules).alias("rules_ap"))
    gap = F.col("model_ap") - F.col("rules_ap")
    return out.withColumn("winner", F.when(gap > 0, "model").when(gap < 0, "b0").when(gap == 0, "tie"))


def detection_headline(incidents: DataFrame, by: list[str] = ["tier"]) -> DataFrame:
    """Median and 90th percentile of what an attack got done before its alert."""
    names = {"attempts_before_alert": "attempts", "cards_exposed_before_alert": "cards", "time_to_detect_s": "seconds"}
    out = incidents.groupBy(*by).agg(F.count(F.lit(1)).alias("incidents"))
    for column, name in names.items():
        points = exact_quantiles(incidents.select(*by, column), by, column, [0.5, 0.9])
        pick = lambda i: F.max(F.when(F.col("idx") == i, F.col("value")))
        out = join_groups(out, points.groupBy(*by).agg(pick(0).alias(f"{name}_median"), pick(1).alias(f"{name}_p90")), by, "left")
    return out


def attack_yield(rows: DataFrame) -> DataFrame:
    """What each labelled attack episode achieved: attempts, mean score, cards per hour, and cards before its alert.

    ``rows`` are attack attempts with ``incident_id``, ``opens`` and ``cards_before``.
    """
    out = rows.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("attempts_total"), F.avg("score").alias("mean_score"),
        F.countDistinct("card_hash").alias("cards"),
        F.bool_or(F.col("incident_id").isNotNull()).alias("incident_opened"),
        F.min_by("cards_before", F.when(F.col("opens"), F.struct("ingest_ms", "seq"))).alias("cards_exposed_before_alert"),
    )
    return out


def metric_availability(metrics: DataFrame) -> DataFrame:
    """Whether a metric row carries a usable value, and why not.

    Needs ``kind`` (``number``, ``recall`` or ``envelope``), ``value``, ``resolvable``, ``available``, ``given_reason``.
    """
    value = F.col("value")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    reason = (
        F.when(F.col("kind") == "recall", F.when(~F.col("resolvable"), "unresolvable").when(value.isNull(), "unreachable"))
        .when(F.col("kind") == "envelope", F.when(~F.col("available"), F.coalesce(F.nullif("given_reason", F.lit("")), F.lit("unavailable"))))
        .when(F.col("kind") == "number", F.when(value.isNull(), "unspecified").when(~finite, "non-finite"))
        .otherwise("unrecognised-shape")
    )
    out = metrics.withColumn("reason", reason)
    return out.withColumns({"is_available": F.col("reason").isNull(), "shown": F.when(F.col("reason").isNull(), value)})


def decision_histogram(scores: DataFrame) -> DataFrame:
    return scores.groupBy("decision", "regime", "control_arm").agg(F.count(F.lit(1)).alias("n"))
