"""Calibration metrics under re-tilted prevalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import columns as C
from riskloom.functions.joins import join_groups


def class_weights(df: DataFrame, prior: float, by: list[str] = [], label: str = "label") -> DataFrame:
    """Weights per class that move a group to ``prior``; they sum to its size, and are 1 for a single class."""
    raw = df.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias("_raw"), F.count(F.lit(1)).alias("n"))
    single = F.col("_raw").isin(0.0, 1.0)
    pos = F.when(single, 1.0).otherwise(F.lit(prior) / F.nullif(F.col("_raw"), F.lit(0.0)))
    neg = F.when(single, 1.0).otherwise((1 - F.lit(prior)) / F.nullif(1 - F.col("_raw"), F.lit(0.0)))
    return raw.select(*by, "n", pos.alias("w_pos"), neg.alias("w_neg"))


def prevalence_weights(df: DataFrame, prior: float, by: list[str] = [], label: str = "label", name: str = "weight") -> DataFrame:
    keys = by or ["_all"]
    df_keyed = df if by else df.withColumn("_all", F.lit(0))
    joined = join_groups(df_keyed, class_weights(df_keyed, prior, keys, label), keys)
    return joined.select(*df.columns, F.when(F.col(label), F.col("w_pos")).otherwise(F.col("w_neg")).alias(name))


def effective_n(df: DataFrame, by: list[str] = [], weight: str = "weight") -> DataFrame:
    squares = F.sum(F.col(weight) * F.col(weight))
    return df.groupBy(*by).agg(
        F.coalesce(F.sum(weight) * F.sum(weight) / F.nullif(squares, F.lit(0.0)), F.lit(0.0)).alias("effective_n")
    )


def brier(df: DataFrame, by: list[str] = [], score: str = "score", label: str = "label", weight: Column | None = None) -> DataFrame:
    """(Weighted) mean squared error of a probability."""
    w = F.lit(1.0) if weight is None else weight
    miss = F.col(score) - F.col(label).cast("double")
    return df.groupBy(*by).agg((F.sum(w * miss * miss) / F.nullif(F.sum(w), F.lit(0.0))).alias("brier"))


def _bin(score: Column, n_bins: int) -> tuple[Column, Column]:
    clipped = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return F.least((clipped * n_bins).cast("int"), F.lit(n_bins - 1)), clipped


def bin_sums(df: DataFrame, n_bins: int, by: list[str] = [], score: str = "score", label: str = "label", weight: Column | None = None) -> DataFrame:
    """Weight, weighted prediction and weighted label sums per equal-width bin."""
    w = F.lit(1.0) if weight is None else weight
    slot, clipped = _bin(F.col(score), n_bins)
    return df.groupBy(*by, slot.alias("bin")).agg(
        F.sum(w).alias("weight"), F.sum(w * clipped).alias("_p"), F.sum(w * F.col(label).cast("double")).alias("_y")
    )


def reliability_bins(df: DataFrame, n_bins: int = 10, by: list[str] = [], **kw) -> DataFrame:
    """Every bin of every group; empty bins have weight 0 and null means."""
    sums = bin_sums(df, n_bins, by, **kw)
    slots = F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin")
    frame = sums.select(*by).distinct().select(*by, slots) if by else df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    filled = F.nullif(F.col("weight"), F.lit(0.0))
    return join_groups(frame, sums, [*by, "bin"], "left").select(
        *by, "bin", (F.col("bin") / F.lit(float(n_bins))).alias("lo"), ((F.col("bin") + 1) / F.lit(float(n_bins))).alias("hi"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"), (F.col("_p") / filled).alias("mean_predicted"), (F.col("_y") / filled).alias("observed_rate"),
    )


def ece(df: DataFrame, n_bins: int = 10, by: list[str] = [], **kw) -> DataFrame:
    """Expected calibration error: weighted mean gap between prediction and outcome over the bins."""
    sums = bin_sums(df, n_bins, by, **kw)
    return sums.groupBy(*by).agg((F.sum(F.abs(F.col("_p") - F.col("_y"))) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("ece"))


def calibration_block(
    df: DataFrame, a: float, b: float, pi_train: float, n_bins: int = 10, margin: str = "margin", label: str = "label",
    model: dict = K.COST_MODEL,
) -> DataFrame:
    """Brier and ECE of the raw, Platt and prior-corrected scores, re-tilted to both priors, in one pass."""
    raw = C.sigmoid(F.col(margin))
    platt = C.sigmoid(F.lit(float(a)) * F.col(margin) + F.lit(float(b)))
    rate = df.agg(F.avg(F.col(label).cast("double"))).scalar()
    cells = []
    for regime, prior in (("pi0", model["prior_steady_state"]), ("pi1", model["prior_under_attack"])):
        w = F.when(F.col("_raw").isin(0.0, 1.0), 1.0).otherwise(
            F.when(F.col(label), F.lit(prior) / F.nullif(F.col("_raw"), F.lit(0.0))).otherwise((1 - F.lit(prior)) / F.nullif(1 - F.col("_raw"), F.lit(0.0)))
        )
        for variant, score in (("raw", raw), ("platt", platt), ("platt_prior", C.prior_correct(platt, pi_train, prior))):
            cells.append(F.struct(F.lit(regime).alias("regime"), F.lit(variant).alias("variant"), score.alias("score"), w.alias("w")))
    long = df.withColumn("_raw", rate).select(F.col(label).alias("label"), F.explode(F.array(*cells)).alias("_c")).select("label", "_c.*")
    slot, clipped = _bin(F.col("score"), n_bins)
    y = F.col("label").cast("double")
    bins = long.groupBy("regime", "variant", slot.alias("bin")).agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"), F.sum(F.col("w") * clipped).alias("p"), F.sum(F.col("w") * y).alias("y"),
        F.sum(F.col("w") * (F.col("score") - y) * (F.col("score") - y)).alias("se"),
    )
    total = F.nullif(F.sum("w"), F.lit(0.0))
    return bins.groupBy("regime", "variant").agg(
        (F.sum("se") / total).alias("brier"), (F.sum(F.abs(F.col("p") - F.col("y"))) / total).alias("ece"),
        (F.sum("w") * F.sum("w") / F.nullif(F.sum("w2"), F.lit(0.0))).alias("effective_n"),
    )


def prior_correction_effect(block: DataFrame) -> DataFrame:
    """Gap between the ECE before and after prior correction per regime, and whether it helped."""
    pick = lambda v: F.max(F.when(F.col("variant") == v, F.col("ece")))
    out = block.groupBy("regime").agg((pick("platt") - pick("platt_prior")).alias("ece_gap"))
    return out.withColumn("helped", F.coalesce(F.col("ece_gap") > 0, F.lit(False)))
