"""Store baselines learned from negative-control traffic, and order profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.operators.ranked import exact_quantiles
from riskloom.operators.sweep import max_sliding_distinct_per_key

POOLED = "pooled"


def hourly_volume_profile(df: DataFrame, ts: str = "ingest_ms") -> DataFrame:
    """Mean attempts per hour of day and merchant as a 24-entry array; hours never observed take the mean."""
    hours = df.groupBy("merchant_id", F.expr(f"`{ts}` div {K.HOUR_MS}").alias("_hour")).agg(F.count(F.lit(1)).alias("_n"))
    rates = hours.groupBy("merchant_id", (F.col("_hour") % 24).cast("int").alias("_hod")).agg(
        (F.sum("_n") / F.count(F.lit(1))).alias("_rate")
    )
    packed = rates.groupBy("merchant_id").agg(
        F.map_from_entries(F.collect_list(F.struct("_hod", "_rate"))).alias("_map"), F.avg("_rate").alias("_mean")
    )
    profile = F.transform(
        F.sequence(F.lit(0), F.lit(23)), lambda h: F.round(F.coalesce(F.try_element_at(F.col("_map"), h), F.col("_mean")), 6)
    )
    return packed.select("merchant_id", profile.alias("hourly_volume_profile"))


def quantile_grid(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Eleven-point grid per group, rounded to 6 digits, as an array."""
    points = exact_quantiles(df, by, value, list(K.QUANTILE_GRID))
    return points.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda p: F.round(p["value"], 6)).alias(name)
    )


def amount_percentiles(df: DataFrame, by: list[str], value: str = "amount_minor") -> DataFrame:
    """p05, p50 and p95, truncated to whole minor units."""
    points = exact_quantiles(df, by, value, [0.05, 0.50, 0.95])
    names = ("amount_p05_minor", "amount_p50_minor", "amount_p95_minor")
    picks = [F.max(F.when(F.col("idx") == i, F.col("value"))).cast("long").alias(n) for i, n in enumerate(names)]
    return points.groupBy(*by).agg(*picks)


def flagged_rate(df: DataFrame, by: list[str], p: Column, tau: float) -> DataFrame:
    """Share of attempts whose calibrated score reaches ``tau``; pass a re-scored column to match serving."""
    return df.groupBy(*by).agg(
        F.round(F.avg(F.when(p >= tau, 1.0).otherwise(0.0)), 6).alias("flagged_rate_mean"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def learn_store_baseline(
    controls: DataFrame, p: Column, tau: float, mid_ms: int = K.WINDOW_5M_MS, long_ms: int = K.WINDOW_30M_MS
) -> DataFrame:
    """One baseline row per merchant and one pooled row, from negative-control attempts only."""
    columns = ["merchant_id", "ip", "card_hash", "ingest_ms", "seq", "amount_minor"]
    rows = controls.select(*columns, p.alias("_p"))
    rows = rows.unionByName(rows.withColumn("merchant_id", F.lit(POOLED)))
    by = ["merchant_id"]
    out = hourly_volume_profile(rows).join(flagged_rate(rows, by, F.col("_p"), tau), by)
    out = out.join(amount_percentiles(rows, by), by)
    for name, width in (("cards_per_ip_5m", mid_ms), ("cards_per_ip_30m", long_ms)):
        peaks = max_sliding_distinct_per_key(
            rows.select("merchant_id", "ip", "card_hash", "ingest_ms", "seq"), ["merchant_id", "ip"], "card_hash", width
        )
        out = out.join(quantile_grid(peaks, by, "peak", name), by)
    grids = F.map_from_arrays(F.array(F.lit("5m"), F.lit("30m")), F.array("cards_per_ip_5m", "cards_per_ip_30m"))
    return out.withColumns(
        {
            "cards_per_ip_quantiles": grids,
            **{n: F.lit(0.0) for n in ("decline_rate_mean", "decline_rate_std", "bin_entropy_mean", "bin_entropy_std",
                                       "foreign_bin_share_mean", "foreign_bin_share_std")},
            "is_stable": F.lit(False),
        }
    ).drop("cards_per_ip_5m", "cards_per_ip_30m")


# --- order profiles ---------------------------------------------------------------------
def distill_orders(lines: DataFrame, invoice: str, quantity: str, price: str, at: str) -> DataFrame:
    """Order totals from line items: no nulls, no cancellations (``C...``), positive totals, first timestamp."""
    kept = lines.dropna(subset=[invoice, quantity, price, at]).filter(~F.col(invoice).cast("string").startswith("C"))
    orders = kept.groupBy(F.col(invoice).alias("invoice")).agg(
        F.sum(F.col(quantity) * F.col(price)).alias("order_total"), F.min(at).alias("first_ts")
    )
    return orders.filter(F.col("order_total") > 0)


def hour_of_week_weights(df: DataFrame, at: str = "first_ts") -> DataFrame:
    """168 counts with Monday 00:00 as 0; empty hours are present with 0."""
    slot = (F.weekday(at) * 24 + F.hour(at)).cast("int")
    counts = df.groupBy(slot.alias("hour_of_week")).agg(F.count(F.lit(1)).alias("weight"))
    hours = df.sparkSession.range(168).select(F.col("id").cast("int").alias("hour_of_week"))
    return hours.join(counts, "hour_of_week", "left").select("hour_of_week", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))


def order_value_quantiles(
    orders: DataFrame, total: str = "order_total", points: int = 1001, store_aov_minor: int | None = None
) -> DataFrame:
    """Quantile table in integer minor units (half to even), with the mean, optionally scaled to a store's average."""
    probs = [i / (points - 1) for i in range(points)]
    table = exact_quantiles(orders, [], total, probs)
    mean = orders.agg(F.bround(F.round(F.avg(total) * 100, 6)).cast("long")).scalar()
    out = table.select("idx", F.bround(F.round(F.col("value") * 100, 6)).cast("long").alias("value_minor"), mean.alias("mean_minor"))
    if store_aov_minor is None:
        return out
    scaled = F.expr(f"(value_minor * {int(store_aov_minor)} + mean_minor div 2) div mean_minor")
    return out.withColumn("amount_minor", scaled)
