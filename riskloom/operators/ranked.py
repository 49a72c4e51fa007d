"""Ordered scans over distinct values: cumulative sums in value order and exact quantiles.

Rows are first reduced to one row per distinct value. The value axis is cut at approximate quantiles, so
the cumulative pass is local to a stretch of values plus a short table of stretch totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import count_below
from riskloom.functions.joins import join_groups

AUTO = 0
#: Distinct values that one task scans.
STRETCH_VALUES = 2_000_000


def stretches(counts: DataFrame) -> int:
    """Stretches for a table of one row per distinct value; the values are counted."""
    return 1 + counts.count() // STRETCH_VALUES


def stretch_of(frame: DataFrame, at: str, cuts: Column, parts: int, name: str = "_part") -> DataFrame:
    """Adds the stretch of the value axis a row falls in; it depends on the value alone, so a retried task agrees."""
    return frame.withColumn("_cuts", cuts).withColumn(name, count_below(F.col("_cuts"), F.col(at), parts)).drop("_cuts")


def value_prefix(
    counts: DataFrame, by: list[str], value: str, sums: list[str], descending: bool = False, parts: int = AUTO
) -> DataFrame:
    """Adds ``before_<c>`` for each column of ``sums``: its total over strictly earlier values of the group.

    ``counts`` holds one row per group and value.
    """
    step = F.desc if descending else F.asc
    parts = parts or stretches(counts)
    if parts > 1:
        probs = [i / parts for i in range(1, parts)]
        cuts = counts.agg(F.percentile_approx(value, probs, 10_000)).scalar()
        base = stretch_of(counts, value, cuts, parts)
        base = base.withColumn("_part", -F.col("_part")) if descending else base
    else:
        base = counts.withColumn("_part", F.lit(0))
    inner = Window.partitionBy(*by, "_part").orderBy(step(value)).rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumns({f"_l_{c}": F.sum(c).over(inner) for c in sums})
    if parts <= 1:
        return local.select(*counts.columns, *[F.coalesce(F.col(f"_l_{c}"), F.lit(0)).alias(f"before_{c}") for c in sums])
    totals = base.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, "_part", *[F.sum(f"_t_{c}").over(earlier).alias(f"_o_{c}") for c in sums])
    joined = join_groups(local, carried, [*by, "_part"], "left")
    zero = F.lit(0)
    return joined.select(
        *counts.columns,
        *[(F.coalesce(F.col(f"_o_{c}"), zero) + F.coalesce(F.col(f"_l_{c}"), zero)).alias(f"before_{c}") for c in sums],
    )


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], parts: int = AUTO) -> DataFrame:
    """Linear-interpolated quantiles per group as rows ``(by, idx, q, value)``; memory does not grow with the data."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = value_prefix(counts, by, value, ["_n"], parts=parts)
    if by:
        placed = join_groups(placed, counts.groupBy(*by).agg(F.sum("_n").alias("_size")), by)
    else:
        placed = placed.withColumn("_size", counts.agg(F.sum("_n")).scalar())
    wanted = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(float(q)).alias("q")) for i, q in enumerate(probs)])
    spot = lambda q: q * (F.col("_size") - 1)
    first, last = F.col("before__n"), F.col("before__n") + F.col("_n") - 1
    touching = F.filter(
        wanted,
        lambda w: ((F.floor(spot(w["q"])) >= first) & (F.floor(spot(w["q"])) <= last))
        | ((F.ceil(spot(w["q"])) >= first) & (F.ceil(spot(w["q"])) <= last)),
    )
    steps = len(probs) - 1
    if steps > 16 and all(abs(q - i / steps) < 1e-12 for i, q in enumerate(probs)):
        # On an even grid a value can only serve the few points around its own rank.
        scale = F.lit(float(steps)) / F.greatest(F.col("_size") - 1, F.lit(1))
        near = F.sequence(
            F.greatest(F.floor(first * scale) - 1, F.lit(0)).cast("int"), F.least(F.ceil((last + 1) * scale) + 1, F.lit(steps)).cast("int")
        )
        wanted = F.transform(near, lambda i: F.struct(i.alias("idx"), (i / F.lit(float(steps))).alias("q")))
        touching = F.filter(
            wanted,
            lambda w: ((F.floor(spot(w["q"])) >= first) & (F.floor(spot(w["q"])) <= last))
            | ((F.ceil(spot(w["q"])) >= first) & (F.ceil(spot(w["q"])) <= last)),
        )
    hits = placed.select(*by, value, "_size", "before__n", "_n", F.explode(touching).alias("_w")).select(
        *by, value, "_size", first.alias("_a"), last.alias("_b"), F.col("_w.idx").alias("idx"), F.col("_w.q").alias("q")
    )
    low, high = F.floor(spot(F.col("q"))), F.ceil(spot(F.col("q")))
    inside = lambda p: (p >= F.col("_a")) & (p <= F.col("_b"))
    ends = hits.groupBy(*by, "idx", "q", "_size").agg(
        F.max(F.when(inside(low), F.col(value))).cast("double").alias("_lo"),
        F.max(F.when(inside(high), F.col(value))).cast("double").alias("_hi"),
    )
    frac = spot(F.col("q")) - F.floor(spot(F.col("q")))
    return ends.select(*by, "idx", "q", (F.col("_lo") + frac * (F.col("_hi") - F.col("_lo"))).alias("value"))
