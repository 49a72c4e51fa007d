"""Ranking and cost metrics per group, computed from one row per distinct score.

All functions take ``by`` (group columns, may be empty), a ``score`` and a boolean ``label``. Undefined
metrics are null, never 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import constants as K
from riskloom.functions import columns as C
from riskloom.functions.joins import join_groups
from riskloom.operators.fold import sorted_runs
from riskloom.operators.prefix import running
from riskloom.operators.ranked import AUTO, value_prefix

INF = float("inf")


def _grouped(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """A constant group column stands in for an empty ``by``."""
    return (df, by) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def score_counts(df: DataFrame, by: list[str], score: str = "score", label: str = "label", parts: int = AUTO) -> DataFrame:
    """Positives and negatives per distinct score with the totals above it and of the group."""
    counts = df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum((~F.col(label)).cast("long")).alias("neg")
    )
    placed = value_prefix(counts, by, "score", ["pos", "neg"], descending=True, parts=parts)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return join_groups(placed, totals, by).withColumns({"tp": F.col("before_pos") + F.col("pos"), "fp": F.col("before_neg") + F.col("neg")})


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / F.nullif(whole.cast("double"), F.lit(0.0))).otherwise(0.0)


def roc_points(df: DataFrame, by: list[str] = [], **kw) -> DataFrame:
    """One point per distinct score, highest first, with both trivial end points."""
    df, keys = _grouped(df, by)
    counts = score_counts(df, keys, **kw)
    inner = counts.select(*keys, "tp", "fp", "n_pos", "n_neg", F.col("score").alias("threshold"))
    ends = counts.groupBy(*keys, "n_pos", "n_neg").agg(F.max("tp").alias("_tp"), F.max("fp").alias("_fp"))
    start = ends.select(*keys, F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "n_pos", "n_neg", F.lit(INF).alias("threshold"))
    stop = ends.select(*keys, F.col("_tp").alias("tp"), F.col("_fp").alias("fp"), "n_pos", "n_neg", F.lit(-INF).alias("threshold"))
    points = inner.unionByName(start).unionByName(stop)
    return points.select(
        *by, _share(F.col("fp"), F.col("n_neg")).alias("fpr"), _share(F.col("tp"), F.col("n_pos")).alias("tpr"),
        "threshold", "tp", "fp", "n_pos", "n_neg",
    )


def _degenerate() -> Column:
    return (F.col("n_pos") == 0) | (F.col("n_neg") == 0)


def recall_at_fpr(df: DataFrame, target: float | Column, by: list[str] = [], **kw) -> DataFrame:
    """Best recall within the target false-positive rate, whether the sample resolves that rate, and its interval.

    ``value`` is null for a constant score. The interval is the Wilson interval of the achieved rate.
    """
    df, keys = _grouped(df, by)
    counts = score_counts(df, keys, **kw)
    goal = target if isinstance(target, Column) else F.lit(float(target))
    within = _share(F.col("fp"), F.col("n_neg")) <= goal
    best = counts.groupBy(*keys, "n_pos", "n_neg").agg(
        F.count(F.lit(1)).alias("_levels"),
        F.coalesce(F.max(F.when(within, F.col("tp"))), F.lit(0)).alias("_tp"),
        F.coalesce(F.max(F.when(within, F.col("fp"))), F.lit(0)).alias("_fp"),
        F.max(goal).alias("_goal"),
    )
    low, high = C.wilson(F.col("_fp"), F.col("n_neg"))
    known = ~_degenerate() & (F.col("_levels") > 1)
    needed = F.when(F.col("_goal") > 0, 1.0 / F.nullif(F.col("_goal"), F.lit(0.0))).otherwise(INF)
    return best.select(
        *by,
        F.when(known, _share(F.col("_tp"), F.col("n_pos"))).alias("value"), "n_neg",
        F.when(~_degenerate(), F.col("n_neg") >= needed).alias("resolvable"),
        F.when(known, low).alias("ci_low"), F.when(known, high).alias("ci_high"),
    )


def average_precision(
    df: DataFrame, by: list[str] = [], ordinal: str = "ordinal", prevalence: float = K.COST_MODEL["eval_prevalence"],
    score: str = "score", label: str = "label", parts: int = AUTO, **kw,
) -> DataFrame:
    """Rank-based average precision, raw and re-tilted to ``prevalence``; ties keep their input ``ordinal``."""
    df, keys = _grouped(df, by)
    above = score_counts(df, keys, score, label, parts).select(*keys, "score", "before_pos", "before_neg", "n_pos", "n_neg")
    rows = df.select(*keys, F.col(score).alias("score"), F.col(label).cast("long").alias("_y"), F.col(ordinal).cast("long").alias("_o"))
    kw.setdefault("chunk_ms", 1_000_000)
    inside = running(rows, [*keys, "score"], {"_tp": ("sum", F.col("_y")), "_n": ("sum", F.lit(1))}, ts="_o", seq="_o", **kw)
    hits = inside.filter(F.col("_y") == 1)
    hits = join_groups(hits, above, [*keys, "score"])
    tp = F.col("before_pos") + F.col("_tp")
    fp = F.col("before_neg") + F.col("_n") - F.col("_tp")
    tpr, fpr = tp / F.col("n_pos"), _share(fp, F.col("n_neg"))
    down = prevalence * tpr + (1 - prevalence) * fpr
    tilted = F.when(down > 0, prevalence * tpr / F.nullif(down, F.lit(0.0))).otherwise(1.0)
    sums = hits.groupBy(*keys).agg(F.sum(tp / (tp + fp)).alias("_ap"), F.sum(tilted).alias("_at"))
    totals = df.groupBy(*keys).agg(F.sum(F.col(label).cast("long")).alias("n_pos"), F.sum((~F.col(label)).cast("long")).alias("n_neg"))
    ok = ~_degenerate()
    return join_groups(totals, sums, keys, "left").select(
        *by, F.when(ok, F.col("_ap") / F.nullif(F.col("n_pos"), F.lit(0))).alias("ap"), F.when(ok, F.col("_at") / F.nullif(F.col("n_pos"), F.lit(0))).alias("ap_at_prevalence")
    )


def roc_auc(df: DataFrame, by: list[str] = [], **kw) -> DataFrame:
    """P(positive outranks negative), ties one half."""
    df, keys = _grouped(df, by)
    counts = score_counts(df, keys, **kw)
    below = F.col("n_neg") - F.col("before_neg") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    out = counts.groupBy(*keys, "n_pos", "n_neg").agg(wins.alias("_u"), F.count(F.lit(1)).alias("n_values"))
    pairs = F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))
    return out.select(*by, (F.col("_u") / pairs).alias("auc"), "n_values", "n_pos", "n_neg")


def operating_point(df: DataFrame, theta: float | Column, by: list[str] = [], score: str = "score", label: str = "label") -> DataFrame:
    """Confusion counts and rates at a threshold."""
    goal = theta if isinstance(theta, Column) else F.lit(float(theta))
    hit, y = F.col(score) >= goal, F.col(label)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = df.groupBy(*by).agg(count(hit & y).alias("tp"), count(hit & ~y).alias("fp"), count(~hit & ~y).alias("tn"), count(~hit & y).alias("fn"))
    return out.withColumns(
        {
            "fpr": _share(F.col("fp"), F.col("fp") + F.col("tn")),
            "tpr": _share(F.col("tp"), F.col("tp") + F.col("fn")),
            "precision": F.col("tp") / F.nullif((F.col("tp") + F.col("fp")).cast("double"), F.lit(0.0)),
        }
    )


def recall_at_matched_fpr(df: DataFrame, rule: str, theta: float = 0.5, score: str = "score", label: str = "label", **kw) -> DataFrame:
    """Recall of ``score`` at the false-positive rate the discrete ``rule`` column reaches."""
    goal = operating_point(df, theta, [], rule, label).select("fpr").scalar()
    placed = df.withColumn("_goal", goal)
    counts = score_counts(placed.withColumn("_all", F.lit(0)), ["_all"], score, label, **kw).withColumn("_goal", goal)
    best = counts.groupBy("n_pos", "n_neg", "_goal").agg(
        F.count(F.lit(1)).alias("_levels"),
        F.coalesce(F.max(F.when(_share(F.col("fp"), F.col("n_neg")) <= F.col("_goal"), F.col("tp"))), F.lit(0)).alias("_tp"),
    )
    known = ~_degenerate() & (F.col("_levels") > 1)
    return best.select(F.col("_goal").alias("rule_fpr"), F.when(known, _share(F.col("_tp"), F.col("n_pos"))).alias("recall"))


# --- convex hull and cost ---------------------------------------------------------------
def _upper_hull(points: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Upper envelope of points sorted by (x, y), in exact integers."""
    hull: list[tuple[int, int]] = []
    for x, y in points:
        while len(hull) >= 2:
            (ax, ay), (bx, by) = hull[-2], hull[-1]
            if (bx - ax) * (y - ay) - (by - ay) * (x - ax) < 0:
                break
            hull.pop()
        hull.append((x, y))
    return hull


def roc_convex_hull(df: DataFrame, by: list[str] = [], **kw) -> DataFrame:
    """Upper envelope of the ROC points with (0, 0) and (1, 1), on integer counts.

    Each task first reduces the points it holds to their own hull without a shuffle; only those survivors
    meet per group.
    """
    df, keys = _grouped(df, by)
    counts = score_counts(df, keys, **kw).select(*keys, "fp", "tp", "n_pos", "n_neg")
    fields = [counts.schema[k] for k in keys]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("fp", "tp", "n_pos", "n_neg")]])

    def reduce(anchored: bool):
        def run(batches):
            key, hull, size = None, [], None

            def emit():
                points = hull
                if anchored:
                    corners = {(0, 0), (size[1], size[0])}
                    points = _upper_hull(iter(sorted(set(hull) | corners)))
                return pd.DataFrame([[*key, x, y, *size] for x, y in points], columns=schema.names)

            for k, part, opens in sorted_runs(batches, keys):
                if opens:
                    if key is not None:
                        yield emit()
                    key, hull, size = k, [], (int(part["n_pos"].iloc[0]), int(part["n_neg"].iloc[0]))
                hull = _upper_hull(iter([*hull, *zip(part["fp"].astype(int).tolist(), part["tp"].astype(int).tolist())]))
            if key is not None:
                yield emit()

        return run

    local = counts.sortWithinPartitions(*keys, "fp", "tp").mapInPandas(reduce(False), schema)
    hull = local.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "fp", "tp").mapInPandas(reduce(True), schema)
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.nullif(F.col(whole).cast("double"), F.lit(0.0)))
    corner = lambda other: F.when(F.col(other) > 0, 1.0).otherwise(0.0)
    return hull.select(*by, F.coalesce(share("fp", "n_neg"), corner("tp")).alias("fpr"), F.coalesce(share("tp", "n_pos"), corner("fp")).alias("tpr"))


def cost_curve(hull: DataFrame, priors: dict[str, float], tier: str = "challenge", model: dict = K.COST_MODEL) -> DataFrame:
    """Expected cost of every hull vertex under each named prior."""
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("regime"), F.lit(float(p)).alias("prior")) for n, p in priors.items()]))
    rows = hull.withColumn("_p", named).select(*hull.columns, "_p.regime", "_p.prior")
    return rows.withColumn("cost", C.expected_cost(F.col("tpr"), F.col("fpr"), F.col("prior"), tier, model))


def min_cost_point(curve: DataFrame, by: list[str]) -> DataFrame:
    """Cheapest vertex per group; the lowest false-positive rate wins a tie."""
    best = curve.groupBy(*by).agg(F.min(F.struct("cost", "fpr", "tpr")).alias("_b"))
    return best.select(*by, "_b.fpr", "_b.tpr", "_b.cost")


def f1_at(fpr: Column, tpr: Column, prior) -> Column:
    pi = prior if isinstance(prior, Column) else F.lit(float(prior))
    down = pi * tpr + (1 - pi) * fpr
    precision = F.when(down > 0, pi * tpr / F.nullif(down, F.lit(0.0))).otherwise(0.0)
    total = precision + tpr
    return F.when(total > 0, 2 * precision * tpr / F.nullif(total, F.lit(0.0))).otherwise(0.0)


def f1_optimal(hull: DataFrame, by: list[str], prior: float = K.COST_MODEL["prior_steady_state"]) -> DataFrame:
    """Vertex with the best F1 at the prior; the lowest false-positive rate wins a tie."""
    scored = hull.withColumn("f1", f1_at(F.col("fpr"), F.col("tpr"), prior))
    best = scored.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("fpr")).alias("x"), (-F.col("tpr")).alias("y"))).alias("_b"))
    return best.select(*by, (-F.col("_b.x")).alias("fpr"), (-F.col("_b.y")).alias("tpr"), "_b.f1")


def cost_summary(hull: DataFrame, by: list[str], tier: str = "challenge", model: dict = K.COST_MODEL) -> DataFrame:
    """Both optima, the cost gap between the F1 and the cost optimum, and the saving of switching regime."""
    pi0, pi1 = model["prior_steady_state"], model["prior_under_attack"]
    hull, keys = _grouped(hull, by)
    rows = hull.withColumns(
        {
            "c0": C.expected_cost(F.col("tpr"), F.col("fpr"), pi0, tier, model),
            "c1": C.expected_cost(F.col("tpr"), F.col("fpr"), pi1, tier, model),
            "f1": f1_at(F.col("fpr"), F.col("tpr"), pi0),
        }
    )
    best = rows.groupBy(*keys).agg(
        F.min(F.struct("c0", "fpr", "tpr", "c1")).alias("_m0"), F.min(F.struct("c1", "fpr")).alias("_m1"),
        F.max(F.struct("f1", (-F.col("fpr")).alias("x"), (-F.col("tpr")).alias("y"), "c0")).alias("_f"),
    )
    return best.select(
        *by, F.col("_m0.fpr").alias("cost_fpr"), F.col("_m0.tpr").alias("cost_tpr"), F.col("_m0.c0").alias("min_cost_pi0"),
        F.col("_m1.c1").alias("min_cost_pi1"), (-F.col("_f.x")).alias("f1_fpr"), F.col("_f.f1").alias("f1"),
        (F.col("_f.c0") - F.col("_m0.c0")).alias("cost_gap"), (F.col("_m0.c1") - F.col("_m1.c1")).alias("regime_switch_saving"),
    )


def cost_envelope(hull: DataFrame, by: list[str], priors=K.RIBBON_PRIORS, tier: str = "challenge", model: dict = K.COST_MODEL) -> DataFrame:
    """Lowest and highest cost over the priors at every hull vertex."""
    curve = cost_curve(hull, {str(p): p for p in priors}, tier, model)
    return curve.groupBy(*by, "fpr", "tpr").agg(F.min("cost").alias("cost_low"), F.max("cost").alias("cost_high"))


def focus_bound(hull: DataFrame, by: list[str], prior: float = K.COST_MODEL["prior_steady_state"], tier: str = "challenge") -> DataFrame:
    """Right edge of the decision region: 1.5 times the first vertex beyond the cost optimum, else 0.01."""
    hull, keys = _grouped(hull, by)
    best = min_cost_point(cost_curve(hull, {"p": prior}, tier), keys).select(*keys, F.col("fpr").alias("_f"))
    beyond = join_groups(hull, best, keys).groupBy(*keys).agg(F.min(F.when(F.col("fpr") > F.col("_f"), F.col("fpr"))).alias("_n"))
    return beyond.select(*by, F.coalesce(F.col("_n") * 1.5, F.lit(0.01)).alias("fpr_max"))
