"""Boosted-tree scoring: training, early stopping, attribution, and calibration fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import constants as K
from riskloom.operators import ranking as R
from riskloom.operators.ranked import stretch_of, stretches, value_prefix


def training_matrix(
    samples: DataFrame, corpus: DataFrame, keys: list[str], features=K.FEATURE_NAMES, excluded=K.EXCLUDED_FEATURES, label: str = "is_attack"
) -> DataFrame:
    """Samples joined to their features; excluded features become 0.0 so that the width stays the same."""
    values = [F.lit(0.0).alias(n) if n in excluded else F.col(n).cast("double").alias(n) for n in features]
    keep = [c for c in samples.columns if c not in features]
    joined = samples.join(corpus.select(*keys, *[n for n in features if n not in samples.columns]), keys)
    rows = joined.select(*keep, *values, F.col(label).cast("double").alias("target"))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)


def train_gbt(matrix: DataFrame, rounds: int = 200, depth: int = 6, seed: int = 42) -> GBTClassificationModel:
    """Boosted trees with the positive class weighted by the class ratio."""
    counts = matrix.agg(F.sum("target").alias("p"), F.count(F.lit(1)).alias("n")).first()
    positives, negatives = float(counts["p"] or 0.0), float(counts["n"]) - float(counts["p"] or 0.0)
    if positives == 0 or negatives == 0:
        raise ValueError("training slice is single-class")
    weighted = matrix.withColumn("weight", F.when(F.col("target") == 1.0, negatives / positives).otherwise(1.0))
    learner = GBTClassifier(
        labelCol="target", featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed, cacheNodeIds=False
    )
    return learner.fit(weighted)


def score_margin(model: GBTClassificationModel, matrix: DataFrame, name: str = "margin") -> DataFrame:
    """Log-odds per row. The library fits +-1 labels under log loss, so its raw score is half the log-odds."""
    scored = model.transform(matrix)
    return scored.withColumn(name, 2.0 * vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction")


# --- trees as arrays --------------------------------------------------------------------
def tree_arrays(model: GBTClassificationModel) -> list[dict]:
    """Feature, threshold, children and mean per node of every tree; a few kilobytes per tree."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights):
        rows: list[list[float]] = []

        def visit(node) -> int:
            place = len(rows)
            rows.append([-1, 0.0, place, place, node.prediction()])
            if node.subtreeDepth() > 0:
                split = node.split()
                rows[place][:2] = [split.featureIndex(), split.threshold()]
                rows[place][2] = visit(node.leftChild())
                rows[place][3] = visit(node.rightChild())
            return place

        visit(tree._call_java("rootNode"))
        table = np.array(rows, dtype=float)
        out.append(
            {
                "feature": table[:, 0].astype(int), "threshold": table[:, 1], "left": table[:, 2].astype(int),
                "right": table[:, 3].astype(int), "value": table[:, 4], "weight": 2.0 * float(weight),
            }
        )
    return out


def _walk(tree: dict, x: np.ndarray, visit=None) -> np.ndarray:
    """Leaf of every row; ``visit(rows, feature, gain)`` sees each step."""
    at = np.zeros(len(x), dtype=int)
    while True:
        inner = np.flatnonzero(tree["feature"][at] >= 0)
        if len(inner) == 0:
            return at
        node = at[inner]
        feature = tree["feature"][node]
        child = np.where(x[inner, feature] <= tree["threshold"][node], tree["left"][node], tree["right"][node])
        if visit is not None:
            visit(inner, feature, tree["weight"] * (tree["value"][child] - tree["value"][node]))
        at[inner] = child


def top_contributors(model: GBTClassificationModel, matrix: DataFrame, features: list[str], k: int = 5) -> DataFrame:
    """Adds ``margin``, ``bias`` and the ``k`` features that moved the margin most.

    A feature's contribution is the change of the node mean along the path; contributions and bias sum to
    the margin. The trees travel with the task; rows stay distributed.
    """
    trees = tree_arrays(model)
    bias = float(sum(t["weight"] * t["value"][0] for t in trees))
    width = len(features)
    base = matrix.withColumn("_x", vector_to_array("features")).drop("features")
    schema = T.StructType([*base.drop("_x").schema.fields, T.StructField("_c", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["_x"].to_numpy())
            share = np.zeros((len(pdf), width))
            for tree in trees:
                _walk(tree, x, lambda rows, feature, gain: np.add.at(share, (rows, feature), gain))
            yield pdf.drop(columns="_x").assign(_c=list(share))

    out = base.mapInPandas(run, schema)
    names = F.array(*[F.lit(n) for n in features])
    ranked = F.array_sort(F.transform("_c", lambda v, i: F.struct((-F.abs(v)).alias("size"), i.alias("place"), v.alias("v"))))
    top = F.transform(
        F.slice(ranked, 1, k), lambda s: F.struct(F.element_at(names, s["place"] + 1).alias("feature"), F.round(s["v"], 6).alias("contribution"))
    )
    margin = F.aggregate("_c", F.lit(bias), lambda a, v: a + v)
    return out.select(*[c for c in out.columns if c != "_c"], margin.alias("margin"), F.lit(bias).alias("bias"), top.alias("top_contributors"))


def early_stop_trace(model: GBTClassificationModel, validation: DataFrame, target_fpr: float = K.COST_MODEL["target_fpr"]) -> DataFrame:
    """Validation recall at the target rate after each round."""
    trees = tree_arrays(model)
    base = validation.select((F.col("target") == 1.0).alias("label"), vector_to_array("features").alias("_x"))
    schema = T.StructType([T.StructField("round", T.IntegerType()), T.StructField("label", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x, y = np.stack(pdf["_x"].to_numpy()), pdf["label"].to_numpy()
            margin = np.zeros(len(pdf))
            for i, tree in enumerate(trees, start=1):
                margin = margin + tree["weight"] * tree["value"][_walk(tree, x)]
                yield pd.DataFrame({"round": np.full(len(pdf), i, dtype=np.int32), "label": y, "score": margin})

    long = base.mapInPandas(run, schema)
    return R.recall_at_fpr(long, target_fpr, ["round"]).select("round", F.coalesce("value", F.lit(0.0)).alias("recall"))


def best_round(trace: DataFrame, patience: int = 50) -> tuple[int, bool]:
    """Round to keep and whether the trace could tell rounds apart; one row per round reaches the driver."""
    values = [(r["round"], r["recall"]) for r in trace.orderBy("round").collect()]
    if len({round(v, 9) for _, v in values}) <= 1:
        return len(values), False
    best, at = -math.inf, 0
    for number, value in values:
        if value > best:
            best, at = value, number
        elif number - at >= patience:
            break
    return at, True


# --- Platt ------------------------------------------------------------------------------
def _sigmoid_fit(points: DataFrame, start: np.ndarray, rounds: int, tol: float) -> np.ndarray:
    """Slope and intercept of least cross-entropy over ``m`` (margin), ``t`` (target) and ``n`` (weight), by Newton's method.

    Each round is one aggregate: gradient and Hessian at the present point, and the loss there and along the last
    direction. A step is kept if the loss fell and halved otherwise, so a round never needs a second pass. Near a flat
    optimum the Hessian is damped by a share of its trace.
    """
    m, t, n = F.col("m"), F.col("t"), F.col("n")
    here, direction, share, best = start, np.zeros(2), 1.0, math.inf
    for _ in range(rounds):
        trial = here + share * direction
        z = F.lit(float(trial[0])) * m + F.lit(float(trial[1]))
        p = 1 / (1 + F.exp(-z))
        loss = F.sum(n * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - t * z))
        miss, spread = n * (p - t), n * p * (1 - p)
        row = points.agg(loss, F.sum(miss * m), F.sum(miss), F.sum(spread * m * m), F.sum(spread * m), F.sum(spread)).first()
        if not row[0] < best:
            if np.abs(share * direction).max() < tol:
                return here
            share /= 2
            continue
        here, best, share = trial, row[0], 1.0
        gradient = np.array([row[1], row[2]])
        hessian = np.array([[row[3], row[4]], [row[4], row[5]]])
        direction = -np.linalg.solve(hessian + np.eye(2) * max(1e-15 * np.trace(hessian), 1e-12), gradient)
        if np.abs(direction).max() < tol:
            return here + direction
    return here


def fit_platt(df: DataFrame, margin: str = "margin", label: str = "label", max_iter: int = 200, tol: float = 1e-11) -> tuple[float, float, float, int]:
    """Slope, intercept, prevalence and size of the sigmoid fit; raises on one class or a non-positive slope.

    Targets are the smoothed class frequencies. Equal margins are merged once, so a round reads the distinct ones.
    """
    grouped = df.groupBy(F.col(margin).cast("double").alias("m"), F.col(label).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n")).persist()
    try:
        sizes = {r["y"]: r["n"] for r in grouped.groupBy("y").agg(F.sum("n").alias("n")).collect()}
        pos, neg = sizes.get(True, 0.0), sizes.get(False, 0.0)
        if not pos or not neg:
            raise ValueError("labels are single-class; cannot fit a calibrator")
        target = F.when(F.col("y"), (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
        a, b = _sigmoid_fit(grouped.withColumn("t", target), np.array([0.0, math.log((pos + 1) / (neg + 1))]), max_iter, tol)
    finally:
        grouped.unpersist()
    if not (math.isfinite(a) and math.isfinite(b) and a > 0):
        raise ValueError(f"calibrator is not increasing (a={a}, b={b})")
    return float(a), float(b), pos / (pos + neg), int(pos + neg)


# --- isotonic ---------------------------------------------------------------------------
#: Neighbouring minorants that one task merges.
MERGED = 16


def _lower_hull(batches):
    """The points of a partition, sorted by ``x``, that are strict corners of their greatest convex minorant."""
    hull: list[tuple] = []
    for part in batches:
        for x, y, s in zip(part["x"].astype(int).tolist(), part["y"].astype(int).tolist(), part["score"].tolist()):
            while len(hull) >= 2:
                (ax, ay, _), (bx, by, _) = hull[-2], hull[-1]
                if (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0:
                    break
                hull.pop()
            hull.append((x, y, s))
    if hull:
        yield pd.DataFrame(hull, columns=["x", "y", "score"])


def fit_isotonic(df: DataFrame, score: str = "score", label: str = "label", parts: int = 0, merged: int = MERGED) -> DataFrame:
    """Steps ``(start, value)`` of the isotonic fit, equal scores pooled.

    The fit is the slope of the greatest convex minorant of the cumulative (count, positives) diagram. Each stretch of the score
    axis drops its own points above its minorant; the corners left are merged in a tree, ``merged`` neighbouring stretches to a
    task, so a task sees a few minorants and never all stretches.
    """
    counts = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    ).withColumn("_all", F.lit(0))
    parts = parts or stretches(counts)
    placed = value_prefix(counts, ["_all"], "score", ["n", "pos"], parts=parts)
    inner = placed.select(F.col("before_n").alias("x"), F.col("before_pos").alias("y"), "score")
    end = counts.agg(F.sum("n").alias("x"), F.sum("pos").alias("y")).filter("x > 0").withColumn("score", F.lit(None).cast("double"))
    points = inner.unionByName(end)
    schema = T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType()), T.StructField("score", T.DoubleType())])
    whole = counts.agg(F.sum("n")).scalar()
    corners = points.sortWithinPartitions("x").mapInPandas(_lower_hull, schema)
    while parts > merged:
        parts = -(-parts // merged)
        cell = F.floor(F.col("x") * parts / (whole + 1))
        corners = corners.repartition(parts, cell).sortWithinPartitions("x").mapInPandas(_lower_hull, schema)
    # The corners of the whole fit, whose number grows far slower than the scores'.
    corners = corners.repartition(1).sortWithinPartitions("x").mapInPandas(_lower_hull, schema)
    order = Window.orderBy("x")
    slope = (F.lead("y").over(order) - F.col("y")) / (F.lead("x").over(order) - F.col("x"))
    return corners.withColumn("value", slope).filter(F.col("value").isNotNull()).select(F.col("score").alias("start"), "value")


#: Steps that one stretch of scores carries.
STRETCH_STEPS = 100_000


def predict_isotonic(df: DataFrame, steps: DataFrame, score: str = "score", name: str = "calibrated", parts: int = 0) -> DataFrame:
    """Value of the last step at or below the score; the first step below all of them.

    Steps are merged with the rows in score order, cut into stretches that carry their predecessor's last step.
    ``parts`` is the number of stretches; by default it follows the number of steps and the session's partitions.
    """
    parts = parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + steps.count() // STRETCH_STEPS)
    return _merge_steps(df, steps, score, name, parts)


def _merge_steps(df: DataFrame, steps: DataFrame, score: str, name: str, parts: int) -> DataFrame:
    cuts = steps.agg(F.percentile_approx("start", [i / parts for i in range(1, parts)], 10_000)).scalar()
    first = steps.agg(F.min_by("value", "start")).scalar()

    marks = stretch_of(steps, "start", cuts, parts)
    ends = marks.groupBy("_part").agg(F.max_by(F.struct("start", "value"), "start").alias("_e"))
    # Every stretch starts from the last step of the nearest earlier stretch that has one.
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spots = df.sparkSession.range(parts).select(F.col("id").cast("int").alias("_part"))
    carried = spots.join(ends, "_part", "left").withColumn("_c", F.last("_e", ignorenulls=True).over(order)).filter(F.col("_c").isNotNull())
    rows = stretch_of(df, score, cuts, parts).select("_part", F.col(score).cast("double").alias("_at"), F.lit(1).alias("_k"), F.lit(None).cast("double").alias("_v"), F.struct(*df.columns).alias("_row"))
    step = marks.select("_part", F.col("start").alias("_at"), F.lit(0).alias("_k"), F.col("value").alias("_v"), F.lit(None).alias("_row"))
    lead = carried.select("_part", F.col("_c.start").alias("_at"), F.lit(0).alias("_k"), F.col("_c.value").alias("_v"), F.lit(None).alias("_row"))
    merged = rows.unionByName(step).unionByName(lead)
    scan = Window.partitionBy("_part").orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = merged.withColumn("_y", F.last("_v", ignorenulls=True).over(scan)).filter(F.col("_row").isNotNull()).withColumn("_first", first)
    return found.select("_row.*", F.coalesce("_y", "_first").alias(name))
