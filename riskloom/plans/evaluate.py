"""Registered queries: samples, splits, baselines, ranking, calibration and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import columns as C
from riskloom.operators import calibration as CAL, detectors, features, incidents as I, ranking as R, reports as REP, samples as S
from riskloom.plans import cases, windows
from riskloom.plans.registry import query, table
from riskloom.plans.views import ATTEMPTS_SQL, DAY, EPISODES_SQL, HOUR, MID, attempts, episodes
from riskloom.plans.windows import RULES_SQL, WIDTHS, _over, feature_sql, ruled
from riskloom.session import materialize

HORIZON = 6 * HOUR
_NAMES = "['easy','medium','hard','evasive']"
SAMPLES_SQL = f"""{ATTEMPTS_SQL}, {EPISODES_SQL},
samples AS (
  SELECT a.attempt_uid, a.seq, a.ingest_ms, a.merchant_id, a.ip, a.bin, a.card_hash, a.user_id, a.k, a.score, a.is_attack, a.gateway_status, a.event_id, a.episode_id,
    CASE WHEN a.user_id % 10 <> 1 THEN ({_NAMES})[(a.user_id // 10) % 4 + 1] END AS stream_tier, e.tier AS episode_tier,
    coalesce(e.kind, 'baseline') AS kind, e.scenario, a.ingest_ms + 340 AS outcome_visible_ms
  FROM attempts a LEFT JOIN episodes e USING (episode_id))
"""


def samples(spark, sf_dir):
    """Labelled samples; events, labels and episodes are three tables joined on their keys."""
    base = attempts(spark, sf_dir).withColumns(
        {
            "run_index": F.lit(0),
            "event_id": F.col("attempt_uid").cast("string"),
            "stream_tier": F.when(
                F.col("user_id") % 10 != 1,
                F.element_at(F.array(*[F.lit(t) for t in K.STREAM_TIERS]), (F.floor(F.col("user_id") / 10) % 4 + 1).cast("int")),
            ),
        }
    )
    labels = base.select("run_index", "event_id", "is_attack", "episode_id", "gateway_status", "decline_code")
    events = base.drop("is_attack", "episode_id", "gateway_status", "decline_code")
    return S.build_samples(events, labels, episodes(attempts(spark, sf_dir)))


def scored(spark, sf_dir):
    """Score, label and arrival order without the joins, for ranking metrics."""
    return attempts(spark, sf_dir).select(
        "score", F.col("is_attack").alias("label"), F.col("seq").alias("ordinal"), "merchant_id", "user_id", "k"
    )


_SCORED = "scored AS (SELECT score, is_attack AS label, seq AS ordinal, merchant_id, user_id, k FROM attempts)"
SCORED_SQL = f"{ATTEMPTS_SQL}, {_SCORED}"
# The seeded scorer: 32 bits of a digest of seed and row.
_RANDOM = "CAST('0x' || substr(sha256('42:' || seq), 1, 8) AS BIGINT) / 4294967295.0e0"
# Coarse scores with many ties, half of the sample mixed.
COARSE = "round(score * 8) / 8"


def coarse(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("score", F.round(F.col("score") * 8) / 8)


COARSE_SQL = f"{ATTEMPTS_SQL}, scored AS (SELECT round(score * 8) / 8 AS score, is_attack AS label, seq AS ordinal, merchant_id, user_id, k FROM attempts)"


# --- samples and splits -----------------------------------------------------------------
@query("build_samples", f"WITH {SAMPLES_SQL} SELECT attempt_uid, kind, scenario, stream_tier, episode_tier, outcome_visible_ms, is_attack FROM samples")
def _build(spark, sf_dir):
    return samples(spark, sf_dir).select("attempt_uid", "kind", "scenario", "stream_tier", "episode_tier", "outcome_visible_ms", "is_attack")


OVERLAP_SQL = f"""
win AS (SELECT episode_id, min(ingest_ms) AS lo, max(ingest_ms) + {HORIZON} AS hi FROM samples WHERE is_attack GROUP BY 1),
att AS (SELECT DISTINCT s.episode_id, ip, card_hash, lo, hi FROM samples s JOIN win USING (episode_id) WHERE is_attack),
touched AS (
  SELECT s.attempt_uid FROM samples s JOIN att a ON s.ip = a.ip AND s.ingest_ms BETWEEN a.lo AND a.hi WHERE NOT s.is_attack
  UNION SELECT s.attempt_uid FROM samples s JOIN att a ON s.card_hash = a.card_hash AND s.ingest_ms BETWEEN a.lo AND a.hi WHERE NOT s.is_attack),
flagged AS (SELECT s.*, t.attempt_uid IS NOT NULL AS entity_overlap FROM samples s LEFT JOIN touched t USING (attempt_uid))
"""


def overlapped(spark, sf_dir):
    return S.entity_overlap(samples(spark, sf_dir), HORIZON)


@query("entity_overlap", f"WITH {SAMPLES_SQL}, {OVERLAP_SQL} SELECT attempt_uid, entity_overlap FROM flagged")
def _overlap(spark, sf_dir):
    return overlapped(spark, sf_dir).select("attempt_uid", "entity_overlap")


@query("clean_view", f"WITH {SAMPLES_SQL}, {OVERLAP_SQL} SELECT attempt_uid FROM flagged WHERE is_attack OR NOT entity_overlap")
def _clean(spark, sf_dir):
    return S.clean_view(overlapped(spark, sf_dir)).select("attempt_uid")


def _split_sql(source: str, fraction: float, embargo: int, names: tuple[str, str], out: str) -> str:
    return f"""
{out}_b AS (SELECT min(ingest_ms) + CAST(trunc((max(ingest_ms) - min(ingest_ms)) * {fraction}e0) AS BIGINT) AS cut FROM {source}),
{out}_s AS (SELECT episode_id FROM {source}, {out}_b WHERE episode_id IS NOT NULL GROUP BY 1
  HAVING bool_or(ingest_ms > cut AND ingest_ms <= cut + {embargo}) OR (bool_or(ingest_ms <= cut) AND bool_or(ingest_ms > cut))),
{out} AS (SELECT * REPLACE (CASE WHEN ingest_ms <= cut THEN '{names[0]}' ELSE '{names[1]}' END AS split) FROM (SELECT *, '' AS split FROM {source}), {out}_b
  WHERE (ingest_ms <= cut OR ingest_ms > cut + {embargo}) AND (episode_id IS NULL OR episode_id NOT IN (SELECT episode_id FROM {out}_s)))
"""


def _untagged(sql_name: str, keep: str) -> str:
    return f"(SELECT * EXCLUDE (split, cut) FROM {sql_name} WHERE split = '{keep}')"


@query("temporal_split", f"WITH {SAMPLES_SQL}, {_split_sql('samples', 0.7, HORIZON, ('train', 'test'), 'cut1')} SELECT attempt_uid, split FROM cut1")
def _temporal(spark, sf_dir):
    return S.temporal_split(samples(spark, sf_dir), 0.7, HORIZON).select("attempt_uid", "split")


@query(
    "three_way_temporal_slice",
    f"""WITH {SAMPLES_SQL}, {_split_sql('samples', 0.7, HORIZON, ('fit', 'rest'), 'cut1')}, rest AS {_untagged('cut1', 'rest')},
    {_split_sql('rest', 0.5, HORIZON, ('earlystop', 'calib'), 'cut2')}
    SELECT attempt_uid, split FROM cut1 WHERE split = 'fit' UNION ALL SELECT attempt_uid, split FROM cut2""",
)
def _three_way(spark, sf_dir):
    return S.three_way_temporal_slice(samples(spark, sf_dir), HORIZON).select("attempt_uid", "split")


@query("attack_shape_holdout", f"WITH {SAMPLES_SQL} SELECT attempt_uid, CASE WHEN stream_tier = 'hard' THEN 'test' ELSE 'train' END AS split FROM samples WHERE stream_tier IN ('easy', 'medium', 'hard')")
def _holdout(spark, sf_dir):
    return S.attack_shape_holdout(samples(spark, sf_dir)).select("attempt_uid", "split")


@query("exclude_negative_controls", f"WITH {SAMPLES_SQL} SELECT attempt_uid FROM samples WHERE kind <> 'negative_control'")
def _exclude(spark, sf_dir):
    return S.exclude_negative_controls(samples(spark, sf_dir)).select("attempt_uid")


@query("negative_control_splits", f"WITH {SAMPLES_SQL} SELECT attempt_uid, 'negative_control:' || scenario AS split FROM samples WHERE kind = 'negative_control'")
def _controls(spark, sf_dir):
    return S.negative_control_splits(samples(spark, sf_dir)).select("attempt_uid", "split")


@query("tier_e_split", f"WITH {SAMPLES_SQL} SELECT attempt_uid, 'tier_e' AS split FROM samples WHERE stream_tier = 'evasive'")
def _tier_e(spark, sf_dir):
    return S.tier_e_split(samples(spark, sf_dir)).select("attempt_uid", "split")


@query(
    "false_linkage_rate",
    f"WITH {ATTEMPTS_SQL}, c AS (SELECT CAST(count(*) AS DOUBLE) AS c FROM attempts GROUP BY bin) SELECT round(sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)), 9) AS false_linkage_rate FROM c",
)
def _linkage(spark, sf_dir):
    return S.false_linkage_rate(attempts(spark, sf_dir), "bin").select(F.round("false_linkage_rate", 9).alias("false_linkage_rate"))


# --- baseline scorers -------------------------------------------------------------------
B1_SQL = f"""
b1 AS (
  SELECT a.attempt_uid, count(d.attempt_uid) AS visible_declines FROM samples a
  LEFT JOIN samples d ON d.ip = a.ip AND d.gateway_status = 'declined' AND d.outcome_visible_ms < a.ingest_ms AND d.outcome_visible_ms > a.ingest_ms - {3 * DAY}
  GROUP BY 1)
"""


@query("b1_decline_velocity", f"WITH {SAMPLES_SQL}, {B1_SQL} SELECT attempt_uid, visible_declines, CASE WHEN visible_declines >= 2 THEN 1.0e0 ELSE 0.0e0 END AS b1 FROM b1")
def _b1(spark, sf_dir):
    return S.b1_decline_velocity(samples(spark, sf_dir), 2, 3 * DAY).select("attempt_uid", "visible_declines", "b1")


@query(
    "b2_bin_concentration",
    f"WITH {ATTEMPTS_SQL} SELECT attempt_uid, CASE WHEN count(DISTINCT card_hash) OVER (PARTITION BY bin ORDER BY ingest_ms RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND CURRENT ROW) >= 7 THEN 1.0e0 ELSE 0.0e0 END AS b2 FROM attempts",
)
def _b2(spark, sf_dir):
    df = attempts(spark, sf_dir).select("attempt_uid", "seq", "ingest_ms", "bin", "card_hash")
    return S.b2_bin_concentration(df, 7, 6 * HOUR).select("attempt_uid", "b2")


@query("b0_rules_scorer", f"WITH {ATTEMPTS_SQL}, {RULES_SQL} SELECT attempt_uid, round(CAST(rule_score AS DOUBLE), 6) AS b0 FROM ruled")
def _b0(spark, sf_dir):
    logged = ruled(spark, sf_dir).select(F.lit(0).alias("run_index"), F.col("attempt_uid").cast("string").alias("event_id"), "rule_score")
    return S.b0_rules_scorer(samples(spark, sf_dir), logged).select("attempt_uid", F.round("b0", 6).alias("b0"))


@query(
    "sanity_scorers",
    f"WITH {ATTEMPTS_SQL} SELECT attempt_uid, CASE WHEN is_attack THEN 1.0e0 ELSE 0.0e0 END AS perfect, CASE WHEN is_attack THEN 0.0e0 ELSE 1.0e0 END AS inverted, 1.0e0 AS always_positive, {_RANDOM} AS random FROM attempts",
)
def _sanity(spark, sf_dir):
    scorers = S.sanity_scorers(F.col("is_attack"), [F.col("seq")])
    return attempts(spark, sf_dir).select("attempt_uid", *[scorers[n].alias(n) for n in ("perfect", "inverted", "always_positive", "random")])


# --- ranking ----------------------------------------------------------------------------
ROC_SQL = """
cnt AS (SELECT merchant_id, score, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM scored GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY merchant_id) AS p, sum(neg) OVER (PARTITION BY merchant_id) AS n
  FROM cnt WINDOW w AS (PARTITION BY merchant_id ORDER BY score DESC)),
roc AS (
  SELECT merchant_id, CASE WHEN n > 0 THEN fp / n ELSE 0 END AS fpr, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS tpr, score AS threshold, tp, fp, p, n FROM cum
  UNION ALL SELECT DISTINCT merchant_id, 0.0e0, 0.0e0, CAST('inf' AS DOUBLE), 0, 0, p, n FROM cum
  UNION ALL SELECT DISTINCT merchant_id, CASE WHEN n > 0 THEN 1.0e0 ELSE 0 END, CASE WHEN p > 0 THEN 1.0e0 ELSE 0 END, CAST('-inf' AS DOUBLE), p, n, p, n FROM cum)
"""


@query(
    "roc_points",
    f"WITH {ATTEMPTS_SQL}, {_SCORED}, {ROC_SQL} SELECT merchant_id, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr, CASE WHEN isinf(threshold) THEN NULL ELSE threshold END AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM roc",
)
def _roc(spark, sf_dir):
    points = R.roc_points(scored(spark, sf_dir), ["merchant_id"])
    finite = F.when(F.abs("threshold") != float("inf"), F.col("threshold"))
    return points.select("merchant_id", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"), finite.alias("threshold"), "tp", "fp")


@query(
    "roc_points_ties",
    f"WITH {COARSE_SQL}, {ROC_SQL} SELECT merchant_id, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr, CASE WHEN isinf(threshold) THEN NULL ELSE threshold END AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM roc",
)
def _roc_ties(spark, sf_dir):
    points = R.roc_points(coarse(spark, sf_dir), ["merchant_id"])
    finite = F.when(F.abs("threshold") != float("inf"), F.col("threshold"))
    return points.select("merchant_id", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"), finite.alias("threshold"), "tp", "fp")


@query(
    "recall_at_fpr",
    f"""WITH {ATTEMPTS_SQL}, {_SCORED}, {ROC_SQL}, best AS (
      SELECT merchant_id, p, n, max(CASE WHEN fpr <= 0.05 THEN tpr END) AS v, max(CASE WHEN fpr <= 0.05 THEN fp END) AS f FROM roc GROUP BY ALL),
    w AS (SELECT *, f / n AS q, 1.959963984540054e0 AS z FROM best)
    SELECT merchant_id, CASE WHEN p > 0 THEN round(v, 9) END AS value, CAST(n AS BIGINT) AS n_neg, CASE WHEN p > 0 THEN n >= 1 / 0.05 END AS resolvable,
      CASE WHEN p > 0 THEN round(greatest(0, (q + z*z/(2*n) - z * sqrt(q*(1-q)/n + z*z/(4*n*n))) / (1 + z*z/n)), 9) END AS ci_low,
      CASE WHEN p > 0 THEN round(least(1, (q + z*z/(2*n) + z * sqrt(q*(1-q)/n + z*z/(4*n*n))) / (1 + z*z/n)), 9) END AS ci_high FROM w""",
)
def _recall(spark, sf_dir):
    out = R.recall_at_fpr(scored(spark, sf_dir), 0.05, ["merchant_id"])
    return out.select("merchant_id", "n_neg", "resolvable", *[F.round(c, 9).alias(c) for c in ("value", "ci_low", "ci_high")])


AP_SQL = """
rk AS (SELECT *, row_number() OVER w AS r, sum(CASE WHEN label THEN 1 ELSE 0 END) OVER w AS tp, count(*) FILTER (label) OVER (PARTITION BY merchant_id) AS p,
  count(*) FILTER (NOT label) OVER (PARTITION BY merchant_id) AS n FROM scored WINDOW w AS (PARTITION BY merchant_id ORDER BY score DESC, ordinal)),
aps AS (SELECT merchant_id, CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(CASE WHEN label THEN tp / r END) / max(p) END AS ap,
  CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(CASE WHEN label THEN 0.01e0 * (tp / p) / (0.01e0 * (tp / p) + 0.99e0 * ((r - tp) / n)) END) / max(p) END AS at FROM rk GROUP BY 1)
""".replace(" AS at FROM", " AS tilted FROM")


@query("average_precision", f"WITH {ATTEMPTS_SQL}, {_SCORED}, {AP_SQL} SELECT merchant_id, round(ap, 9) AS ap FROM aps")
def _ap(spark, sf_dir):
    return R.average_precision(scored(spark, sf_dir), ["merchant_id"]).select("merchant_id", F.round("ap", 9).alias("ap"))


@query("average_precision_ties", f"WITH {COARSE_SQL}, {AP_SQL} SELECT merchant_id, round(ap, 9) AS ap FROM aps")
def _ap_ties(spark, sf_dir):
    return R.average_precision(coarse(spark, sf_dir), ["merchant_id"]).select("merchant_id", F.round("ap", 9).alias("ap"))


@query("ap_at_prevalence", f"WITH {ATTEMPTS_SQL}, {_SCORED}, {AP_SQL} SELECT merchant_id, round(tilted, 9) AS ap_at_prevalence FROM aps")
def _ap_tilted(spark, sf_dir):
    return R.average_precision(scored(spark, sf_dir), ["merchant_id"]).select("merchant_id", F.round("ap_at_prevalence", 9).alias("ap_at_prevalence"))


@query("ap_at_prevalence_ties", f"WITH {COARSE_SQL}, {AP_SQL} SELECT merchant_id, round(tilted, 9) AS ap_at_prevalence FROM aps")
def _ap_tilted_ties(spark, sf_dir):
    return R.average_precision(coarse(spark, sf_dir), ["merchant_id"]).select("merchant_id", F.round("ap_at_prevalence", 9).alias("ap_at_prevalence"))


AUC_SQL = """
mid AS (SELECT *, (rank() OVER w + rank() OVER w + count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0e0 AS mr FROM {src} WINDOW w AS (PARTITION BY {by} ORDER BY score)),
auc AS (SELECT {by}, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS n, count(DISTINCT score) AS n_values, sum(CASE WHEN label THEN mr ELSE 0 END) AS rs FROM mid GROUP BY 1)
"""


@query(
    "roc_auc",
    f"WITH {ATTEMPTS_SQL}, {_SCORED}, {AUC_SQL.format(by='merchant_id', src='scored')} SELECT merchant_id, CASE WHEN p > 0 AND n > 0 THEN round((rs - p * (p + 1) / 2) / (CAST(p AS DOUBLE) * n), 9) END AS auc FROM auc",
)
def _auc(spark, sf_dir):
    return R.roc_auc(scored(spark, sf_dir), ["merchant_id"]).select("merchant_id", F.round("auc", 9).alias("auc"))


@query(
    "roc_auc_ties",
    f"WITH {COARSE_SQL}, {AUC_SQL.format(by='merchant_id', src='scored')} SELECT merchant_id, CASE WHEN p > 0 AND n > 0 THEN round((rs - p * (p + 1) / 2) / (CAST(p AS DOUBLE) * n), 9) END AS auc FROM auc",
)
def _auc_ties(spark, sf_dir):
    return R.roc_auc(coarse(spark, sf_dir), ["merchant_id"]).select("merchant_id", F.round("auc", 9).alias("auc"))


_DOCS_SQL = "docs AS (SELECT source AS merchant_id, n_chars / 20000.0e0 AS score, toxic = 1 AS label, doc_id AS ordinal FROM labels JOIN documents USING (doc_id))"


@query(
    "roc_auc_documents",
    f"WITH {_DOCS_SQL}, {AUC_SQL.format(by='merchant_id', src='docs')} SELECT merchant_id AS source, CASE WHEN p > 0 AND n > 0 THEN round((rs - p * (p + 1) / 2) / (CAST(p AS DOUBLE) * n), 9) END AS auc FROM auc",
)
def _auc_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    df = docs.select("source", (F.col("n_chars") / 20000.0).alias("score"), (F.col("toxic") == 1).alias("label"))
    return R.roc_auc(df, ["source"]).select("source", F.round("auc", 9).alias("auc"))


@query(
    "operating_point",
    f"""WITH {ATTEMPTS_SQL}, {_SCORED}, c AS (SELECT merchant_id, count(*) FILTER (score >= 0.2 AND label) AS tp, count(*) FILTER (score >= 0.2 AND NOT label) AS fp,
      count(*) FILTER (score < 0.2 AND NOT label) AS tn, count(*) FILTER (score < 0.2 AND label) AS fn FROM scored GROUP BY 1)
    SELECT *, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 9) AS fpr, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS tpr,
      round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 9) AS precision FROM c""",
)
def _point(spark, sf_dir):
    out = R.operating_point(scored(spark, sf_dir), 0.2, ["merchant_id"])
    return out.withColumns({c: F.round(c, 9) for c in ("fpr", "tpr", "precision")})


@query(
    "recall_at_matched_fpr",
    f"""WITH {ATTEMPTS_SQL}, scored AS (SELECT 'all' AS merchant_id, score, is_attack AS label, k FROM attempts), {ROC_SQL},
    g AS (SELECT count(*) FILTER (k >= 95 AND NOT label) / count(*) FILTER (NOT label) AS goal FROM scored)
    SELECT round(goal, 9) AS rule_fpr, round(max(CASE WHEN fpr <= goal THEN tpr END), 9) AS recall FROM roc, g GROUP BY goal""",
)
def _matched(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("rule", F.when(F.col("k") >= 95, 1.0).otherwise(0.0))
    out = R.recall_at_matched_fpr(df, "rule")
    return out.select(F.round("rule_fpr", 9).alias("rule_fpr"), F.round("recall", 9).alias("recall"))


# --- hull and cost ----------------------------------------------------------------------
# A point is on the upper envelope when every slope up to it is above every slope from there on.
HULL_SQL = """
top AS (SELECT merchant_id, CAST(fp AS BIGINT) AS x, CAST(max(tp) AS BIGINT) AS y, max(p) AS p, max(n) AS n FROM roc GROUP BY 1, 2),
slopes AS (
  SELECT b.merchant_id, b.x, min(CASE WHEN a.x < b.x THEN (b.y - a.y) / (b.x - a.x) END) AS before, max(CASE WHEN a.x > b.x THEN (a.y - b.y) / (a.x - b.x) END) AS after
  FROM top a JOIN top b USING (merchant_id) GROUP BY 1, 2),
hull AS (
  SELECT merchant_id, CASE WHEN x = 0 THEN 0 ELSE x / n END AS fpr, y / p AS tpr FROM top JOIN slopes USING (merchant_id, x) WHERE before IS NULL OR after IS NULL OR before > after
  UNION SELECT merchant_id, 0.0e0, 0.0e0 FROM top)
"""
_TIERED = "scored AS (SELECT score, is_attack AS label, seq AS ordinal, 't' || (user_id // 10) % 4 AS merchant_id, user_id, k FROM attempts)"
HULL_BASE = f"WITH {ATTEMPTS_SQL}, {_TIERED}, {ROC_SQL}, {HULL_SQL}"


def tiered(spark, sf_dir):
    """Scores grouped by stream tier, every group with both classes."""
    return scored(spark, sf_dir).withColumn("merchant_id", F.concat(F.lit("t"), F.floor(F.col("user_id") / 10) % 4))


def hull(spark, sf_dir):
    return R.roc_convex_hull(tiered(spark, sf_dir), ["merchant_id"])


@query("roc_convex_hull", f"{HULL_BASE} SELECT merchant_id, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM hull")
def _hull(spark, sf_dir):
    return hull(spark, sf_dir).select("merchant_id", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


def _cost(pi: str, tpr: str = "tpr", fpr: str = "fpr") -> str:
    return f"(10000e0 * ({pi} * (1 - {tpr}) * 5200e0 + (1 - {pi}) * {fpr} * 1800e0))"


COST_SQL = f"""
curve AS (SELECT merchant_id, fpr, tpr, r.regime, r.pi, {_cost('r.pi')} AS cost FROM hull, (VALUES ('pi0', 0.001e0), ('pi1', 0.9e0)) r(regime, pi)),
best AS (SELECT merchant_id, regime, arg_min(struct_pack(fpr, tpr), struct_pack(cost, fpr)) AS b, min(cost) AS cost FROM curve GROUP BY 1, 2),
f1s AS (SELECT *, CASE WHEN tpr = 0 THEN 0 ELSE 2 * (0.001e0 * tpr / (0.001e0 * tpr + 0.999e0 * fpr)) * tpr / ((0.001e0 * tpr / (0.001e0 * tpr + 0.999e0 * fpr)) + tpr) END AS f1 FROM hull),
f1o AS (SELECT merchant_id, arg_max(struct_pack(fpr, tpr), struct_pack(f1, x := -fpr, y := -tpr)) AS b, max(f1) AS f1 FROM f1s GROUP BY 1)
"""


@query("expected_cost", f"{HULL_BASE} SELECT merchant_id, round(fpr, 9) AS fpr, round({_cost('0.9e0')}, 4) AS cost FROM hull")
def _expected(spark, sf_dir):
    cost = C.expected_cost(F.col("tpr"), F.col("fpr"), 0.9, "challenge")
    return hull(spark, sf_dir).select("merchant_id", F.round("fpr", 9).alias("fpr"), F.round(cost, 4).alias("cost"))


@query("cost_curve", f"{HULL_BASE}, {COST_SQL} SELECT merchant_id, regime, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr, round(cost, 4) AS cost FROM curve")
def _curve(spark, sf_dir):
    out = R.cost_curve(hull(spark, sf_dir), {"pi0": 0.001, "pi1": 0.9})
    return out.select("merchant_id", "regime", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"), F.round("cost", 4).alias("cost"))


@query("min_cost_point", f"{HULL_BASE}, {COST_SQL} SELECT merchant_id, regime, round(b.fpr, 9) AS fpr, round(b.tpr, 9) AS tpr, round(cost, 4) AS cost FROM best")
def _min_cost(spark, sf_dir):
    out = R.min_cost_point(R.cost_curve(hull(spark, sf_dir), {"pi0": 0.001, "pi1": 0.9}), ["merchant_id", "regime"])
    return out.select("merchant_id", "regime", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"), F.round("cost", 4).alias("cost"))


@query("f1_optimal", f"{HULL_BASE}, {COST_SQL} SELECT merchant_id, round(b.fpr, 9) AS fpr, round(b.tpr, 9) AS tpr, round(f1, 9) AS f1 FROM f1o")
def _f1(spark, sf_dir):
    out = R.f1_optimal(hull(spark, sf_dir), ["merchant_id"])
    return out.select("merchant_id", *[F.round(c, 9).alias(c) for c in ("fpr", "tpr", "f1")])


def _summary(column: str, sql: str) -> None:
    @query(column, f"{HULL_BASE}, {COST_SQL} SELECT merchant_id, round({sql}, 3) AS {column} FROM best z JOIN best y USING (merchant_id) JOIN f1o f USING (merchant_id) WHERE z.regime = 'pi0' AND y.regime = 'pi1'")
    def _run(spark, sf_dir):
        return R.cost_summary(hull(spark, sf_dir), ["merchant_id"]).select("merchant_id", F.round(column, 3).alias(column))


_summary("cost_gap", f"{_cost('0.001e0', 'f.b.tpr', 'f.b.fpr')} - z.cost")
_summary("regime_switch_saving", f"{_cost('0.9e0', 'z.b.tpr', 'z.b.fpr')} - y.cost")


@query(
    "cost_envelope",
    f"""{HULL_BASE} SELECT merchant_id, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr, round(least({_cost('1e-4')}, {_cost('1e-3')}, {_cost('1e-2')}), 4) AS cost_low,
    round(greatest({_cost('1e-4')}, {_cost('1e-3')}, {_cost('1e-2')}), 4) AS cost_high FROM hull""",
)
def _envelope(spark, sf_dir):
    out = R.cost_envelope(hull(spark, sf_dir), ["merchant_id"])
    return out.select("merchant_id", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"), F.round("cost_low", 4).alias("cost_low"), F.round("cost_high", 4).alias("cost_high"))


@query(
    "cost_focus_bound",
    f"""{HULL_BASE}, {COST_SQL} SELECT h.merchant_id, round(coalesce(min(CASE WHEN h.fpr > z.b.fpr THEN h.fpr END) * 1.5, 0.01), 9) AS fpr_max FROM hull h JOIN best z ON z.merchant_id = h.merchant_id AND z.regime = 'pi0' GROUP BY 1""",
)
def _focus(spark, sf_dir):
    return R.focus_bound(hull(spark, sf_dir), ["merchant_id"]).withColumn("fpr_max", F.round("fpr_max", 9))


# --- calibration ------------------------------------------------------------------------
_RAW = "raw AS (SELECT avg(CASE WHEN label THEN 1.0e0 ELSE 0 END) AS q FROM scored)"
_W = "CASE WHEN label THEN 0.01e0 / q ELSE 0.99e0 / (1 - q) END"


@query("prevalence_weights", f"WITH {ATTEMPTS_SQL}, {_SCORED}, {_RAW} SELECT label, round({_W}, 9) AS weight, count(*) AS n FROM scored, raw GROUP BY ALL")
def _weights(spark, sf_dir):
    out = CAL.prevalence_weights(scored(spark, sf_dir), 0.01)
    return out.groupBy("label", F.round("weight", 9).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@query("effective_n", f"WITH {ATTEMPTS_SQL}, {_SCORED}, {_RAW}, w AS (SELECT {_W} AS w FROM scored, raw) SELECT round(sum(w) * sum(w) / sum(w * w), 4) AS effective_n FROM w")
def _effective(spark, sf_dir):
    return CAL.effective_n(CAL.prevalence_weights(scored(spark, sf_dir), 0.01)).select(F.round("effective_n", 4).alias("effective_n"))


@query("brier", f"WITH {ATTEMPTS_SQL}, {_SCORED}, {_RAW} SELECT merchant_id, round(sum({_W} * (score - CASE WHEN label THEN 1 ELSE 0 END) ** 2) / sum({_W}), 9) AS brier FROM scored, raw GROUP BY 1")
def _brier(spark, sf_dir):
    df = CAL.prevalence_weights(scored(spark, sf_dir), 0.01)
    return CAL.brier(df, ["merchant_id"], weight=F.col("weight")).withColumn("brier", F.round("brier", 9))


_BINS = """
bins AS (SELECT merchant_id, least(CAST(trunc(least(greatest(score, 0), 1) * 20) AS INTEGER), 19) AS bin, CAST(count(*) AS DOUBLE) AS weight,
  avg(least(greatest(score, 0), 1)) AS mp, avg(CASE WHEN label THEN 1.0e0 ELSE 0 END) AS ob FROM scored GROUP BY 1, 2)
"""


@query(
    "reliability_bins",
    f"""WITH {ATTEMPTS_SQL}, {_SCORED}, {_BINS} SELECT m.merchant_id, CAST(i.range AS INTEGER) AS bin, coalesce(weight, 0e0) AS weight, round(mp, 9) AS mean_predicted, round(ob, 9) AS observed_rate
    FROM (SELECT DISTINCT merchant_id FROM scored) m CROSS JOIN range(20) i LEFT JOIN bins b ON b.merchant_id = m.merchant_id AND b.bin = i.range""",
)
def _reliability(spark, sf_dir):
    out = CAL.reliability_bins(scored(spark, sf_dir), 20, ["merchant_id"])
    return out.select("merchant_id", "bin", "weight", F.round("mean_predicted", 9).alias("mean_predicted"), F.round("observed_rate", 9).alias("observed_rate"))


@query("ece", f"WITH {ATTEMPTS_SQL}, {_SCORED}, {_BINS} SELECT merchant_id, round(sum(weight * abs(mp - ob)) / sum(weight), 9) AS ece FROM bins GROUP BY 1")
def _ece(spark, sf_dir):
    return CAL.ece(scored(spark, sf_dir), 20, ["merchant_id"]).withColumn("ece", F.round("ece", 9))


_LOGIT = "ln(least(greatest({p}, 1e-6), 1 - 1e-6) / (1 - least(greatest({p}, 1e-6), 1 - 1e-6)))"
CAL_SQL = f"""
z AS (SELECT label, 6 * score - 2 AS m FROM scored), raw AS (SELECT avg(CASE WHEN label THEN 1.0e0 ELSE 0 END) AS q FROM scored),
pl AS (SELECT label, 1 / (1 + exp(-m)) AS raw_p, 1 / (1 + exp(-(1.3 * m - 0.4))) AS platt FROM z),
lg AS (SELECT label, r.regime, r.pi, v.variant, CASE v.variant WHEN 'raw' THEN raw_p WHEN 'platt' THEN platt
    ELSE 1 / (1 + exp(-({_LOGIT.format(p='platt')} + ln(r.pi / (1 - r.pi)) - ln(0.6e0 / 0.4e0)))) END AS score,
  CASE WHEN label THEN r.pi / q ELSE (1 - r.pi) / (1 - q) END AS w
  FROM pl, raw, (VALUES ('pi0', 0.001e0), ('pi1', 0.9e0)) r(regime, pi), (VALUES ('raw'), ('platt'), ('platt_prior')) v(variant)),
bn AS (SELECT regime, variant, least(CAST(trunc(score * 10) AS INTEGER), 9) AS bin, sum(w) AS w, sum(w * w) AS w2, sum(w * score) AS p, sum(CASE WHEN label THEN w ELSE 0 END) AS y,
  sum(w * (score - CASE WHEN label THEN 1 ELSE 0 END) ** 2) AS se FROM lg GROUP BY 1, 2, 3),
block AS (SELECT regime, variant, sum(se) / sum(w) AS brier, sum(abs(p - y)) / sum(w) AS ece, sum(w) * sum(w) / sum(w2) AS effective_n FROM bn GROUP BY 1, 2)
"""


def _block(spark, sf_dir):
    return CAL.calibration_block(scored(spark, sf_dir).withColumn("margin", 6 * F.col("score") - 2), 1.3, -0.4, 0.6)


@query("calibration_block", f"WITH {ATTEMPTS_SQL}, {_SCORED}, {CAL_SQL} SELECT regime, variant, round(brier, 8) AS brier, round(ece, 8) AS ece, round(effective_n, 4) AS effective_n FROM block")
def _calibration(spark, sf_dir):
    return _block(spark, sf_dir).select("regime", "variant", F.round("brier", 8).alias("brier"), F.round("ece", 8).alias("ece"), F.round("effective_n", 4).alias("effective_n"))


@query(
    "prior_correction_effect",
    f"""WITH {ATTEMPTS_SQL}, {_SCORED}, {CAL_SQL} SELECT regime, round(max(CASE WHEN variant = 'platt' THEN ece END) - max(CASE WHEN variant = 'platt_prior' THEN ece END), 8) AS ece_gap,
    max(CASE WHEN variant = 'platt' THEN ece END) > max(CASE WHEN variant = 'platt_prior' THEN ece END) AS helped FROM block GROUP BY 1""",
)
def _effect(spark, sf_dir):
    return CAL.prior_correction_effect(_block(spark, sf_dir)).withColumn("ece_gap", F.round("ece_gap", 8))


# --- reports ----------------------------------------------------------------------------
# The whole feature vector, and a column that gives the label away.
_AUDIT_SQL = f"""
fv AS ({feature_sql()}),
feat AS (SELECT is_attack AS label, {', '.join(K.FEATURE_NAMES)}, CASE WHEN is_attack THEN 1.0e0 ELSE 0.0e0 END AS leak FROM fv JOIN attempts USING (attempt_uid)),
un AS (UNPIVOT feat ON {', '.join(K.FEATURE_NAMES)}, leak INTO NAME feature VALUE score),
{AUC_SQL.format(by='feature', src='un')},
audit AS (SELECT feature, (rs - p * (p + 1) / 2) / (CAST(p AS DOUBLE) * n) AS auc, n_values = 1 AS constant FROM auc)
"""


def _audit(spark, sf_dir):
    label = attempts(spark, sf_dir).select("attempt_uid", F.col("is_attack").alias("label"), F.col("is_attack").cast("double").alias("leak"))
    df = materialize(windows._features(spark, sf_dir).select("attempt_uid", *K.FEATURE_NAMES).join(label, "attempt_uid"), "audit")
    return REP.univariate_audit(df, [*K.FEATURE_NAMES, "leak"], excluded=K.EXCLUDED_FEATURES)


_EXCLUDED_SQL = "feature IN (" + ", ".join(f"'{name}'" for name in K.EXCLUDED_FEATURES) + ")"


@query(
    "univariate_audit",
    f"""WITH {ATTEMPTS_SQL}, {_AUDIT_SQL} SELECT feature, round(auc, 9) AS auc, constant, {_EXCLUDED_SQL} AS excluded, auc > 0.95 AND NOT constant AS flagged, auc > 0.95 AND NOT constant AND NOT {_EXCLUDED_SQL} AS newly_flagged FROM audit""",
)
def _audit_query(spark, sf_dir):
    return _audit(spark, sf_dir).withColumn("auc", F.round("auc", 9))


@query(
    "two_sided_separability",
    f"""WITH {ATTEMPTS_SQL}, {_AUDIT_SQL} SELECT feature, round(abs(auc - 0.5), 9) AS separability, CASE WHEN constant THEN NULL WHEN auc < 0.5 THEN 'inverted' ELSE 'positive' END AS direction,
    NOT constant AND abs(auc - 0.5) >= 0.45 AS flagged_two_sided FROM audit""",
)
def _separability(spark, sf_dir):
    out = REP.two_sided_separability(_audit(spark, sf_dir))
    return out.select("feature", F.round("separability", 9).alias("separability"), "direction", "flagged_two_sided")


def _metric_sql(by: str, src: str) -> str:
    """Metrics per group, each from its textbook definition."""
    return f"""
mt_r AS (SELECT *, row_number() OVER w AS r, sum(CASE WHEN label THEN 1 ELSE 0 END) OVER w AS tp, count(*) FILTER (label) OVER (PARTITION BY {by}) AS p,
  count(*) FILTER (NOT label) OVER (PARTITION BY {by}) AS n, (rank() OVER a + rank() OVER a + count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0e0 AS mr,
  sum(CASE WHEN label THEN 1 ELSE 0 END) OVER g AS tp_all, sum(CASE WHEN label THEN 0 ELSE 1 END) OVER g AS fp_all
  FROM {src} WINDOW w AS (PARTITION BY {by} ORDER BY score DESC, ordinal), a AS (PARTITION BY {by} ORDER BY score), g AS (PARTITION BY {by} ORDER BY score DESC)),
mt AS (SELECT {by}, count(*) AS n, count(*) FILTER (label) AS n_positive, round(count(*) FILTER (label) / count(*), 9) AS prevalence,
  CASE WHEN count(DISTINCT score) > 1 AND max(p) > 0 AND max(n) > 0 THEN round(coalesce(max(CASE WHEN fp_all / n <= 0.001 THEN tp_all END), 0) / max(p), 9) END AS recall,
  CASE WHEN max(p) > 0 AND max(n) > 0 THEN max(n) >= 1000 END AS resolvable,
  CASE WHEN max(p) > 0 AND max(n) > 0 THEN round(sum(CASE WHEN label THEN tp / r END) / max(p), 9) END AS ap,
  CASE WHEN max(p) > 0 AND max(n) > 0 THEN round(sum(CASE WHEN label THEN 0.01e0 * (tp / p) / (0.01e0 * (tp / p) + 0.99e0 * ((r - tp) / n)) END) / max(p), 9) END AS ap_at_prevalence,
  CASE WHEN max(p) > 0 AND max(n) > 0 THEN round((sum(CASE WHEN label THEN mr ELSE 0 END) - max(p) * (max(p) + 1) / 2) / (CAST(max(p) AS DOUBLE) * max(n)), 9) END AS auc
  FROM mt_r GROUP BY {by})
"""


_ROUNDED = ("prevalence", "recall", "ap", "ap_at_prevalence", "auc")
_SCORERS_SQL = "(VALUES ('model'), ('coarse'), ('perfect'), ('inverted'), ('always_positive'), ('random')) v(scorer)"
_PICK = "CASE scorer WHEN 'model' THEN score WHEN 'coarse' THEN round(score * 8) / 8 WHEN 'perfect' THEN CASE WHEN is_attack THEN 1.0e0 ELSE 0 END WHEN 'inverted' THEN CASE WHEN is_attack THEN 0.0e0 ELSE 1 END WHEN 'random' THEN " + _RANDOM + " ELSE 1.0e0 END"


def _scorers():
    return {"model": F.col("score"), "coarse": F.round(F.col("score") * 8) / 8, **S.sanity_scorers(F.col("is_attack"), [F.col("seq")])}


@query(
    "evaluate_all",
    f"""WITH {SAMPLES_SQL}, {_split_sql('samples', 0.7, HORIZON, ('temporal_train', 'temporal_test'), 'cut1')},
    long AS (SELECT split, scorer, {_PICK} AS score, is_attack AS label, seq AS ordinal FROM cut1, {_SCORERS_SQL}), {_metric_sql('split, scorer', 'long')},
    spots AS (
      SELECT split, scorer, CASE WHEN n > 0 THEN fp_all / n WHEN tp_all > 0 THEN 1 ELSE 0 END AS fpr, CASE WHEN p > 0 THEN tp_all / p WHEN fp_all > 0 THEN 1 ELSE 0 END AS tpr FROM mt_r
      UNION ALL SELECT DISTINCT split, scorer, 0, 0 FROM mt_r),
    costs AS (SELECT split, scorer, round(min({_cost('0.001e0')}), 4) AS min_cost_pi0, round(min({_cost('0.9e0')}), 4) AS min_cost_pi1 FROM spots GROUP BY 1, 2)
    SELECT * FROM mt JOIN costs USING (split, scorer)""",
)
def _evaluate(spark, sf_dir):
    split = S.temporal_split(samples(spark, sf_dir), 0.7, HORIZON, ("temporal_train", "temporal_test"))
    rows = split.withColumns({"label": F.col("is_attack"), "ordinal": F.col("seq")})
    long = REP.score_long(rows, _scorers(), ["split", "label", "ordinal"])
    out = REP.evaluate_all(long)
    return out.withColumns({**{c: F.round(c, 9) for c in _ROUNDED}, **{c: F.round(c, 4) for c in ("min_cost_pi0", "min_cost_pi1")}})


def _tiers(spark, sf_dir):
    rows = overlapped(spark, sf_dir).withColumns({"label": F.col("is_attack"), "ordinal": F.col("seq")})
    long = REP.score_long(rows, {"model": F.col("score"), "b0": F.round(F.col("score") * 8) / 8}, ["stream_tier", "entity_overlap", "label", "ordinal"])
    return REP.tier_breakdown(long)


TIER_SQL = f"""
long AS (
  SELECT scorer, stream_tier AS tier, CASE scorer WHEN 'model' THEN score ELSE round(score * 8) / 8 END AS score, is_attack AS label, seq AS ordinal
  FROM flagged, (VALUES ('model'), ('b0')) v(scorer) WHERE stream_tier IS NOT NULL
  UNION ALL SELECT scorer, 'clean', CASE scorer WHEN 'model' THEN score ELSE round(score * 8) / 8 END, is_attack, seq
  FROM flagged, (VALUES ('model'), ('b0')) v(scorer) WHERE is_attack OR NOT entity_overlap),
{_metric_sql('scorer, tier', 'long')}
"""


@query("tier_breakdown", f"WITH {SAMPLES_SQL}, {OVERLAP_SQL}, {TIER_SQL} SELECT * FROM mt")
def _breakdown(spark, sf_dir):
    return _tiers(spark, sf_dir).withColumns({c: F.round(c, 9) for c in _ROUNDED})


@query(
    "model_vs_rules_winner",
    f"""WITH {SAMPLES_SQL}, {OVERLAP_SQL}, {TIER_SQL}, x AS (SELECT tier, max(CASE WHEN scorer = 'model' THEN ap END) AS m, max(CASE WHEN scorer = 'b0' THEN ap END) AS r FROM mt GROUP BY 1)
    SELECT tier, CASE WHEN m > r THEN 'model' WHEN m < r THEN 'b0' WHEN m = r THEN 'tie' END AS winner FROM x""",
)
def _winner(spark, sf_dir):
    metrics = _tiers(spark, sf_dir).withColumn("ap", F.round("ap", 9))
    return REP.model_vs_rules_winner(metrics).select("tier", "winner")


@query(
    "seed_summary",
    f"""WITH {ATTEMPTS_SQL}, {_SCORED}, s AS (SELECT merchant_id, user_id, CASE WHEN count(*) FILTER (score >= 0.2) > 0 THEN round(avg(score), 9) END AS v FROM scored GROUP BY 1, 2)
    SELECT merchant_id, min(v) AS low, round(median(v), 8) AS median, max(v) AS high, count(v) AS n_seeds FROM s WHERE v IS NOT NULL GROUP BY 1""",
)
def _seeds(spark, sf_dir):
    runs = scored(spark, sf_dir).groupBy("merchant_id", "user_id").agg(
        F.when(F.max("score") >= 0.2, F.round(F.avg("score"), 9)).alias("value")
    )
    return REP.seed_summary(runs, ["merchant_id"]).withColumn("median", F.round("median", 8))


@query(
    "negative_control_fp",
    f"""WITH {SAMPLES_SQL}, e AS (SELECT scenario, coalesce(episode_id, event_id) AS ep, count(*) AS n, count(*) FILTER (score >= 0.2) AS h FROM samples WHERE kind = 'negative_control' AND NOT is_attack GROUP BY 1, 2)
    SELECT scenario, count(*) FILTER (h > 0) AS episode_fp, count(*) AS episodes, CAST(sum(h) AS BIGINT) AS attempt_fp, CAST(sum(n) AS BIGINT) AS attempts, round(sum(h) / sum(n), 9) AS rate, sum(n) < 30 AS underpowered FROM e GROUP BY 1""",
)
def _control_fp(spark, sf_dir):
    return REP.negative_control_fp(samples(spark, sf_dir), 0.2).withColumn("rate", F.round("rate", 9))


@query(
    "baseline_summary",
    f"""WITH {SAMPLES_SQL}, {B1_SQL},
    sc AS (SELECT s.*, CASE WHEN visible_declines >= 2 THEN 1.0e0 ELSE 0 END AS b1,
      CASE WHEN count(DISTINCT card_hash) OVER (PARTITION BY bin ORDER BY ingest_ms RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND CURRENT ROW) >= 7 THEN 1.0e0 ELSE 0 END AS b2 FROM samples s JOIN b1 USING (attempt_uid)),
    ln AS (SELECT is_attack AS label, stream_tier, scorer, CASE scorer WHEN 'b1' THEN b1 WHEN 'b2' THEN b2 ELSE score END AS score, CASE scorer WHEN 'model' THEN 0.25 ELSE 0.5 END AS theta
      FROM sc, (VALUES ('b1'), ('b2'), ('model')) v(scorer)),
    al AS (SELECT *, 'overall' AS tier FROM ln UNION ALL SELECT *, stream_tier FROM ln WHERE stream_tier IS NOT NULL)
    SELECT scorer, tier, count(*) FILTER (score >= theta AND label) AS tp, count(*) FILTER (score >= theta AND NOT label) AS fp, count(*) FILTER (score < theta AND NOT label) AS tn, count(*) FILTER (score < theta AND label) AS fn FROM al GROUP BY 1, 2""",
)
def _baselines(spark, sf_dir):
    rows = S.b2_bin_concentration(S.b1_decline_velocity(samples(spark, sf_dir), 2, 3 * DAY), 7, 6 * HOUR).withColumn("model", F.col("score"))
    out = REP.baseline_summary(rows, {"b1": 0.5, "b2": 0.5, "model": 0.25})
    return out.select("scorer", "tier", "tp", "fp", "tn", "fn")


@query(
    "detection_headline",
    f"""{cases.BASE}, {cases.HIST_SQL}, d AS (SELECT i.entity_type AS tier, attempts_before AS a, cards_before AS c, (opened_at - first_seen) / 1000.0e0 AS s FROM inc i JOIN h ON h.attempt_uid = open_uid)
    SELECT tier, count(*) AS incidents, round(quantile_cont(CAST(a AS DOUBLE), 0.5), 6) AS attempts_median, round(quantile_cont(CAST(a AS DOUBLE), 0.9), 6) AS attempts_p90,
      round(quantile_cont(CAST(c AS DOUBLE), 0.5), 6) AS cards_median, round(quantile_cont(CAST(c AS DOUBLE), 0.9), 6) AS cards_p90, round(quantile_cont(s, 0.5), 3) AS seconds_median, round(quantile_cont(s, 0.9), 3) AS seconds_p90 FROM d GROUP BY 1""",
)
def _headline(spark, sf_dir):
    rows = detectors.entity_history(cases.evidence(spark, sf_dir), I.ENTITY)
    table_ = I.incident_metrics(I.incident_sessions(rows, cases.COOL).filter(F.col("incident_id").isNotNull()))
    out = REP.detection_headline(table_.withColumn("tier", F.col("entity_type")))
    digits = {c: F.round(c, 3 if c.startswith("seconds") else 6) for c in out.columns if c not in ("tier", "incidents")}
    return out.withColumns(digits)


@query(
    "attack_yield",
    f"""{cases.BASE}, {cases.HIST_SQL}, r AS (SELECT a.episode_id, a.score, a.card_hash, s.incident_id, s.opens, s.ingest_ms, h.cards_before FROM attempts a JOIN sess s USING (attempt_uid) JOIN h USING (attempt_uid) WHERE a.is_attack)
    SELECT episode_id, count(*) AS attempts_total, round(avg(score), 9) AS mean_score, count(DISTINCT card_hash) AS cards, bool_or(incident_id IS NOT NULL) AS incident_opened,
      arg_min(cards_before, ingest_ms) FILTER (opens) AS cards_exposed_before_alert FROM r GROUP BY 1""",
)
def _yield(spark, sf_dir):
    rows = I.incident_sessions(detectors.entity_history(cases.evidence(spark, sf_dir), I.ENTITY), cases.COOL)
    truth = attempts(spark, sf_dir).filter("is_attack").select("attempt_uid", "episode_id")
    return REP.attack_yield(rows.join(truth, "attempt_uid")).withColumn("mean_score", F.round("mean_score", 9))


@query(
    "metric_availability",
    f"""WITH {SAMPLES_SQL}, long AS (SELECT scenario AS g, score, is_attack AS label, seq AS ordinal FROM samples UNION ALL SELECT stream_tier, 1.0e0, is_attack, seq FROM samples), {_metric_sql('g', 'long')}
    SELECT g, CASE WHEN resolvable IS NULL THEN 'unspecified' WHEN NOT resolvable THEN 'unresolvable' WHEN recall IS NULL THEN 'unreachable' END AS reason, coalesce(resolvable AND recall IS NOT NULL, false) AS is_available FROM mt""",
)
def _availability(spark, sf_dir):
    base = samples(spark, sf_dir).withColumns({"label": F.col("is_attack"), "ordinal": F.col("seq")})
    long = base.select(F.col("scenario").alias("g"), "score", "label", "ordinal").unionByName(
        base.select(F.col("stream_tier").alias("g"), F.lit(1.0).alias("score"), "label", "ordinal")
    ).withColumn("g", F.coalesce("g", F.lit("")))
    rows = R.recall_at_fpr(long, K.COST_MODEL["target_fpr"], ["g"])
    shaped = rows.select(
        F.nullif("g", F.lit("")).alias("g"), F.when(F.col("resolvable").isNull(), "number").otherwise("recall").alias("kind"),
        "value", "resolvable", F.lit(None).cast("boolean").alias("available"), F.lit(None).cast("string").alias("given_reason"),
    )
    return REP.metric_availability(shaped).select("g", "reason", "is_available")


@query("decision_histogram", f"{cases.DECIDED} SELECT in_force_tier AS decision, 'in_control' AS regime, control AS control_arm, count(*) AS n FROM decided GROUP BY ALL")
def _histogram(spark, sf_dir):
    rows = cases.resolved(spark, sf_dir).select(F.col("in_force_tier").alias("decision"), F.lit("in_control").alias("regime"), "control_arm")
    return REP.decision_histogram(rows)
