"""Registered queries: sources, table maintenance, outcomes checks, integrity and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.operators import quality as Q, tables as TB
from riskloom.plans import cases
from riskloom.plans.registry import query, table
from riskloom.plans.views import ATTEMPTS_SQL, EPISODES_SQL, attempts, episodes
from riskloom.session import scratch_path
from riskloom.sources import attempts as SRC

# Some rows break the contract on purpose.
_BROKEN_SQL = """
broken AS (
  SELECT attempt_uid, seq, CASE WHEN k = 11 THEN '' ELSE event_id END AS event_id, CASE WHEN k = 22 THEN NULL ELSE card_hash END AS card_hash,
    CASE WHEN k = 33 THEN '' ELSE bin END AS bin, CASE WHEN k = 44 THEN -amount_minor - 1 ELSE amount_minor END AS amount_minor,
    CASE WHEN k = 55 THEN NULL ELSE currency END AS currency FROM attempts)
"""


def broken(spark, sf_dir):
    k = F.col("k")
    return attempts(spark, sf_dir).withColumns(
        {
            "event_id": F.when(k == 11, "").otherwise(F.col("event_id")),
            "card_hash": F.when(k != 22, F.col("card_hash")),
            "bin": F.when(k == 33, "").otherwise(F.col("bin")),
            "amount_minor": F.when(k == 44, -F.col("amount_minor") - 1).otherwise(F.col("amount_minor")),
            "currency": F.when(k != 55, F.col("currency")),
        }
    )


_REASON_SQL = """CASE WHEN event_id IS NULL OR event_id = '' THEN 'empty event_id' WHEN card_hash IS NULL OR card_hash = '' THEN 'empty card_hash' WHEN bin = '' THEN 'empty bin'
  WHEN currency IS NULL THEN 'empty currency' WHEN amount_minor < 0 THEN 'negative amount_minor' END"""


@query("validate_attempts", f"WITH {ATTEMPTS_SQL}, {_BROKEN_SQL} SELECT attempt_uid, {_REASON_SQL} AS reject_reason FROM broken")
def _validate(spark, sf_dir):
    return SRC.validate_attempts(broken(spark, sf_dir)).select("attempt_uid", "reject_reason")


@query(
    "read_attempts",
    f"WITH {ATTEMPTS_SQL}, {_BROKEN_SQL} SELECT b.seq, b.card_hash, b.amount_minor, a.last4, a.exp_month, a.ingest_ms, {_REASON_SQL} AS reject_reason FROM broken b JOIN (SELECT seq, last4, exp_month, ingest_ms FROM attempts) a USING (seq) WHERE b.seq % 101 <> 7",
)
def _read(spark, sf_dir):
    """Written as JSON lines with an unknown field and some torn lines, then read back with the explicit schema."""
    path = scratch_path(spark, "attempts-json")
    line = F.to_json(F.struct(*[f.name for f in SRC.ATTEMPT_SCHEMA.fields], F.lit("x").alias("unknown_field")))
    torn = F.substring(line, 1, 40)
    rows = broken(spark, sf_dir)
    rows.select(F.when(F.col("seq") % 101 == 7, torn).otherwise(line).alias("value")).write.text(path)
    checked = SRC.validate_attempts(SRC.read_attempts(spark, path, "json"))
    good = checked.filter(~F.coalesce(F.col("reject_reason") == "unreadable", F.lit(False)))
    return good.select("seq", "card_hash", "amount_minor", "last4", "exp_month", "ingest_ms", "reject_reason")


def envelopes(spark, sf_dir) -> DataFrame:
    """Spool lines of the scored attempts; every 13th is delivered twice and some lines are torn."""
    rows = cases.sessions(spark, sf_dir)
    live = F.col("incident_id").isNotNull()
    payload = F.struct(
        F.struct(F.col("attempt_uid").cast("string").alias("attempt_uid"), "merchant_id", "card_hash", "bin", F.col("ingest_ms").alias("ingest_time")).alias("attempt"),
        F.struct(F.col("attempt_uid").cast("string").alias("attempt_uid"), F.col("score").alias("score_raw"), "incident_id").alias("score"),
        F.when(live, F.struct("incident_id", "merchant_id", F.col("last_fire_ms").alias("opened_at"))).alias("incident"),
        F.when(live, F.array(F.struct("incident_id", "entity_type", "entity_key", F.col("ingest_ms").alias("last_seen")))).alias("incident_entity"),
        F.when(F.col("opens") & live, F.array(F.struct(F.concat(F.lit("T"), "incident_id").alias("transition_id"), "incident_id"))).alias("tier_transition"),
    )
    line = F.to_json(F.struct(F.col("attempt_uid").cast("string").alias("attempt_uid"), payload.alias("payload")))
    text = F.when(F.col("seq") % 97 == 5, F.substring(line, 1, 60)).otherwise(line)
    copies = F.when(F.col("seq") % 13 == 0, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(F.col("seq"), text.alias("value"), F.explode(copies).alias("copy")).select((F.col("seq") * 2 + F.col("copy")).alias("seq"), "value")


_KEPT = "kept AS (SELECT * FROM sess WHERE seq % 97 <> 5)"


@query(
    "route_envelopes",
    f"""{cases.BASE}, {_KEPT}, n AS (SELECT *, CASE WHEN seq % 13 = 0 THEN 2 ELSE 1 END AS c FROM kept)
    SELECT 'attempt' AS "table", CAST(sum(c) AS BIGINT) AS n FROM n UNION ALL SELECT 'score', CAST(sum(c) AS BIGINT) FROM n
    UNION ALL SELECT 'incident', CAST(sum(c) AS BIGINT) FROM n WHERE inside UNION ALL SELECT 'entity', CAST(sum(c) AS BIGINT) FROM n WHERE inside
    UNION ALL SELECT 'transition', CAST(sum(c) AS BIGINT) FROM n WHERE opens AND inside UNION ALL SELECT 'enforcement', 0 UNION ALL SELECT 'narrator_call', 0""",
)
def _route(spark, sf_dir):
    routed = SRC.route_envelopes(envelopes(spark, sf_dir))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in routed.items()]
    return reduce(DataFrame.unionByName, counts)


@query(
    "write_tables",
    f"WITH {ATTEMPTS_SQL} SELECT merchant_id, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS amount FROM attempts GROUP BY 1",
)
def _write(spark, sf_dir):
    path = scratch_path(spark, "tables")
    SRC.write_tables(attempts(spark, sf_dir).select("merchant_id", "seq", "amount_minor"), path, partition_by=["merchant_id"])
    return spark.read.parquet(path).groupBy(F.col("merchant_id").cast("string").alias("merchant_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("amount")
    )


# --- table maintenance ------------------------------------------------------------------
@query(
    "insert_first_wins",
    f"""WITH {ATTEMPTS_SQL}, old AS (SELECT user_id, k, seq, amount_minor, row_number() OVER (PARTITION BY user_id, k ORDER BY seq) AS r FROM attempts WHERE seq % 3 = 0),
    nw AS (SELECT user_id, k, seq, amount_minor, row_number() OVER (PARTITION BY user_id, k ORDER BY seq) AS r FROM attempts WHERE seq % 3 <> 0)
    SELECT user_id, k, seq, amount_minor FROM old WHERE r = 1 UNION ALL
    SELECT user_id, k, seq, amount_minor FROM nw WHERE r = 1 AND (user_id, k) NOT IN (SELECT (user_id, k) FROM old)""",
)
def _first(spark, sf_dir):
    rows = attempts(spark, sf_dir).select("user_id", "k", "seq", "amount_minor")
    empty = rows.limit(0)
    old = TB.insert_first_wins(empty, rows.filter("seq % 3 = 0"), ["user_id", "k"], ["seq"])
    return TB.insert_first_wins(old, rows.filter("seq % 3 <> 0"), ["user_id", "k"], ["seq"])


@query(
    "upsert_last_wins",
    f"""WITH {ATTEMPTS_SQL}, old AS (SELECT user_id, k, max(seq) AS seq, arg_max(amount_minor, seq) AS amount_minor FROM attempts WHERE seq % 3 <> 0 GROUP BY 1, 2),
    nw AS (SELECT user_id, k, max(seq) AS seq, arg_max(amount_minor, seq) AS amount_minor FROM attempts WHERE seq % 3 = 0 GROUP BY 1, 2)
    SELECT * FROM nw UNION ALL SELECT * FROM old WHERE (user_id, k) NOT IN (SELECT (user_id, k) FROM nw)""",
)
def _last(spark, sf_dir):
    rows = attempts(spark, sf_dir).select("user_id", "k", "seq", "amount_minor")
    old = TB.upsert_last_wins(rows.limit(0), rows.filter("seq % 3 <> 0"), ["user_id", "k"], ["seq"])
    return TB.upsert_last_wins(old, rows.filter("seq % 3 = 0"), ["user_id", "k"], ["seq"])


_VERSION_SQL = """
v AS (SELECT 'm' || c_nationkey AS merchant_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment = 'BUILDING', c_custkey) AS INTEGER) AS version, c_acctbal AS cusum_h FROM customer)
"""


def _versions(spark, sf_dir):
    """Customers as successive policy settings of their nation's merchant, appended in two batches."""
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("m"), "c_nationkey").alias("merchant_id"), F.col("c_acctbal").alias("cusum_h"), "c_custkey", (F.col("c_mktsegment") == "BUILDING").alias("late")
    )
    empty = spark.createDataFrame([], "merchant_id string, version int, cusum_h double")
    first = TB.append_version(empty, rows.filter(~F.col("late")), ["c_custkey"])
    return TB.append_version(first, rows.filter("late"), ["c_custkey"])


@query("append_version", f"WITH {_VERSION_SQL} SELECT * FROM v")
def _append(spark, sf_dir):
    return _versions(spark, sf_dir)


@query("latest_version", f"WITH {_VERSION_SQL} SELECT merchant_id, max(version) AS version, arg_max(cusum_h, version) AS cusum_h FROM v GROUP BY 1")
def _latest(spark, sf_dir):
    return TB.latest_version(_versions(spark, sf_dir)).select("merchant_id", "version", "cusum_h")


@query(
    "pinned_version",
    f"WITH {ATTEMPTS_SQL}, {_VERSION_SQL}, p AS (SELECT attempt_uid, 'm' || (user_id % 25) AS merchant_id, k % 5 + 1 AS pin FROM attempts) SELECT attempt_uid, p.merchant_id, cusum_h FROM p JOIN v ON v.merchant_id = p.merchant_id AND v.version = p.pin",
)
def _pinned(spark, sf_dir):
    rows = attempts(spark, sf_dir).select(
        "attempt_uid", F.concat(F.lit("m"), F.col("user_id") % 25).alias("merchant_id"), (F.col("k") % 5 + 1).alias("pinned_policy_version")
    )
    return TB.pinned_version(rows, _versions(spark, sf_dir)).select("attempt_uid", "merchant_id", "cusum_h")


@query(
    "load_truth",
    f"""WITH {ATTEMPTS_SQL}, u AS (SELECT merchant_id, event_id FROM attempts WHERE k % 4 <> 1 GROUP BY ALL), j AS (SELECT a.merchant_id, u.event_id IS NOT NULL AS f FROM attempts a LEFT JOIN u USING (merchant_id, event_id))
    SELECT merchant_id, count(*) FILTER (f) AS labels_written, count(*) FILTER (NOT f) AS labels_skipped_no_attempt FROM j GROUP BY 1""",
)
def _truth(spark, sf_dir):
    return _labels(spark, sf_dir)[1]


def _labels(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    labels = rows.select("merchant_id", "event_id", "is_attack", "episode_id")
    return TB.load_truth(labels, rows.filter("k % 4 <> 1"))


@query(
    "load_truth_labels",
    f"""WITH {ATTEMPTS_SQL}, u AS (SELECT merchant_id, event_id, arg_min(attempt_uid, seq) AS attempt_uid FROM attempts WHERE k % 4 <> 1 GROUP BY ALL)
    SELECT a.merchant_id, event_id, is_attack, episode_id, u.attempt_uid FROM attempts a JOIN u USING (merchant_id, event_id)""",
)
def _truth_labels(spark, sf_dir):
    return _labels(spark, sf_dir)[0]


@query(
    "load_feature_corpus",
    f"WITH {ATTEMPTS_SQL} SELECT attempt_uid, score AS score_raw, CAST(k AS DOUBLE) AS attempts_per_ip_60s, CAST(k + 23 AS DOUBLE) AS clock_skew_s FROM attempts WHERE k % 7 <> 0",
)
def _corpus(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    snapshot = F.to_json(F.create_map(*[x for i, n in enumerate(K.FEATURE_NAMES) for x in (F.lit(n), (F.col("k") + i).cast("string"))], F.lit("trusted"), F.lit("true")))
    scores = rows.filter("k % 7 <> 0").select("attempt_uid", F.col("score").alias("score_raw"), snapshot.alias("feature_snapshot"))
    out = TB.load_feature_corpus(rows.select("attempt_uid", "merchant_id", "event_id"), scores)
    return out.select("attempt_uid", "score_raw", "attempts_per_ip_60s", "clock_skew_s")


# --- integrity --------------------------------------------------------------------------
@query(
    "check_constraints",
    f"""WITH {ATTEMPTS_SQL}, {EPISODES_SQL}, v AS (
      SELECT 'attempts' AS "table", 'not null' AS rule, 'card_hash' AS "column", CAST(attempt_uid AS VARCHAR) AS key FROM attempts WHERE k = 22
      UNION ALL SELECT 'labels', 'references attempts', 'attempt_uid', CAST(attempt_uid + 1000000000 AS VARCHAR) FROM attempts WHERE k = 44
      UNION ALL SELECT 'labels', 'references episodes', 'episode_id', a.episode_id FROM attempts a WHERE a.episode_id LIKE 'ep%' AND a.k <> 44
      UNION ALL SELECT 'labels', 'references episodes', 'episode_id', a.episode_id FROM attempts a WHERE a.episode_id LIKE 'ep%' AND a.k = 44
      UNION ALL SELECT 'episodes', 'vocabulary', 'scenario', episode_id FROM episodes WHERE scenario = 'cgnat'
      UNION ALL SELECT 'scores', 'primary key', 'attempt_uid', CAST(attempt_uid AS VARCHAR) FROM attempts WHERE k = 66)
    SELECT "table", rule, "column", key, count(*) AS n FROM v GROUP BY ALL""",
)
def _constraints(spark, sf_dir):
    """Tables with planted faults: a null card, orphaned labels and episodes, an unknown scenario, a double score."""
    rows = attempts(spark, sf_dir)
    bad = rows.withColumn("card_hash", F.when(F.col("k") != 22, F.col("card_hash"))).select("attempt_uid", "merchant_id", "ingest_ms", "card_hash", "bin", "amount_minor", "currency")
    truth = episodes(rows).withColumn("scenario", F.when(F.col("scenario") == "cgnat", "unknown").otherwise(F.col("scenario")))
    labels = rows.select(F.when(F.col("k") == 44, F.col("attempt_uid") + 1_000_000_000).otherwise(F.col("attempt_uid")).alias("attempt_uid"), "is_attack", "episode_id")
    doubled = F.when(F.col("k") == 66, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    scores = rows.select("attempt_uid", F.col("score").alias("score_raw"), F.explode(doubled).alias("_x")).drop("_x")
    # Attack episodes are withheld, so labels on them have nothing to refer to.
    found = Q.check_constraints({"attempts": bad, "episodes": truth.filter("kind = 'negative_control'"), "labels": labels, "scores": scores})
    return found.groupBy("table", "rule", "column", "key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "score_parity",
    f"""WITH {ATTEMPTS_SQL}, s AS (SELECT CASE WHEN k = 77 THEN attempt_uid + 1000000000 ELSE attempt_uid END AS attempt_uid, merchant_id AS run FROM attempts WHERE k <> 5 OR merchant_id = 'm1')
    SELECT coalesce(a.merchant_id, s.run) AS run, count(a.merchant_id) AS attempts, count(s.run) AS scores, count(*) FILTER (s.run IS NULL) AS unscored, count(*) FILTER (a.merchant_id IS NULL) AS orphans,
      count(*) FILTER (s.run IS NULL OR a.merchant_id IS NULL) = 0 AS parity FROM attempts a FULL JOIN s USING (attempt_uid) GROUP BY 1""",
)
def _parity(spark, sf_dir):
    rows = attempts(spark, sf_dir).withColumn("run", F.col("merchant_id"))
    scores = rows.filter("k <> 5 OR merchant_id = 'm1'").select(
        F.when(F.col("k") == 77, F.col("attempt_uid") + 1_000_000_000).otherwise(F.col("attempt_uid")).alias("attempt_uid"), "run"
    )
    return Q.score_parity(rows, scores)


@query(
    "frame_diff",
    f"""WITH {ATTEMPTS_SQL}, o AS (SELECT merchant_id || '.' || bin || '.avg' AS path, avg(score) AS v FROM attempts WHERE k <> 99 AND bin <> 'b8' GROUP BY 1),
    n AS (SELECT merchant_id || '.' || bin || '.avg' AS path, avg(score) AS v FROM attempts WHERE bin <> 'b1' GROUP BY 1)
    SELECT path, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN o.v IS NOT NULL AND n.v IS NOT NULL THEN round(abs(o.v - n.v), 9) END AS abs_delta
    FROM o FULL JOIN n USING (path) WHERE NOT path LIKE 'm3.%' AND (o.v IS NULL OR n.v IS NULL OR abs(o.v - n.v) > greatest(1e-12, 1e-9 * greatest(abs(o.v), abs(n.v))))""",
)
def _diff(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    path = F.concat_ws(".", "merchant_id", "bin", F.lit("avg")).alias("path")
    leaf = lambda df: df.groupBy(path).agg(F.avg("score").alias("value"), F.lit(None).cast("string").alias("text"))
    old, new = leaf(rows.filter("k <> 99 AND bin <> 'b8'")), leaf(rows.filter("bin <> 'b1'"))
    out = Q.frame_diff(old, new, ignore=["m3"], atol=1e-12, rtol=1e-9)
    return out.select("path", "change", F.round("abs_delta", 9).alias("abs_delta"))


@query("table_fingerprint")
def _fingerprint(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    return Q.table_fingerprint(rows, "attempts").unionByName(Q.table_fingerprint(episodes(rows), "episodes"))
