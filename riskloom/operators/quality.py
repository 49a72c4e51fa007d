"""Integrity checks and reconciliation between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K

# fixed values: the table contract. table -> primary key, required columns, vocabularies, references
PRIMARY_KEYS = {
    "attempts": ["attempt_uid"],
    "scores": ["attempt_uid"],
    "outcomes": ["attempt_uid"],
    "incidents": ["incident_id"],
    "entities": ["incident_id", "entity_type", "entity_key"],
    "transitions": ["transition_id"],
    "actions": ["action_id"],
    "narrator_calls": ["call_id"],
    "episodes": ["episode_id"],
    "labels": ["attempt_uid"],
    "policy": ["merchant_id", "version"],
}
REQUIRED = {
    "attempts": ["merchant_id", "payload_digest", "ingest_ms", "card_hash", "bin", "amount_minor", "currency"],
    "scores": ["score_raw", "score_calibrated", "prior_used", "regime", "decision", "tier_ladder", "model_version", "policy_version", "latency_ms", "scored_at"],
    "outcomes": ["gateway_status", "reached_gateway", "sig_verified", "ingest_time"],
    "incidents": ["merchant_id", "state", "detector", "opened_at", "peak_tier", "pinned_policy_version"],
    "entities": ["pseudonym", "first_seen", "last_seen"],
    "transitions": ["incident_id", "to_tier", "trigger", "at"],
    "actions": ["merchant_id", "tier", "expires_at", "applied_by"],
    "narrator_calls": ["incident_id", "backend", "requested_at", "status"],
    "episodes": ["kind", "started_at", "ended_at", "attempt_count", "distinct_cards"],
    "labels": ["is_attack", "source"],
}
VOCABULARIES = {
    ("entities", "entity_type"): K.ENTITY_TYPES,
    ("actions", "entity_type"): K.ENTITY_TYPES,
    ("episodes", "scenario"): K.SCENARIOS,
}
NON_EMPTY = [("entities", "entity_key"), ("actions", "entity_key")]
REFERENCES = [
    ("scores", "attempt_uid", "attempts", "attempt_uid"),
    ("scores", "incident_id", "incidents", "incident_id"),
    ("outcomes", "attempt_uid", "attempts", "attempt_uid"),
    ("entities", "incident_id", "incidents", "incident_id"),
    ("transitions", "incident_id", "incidents", "incident_id"),
    ("actions", "incident_id", "incidents", "incident_id"),
    ("narrator_calls", "incident_id", "incidents", "incident_id"),
    ("labels", "attempt_uid", "attempts", "attempt_uid"),
    ("labels", "episode_id", "episodes", "episode_id"),
]


def _violations(rows: DataFrame, table: str, rule: str, column: str, key: Column) -> DataFrame:
    return rows.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.lit(column).alias("column"), key.cast("string").alias("key"))


def check_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per violation of a key, required column, vocabulary or reference. Absent tables and columns are skipped."""
    found = []
    for name, df in tables.items():
        keys = PRIMARY_KEYS.get(name, [])
        if keys and set(keys) <= set(df.columns):
            key = F.concat_ws("|", *keys)
            repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
            found.append(_violations(repeated, name, "primary key", ",".join(keys), key))
            required = [c for c in [*keys, *REQUIRED.get(name, [])] if c in df.columns]
            missing = F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required])))
            nulls = df.select(key.alias("_key"), missing.alias("_column"))
            found.append(nulls.select(F.lit(name).alias("table"), F.lit("not null").alias("rule"), F.col("_column").alias("column"), F.col("_key").alias("key")))
        for (table, column), words in VOCABULARIES.items():
            if table == name and column in df.columns:
                found.append(_violations(df.filter(~F.col(column).isin(*words)), name, "vocabulary", column, F.concat_ws("|", *keys)))
        for table, column in NON_EMPTY:
            if table == name and column in df.columns:
                found.append(_violations(df.filter(F.length(column) == 0), name, "not empty", column, F.concat_ws("|", *keys)))
    for child, column, parent, target in REFERENCES:
        if child in tables and parent in tables and column in tables[child].columns:
            known = tables[parent].select(F.col(target).alias(column))
            orphans = tables[child].filter(F.col(column).isNotNull()).join(known, column, "left_anti")
            found.append(_violations(orphans, child, f"references {parent}", column, F.col(column)))
    return reduce(DataFrame.unionByName, found)


def score_parity(attempts: DataFrame, scores: DataFrame, run: str = "run") -> DataFrame:
    """Per run: attempts, scores, attempts without a score, scores without an attempt, and whether all agree."""
    a = attempts.select("attempt_uid", F.col(run).alias("_ra"))
    s = scores.select("attempt_uid", F.col(run).alias("_rs"))
    both = a.join(s, "attempt_uid", "full_outer")
    out = both.groupBy(F.coalesce("_ra", "_rs").alias(run)).agg(
        F.count("_ra").alias("attempts"), F.count("_rs").alias("scores"),
        F.sum(F.col("_rs").isNull().cast("long")).alias("unscored"), F.sum(F.col("_ra").isNull().cast("long")).alias("orphans"),
    )
    return out.withColumn("parity", (F.col("unscored") == 0) & (F.col("orphans") == 0))


def frame_diff(
    old: DataFrame, new: DataFrame, key: str = "path", value: str = "value", text: str = "text", ignore: list[str] = [], atol: float = 0.0, rtol: float = 0.0
) -> DataFrame:
    """Added, removed and changed leaves of two keyed metric tables.

    A leaf holds a number in ``value`` or anything else in ``text``. ``ignore`` drops a path and everything
    below it.
    """
    path = F.col(key)
    skip = F.lit(False)
    for token in ignore:
        skip = skip | (path == token) | path.startswith(f"{token}.") | path.startswith(f"{token}[")
    side = lambda df, tag: df.filter(~skip).select(key, F.col(value).alias(f"{tag}_value"), F.col(text).alias(f"{tag}_text"), F.lit(True).alias(f"_{tag}"))
    both = side(old, "old").join(side(new, "new"), key, "full_outer")
    x, y = F.col("old_value"), F.col("new_value")
    gap = F.abs(x - y)
    close = (F.isnan(x) & F.isnan(y)) | (gap <= F.greatest(F.lit(atol), F.lit(rtol) * F.greatest(F.abs(x), F.abs(y))))
    numeric = x.isNotNull() & y.isNotNull()
    same = F.when(numeric, close).otherwise(x.eqNullSafe(y) & F.col("old_text").eqNullSafe(F.col("new_text")))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~same, "changed")
    return both.withColumn("change", change).filter(F.col("change").isNotNull()).select(
        key, "change", "old_value", "new_value", F.when(F.col("change") == "changed", F.when(numeric, gap).otherwise(0.0)).alias("abs_delta")
    )


def table_fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Order-insensitive content identity: row count and exact sum of row hashes."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("fingerprint")).select(F.lit(name).alias("table"), "rows", "fingerprint")
