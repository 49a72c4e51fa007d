"""Keyed table maintenance: first-wins inserts, last-wins upserts, append-only versions, truth and corpus joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import constants as K


def _one_per_key(df: DataFrame, keys: list[str], order: list[str], latest: bool) -> DataFrame:
    """Repeated keys are combined before the shuffle."""
    pick = F.max_by if latest else F.min_by
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def insert_first_wins(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keeps the target; adds the earliest incoming row of every key the target lacks."""
    fresh = _one_per_key(incoming, keys, order, latest=False).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def upsert_last_wins(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest incoming row of a key replaces the target's row."""
    newest = _one_per_key(incoming, keys, order, latest=True)
    return target.join(newest.select(*keys), keys, "left_anti").select(*target.columns).unionByName(newest.select(*target.columns))


def append_version(target: DataFrame, incoming: DataFrame, order: list[str], key: str = "merchant_id") -> DataFrame:
    """Appends incoming rows with versions counting on from the key's highest; never updates."""
    top = target.groupBy(key).agg(F.max("version").alias("_top"))
    place = Window.partitionBy(key).orderBy(*order)
    numbered = incoming.withColumn("_n", F.row_number().over(place)).join(top, key, "left")
    added = numbered.withColumn("version", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("int"))
    return target.unionByName(added.select(*target.columns))


def latest_version(configs: DataFrame, key: str = "merchant_id") -> DataFrame:
    rest = [c for c in configs.columns if c != key]
    return configs.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("_r")).select(key, "_r.*")


def pinned_version(rows: DataFrame, configs: DataFrame, version: str = "pinned_policy_version", key: str = "merchant_id") -> DataFrame:
    """Joins each row to the exact version it is pinned to."""
    return rows.join(configs.withColumnRenamed("version", version), [key, version])


def load_truth(labels: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels attached to their attempt, and per merchant how many were written and skipped for want of one."""
    lookup = attempts.groupBy("merchant_id", "event_id").agg(F.min_by("attempt_uid", "seq").alias("attempt_uid"))
    joined = labels.join(lookup, ["merchant_id", "event_id"], "left")
    found = F.col("attempt_uid").isNotNull()
    counts = joined.groupBy("merchant_id").agg(
        F.sum(found.cast("long")).alias("labels_written"), F.sum((~found).cast("long")).alias("labels_skipped_no_attempt")
    )
    return joined.filter(found), counts


def load_feature_corpus(attempts: DataFrame, scores: DataFrame, snapshot: str = "feature_snapshot", names=K.FEATURE_NAMES) -> DataFrame:
    """Attempts joined to their logged feature snapshot, projected to the 24 names; a missing one is an error."""
    parsed = scores.select("attempt_uid", "score_raw", F.from_json(snapshot, "map<string,string>").alias("_s"))

    def value(name: str) -> Column:
        got = F.try_element_at(F.col("_s"), F.lit(name)).cast("double")
        return F.when(got.isNull(), F.raise_error(F.lit(f"feature snapshot lacks {name}"))).otherwise(got).alias(name)

    return attempts.join(parsed, "attempt_uid").select(*attempts.columns, "score_raw", *[value(n) for n in names])
