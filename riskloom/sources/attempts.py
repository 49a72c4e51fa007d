"""Reading, validating and writing payment attempts and spooled decision envelopes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIRE_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("card_hash", T.StringType()),
        T.StructField("bin", T.StringType()),
        T.StructField("amount_minor", T.LongType()),
        T.StructField("currency", T.StringType()),
        T.StructField("last4", T.StringType()),
        T.StructField("exp_month", T.IntegerType()),
        T.StructField("exp_year", T.IntegerType()),
        T.StructField("session_id", T.StringType()),
    ]
)
# The server adds these; a client-sent address is never read from the wire part.
SERVER_FIELDS = [
    T.StructField("attempt_uid", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ingest_ms", T.LongType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("ip", T.StringType()),
    T.StructField("user_agent", T.StringType()),
]
ATTEMPT_SCHEMA = T.StructType([*WIRE_SCHEMA.fields, *SERVER_FIELDS])
CORRUPT = "_corrupt_record"

# fixed values: names that would hold a raw card number
FORBIDDEN_NAME = re.compile(r"pan|card_?number|primary_account", re.IGNORECASE)


def read_attempts(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType = ATTEMPT_SCHEMA, streaming: bool = False) -> DataFrame:
    """JSON lines or Parquet with an explicit schema; unknown fields are dropped, unreadable lines kept apart.

    JSON rows carry ``_corrupt_record``: the raw line when it could not be parsed, else null.
    """
    reader = spark.readStream if streaming else spark.read
    if fmt == "parquet":
        return reader.schema(schema).parquet(path)
    if fmt != "json":
        raise ValueError(f"unsupported format {fmt!r}")
    flagged = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return reader.schema(flagged).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def reject_reason(columns: list[str]) -> Column:
    """First violated rule of the wire contract, or null."""
    empty = lambda c: F.col(c).isNull() | (F.length(c) == 0)
    reason = F.when(F.col(CORRUPT).isNotNull(), "unreadable") if CORRUPT in columns else F.when(F.lit(False), "")
    for name in ("event_id", "card_hash", "bin", "currency"):
        reason = reason.when(empty(name), f"empty {name}")
    return reason.when(F.col("amount_minor").isNull(), "missing amount_minor").when(F.col("amount_minor") < 0, "negative amount_minor")


def validate_attempts(df: DataFrame) -> DataFrame:
    """Adds ``reject_reason``; valid rows have null there. One pass serves both outputs."""
    return df.withColumn("reject_reason", reject_reason(df.columns))


# --- envelopes --------------------------------------------------------------------------
def _fields(**columns: str) -> str:
    return "struct<" + ",".join(f"{n}:{t}" for n, t in columns.items()) + ">"


_ATTEMPT = _fields(
    attempt_uid="string", merchant_id="string", event_id="string", payload_digest="string", ingest_time="bigint", client_ts="bigint",
    session_id="string", card_hash="string", bin="string", last4="string", exp_month="int", exp_year="int", amount_minor="bigint",
    currency="string", ip="string", asn="int", ua_class="string", ipua_key="string", client_evidence="string",
)
_SCORE = _fields(
    attempt_uid="string", score_raw="double", score_calibrated="double", prior_used="double", regime="string", decision="string",
    tier_ladder="string", control_arm="boolean", shed="boolean", model_version="string", calibrator_version="string", policy_version="int",
    rules_fired="array<string>", feature_snapshot="map<string,string>", top_contributors="string", incident_id="string", latency_ms="bigint", scored_at="bigint",
)
_INCIDENT = _fields(
    incident_id="string", merchant_id="string", state="string", detector="string", opened_at="bigint", escalated_at="bigint", cooling_at="bigint",
    closed_at="bigint", peak_tier="string", attempts_total="bigint", attempts_before_alert="bigint", cards_exposed_before_alert="bigint",
    time_to_detect_s="double", cusum_stat_at_alert="double", narrative="string", narrative_source="string", recommended_tier="string",
    resolution="string", resolved_by="string", pinned_policy_version="int",
)
_ENTITY = _fields(incident_id="string", entity_type="string", entity_key="string", pseudonym="string", attempt_count="bigint", first_seen="bigint", last_seen="bigint")
_TRANSITION = _fields(transition_id="string", incident_id="string", from_tier="string", to_tier="string", trigger="string", signal_value="double", at="bigint")
_ACTION = _fields(
    action_id="string", incident_id="string", merchant_id="string", entity_type="string", entity_key="string", tier="string",
    requires_confirmation="int", confirmed_by="string", applied_at="bigint", expires_at="bigint", released_at="bigint", applied_by="string",
)
_CALL = _fields(call_id="string", incident_id="string", backend="string", requested_at="bigint", status="string", latency_ms="bigint", fallback_used="boolean")
ENVELOPE_TYPE = (
    f"attempt_uid string, payload struct<attempt:{_ATTEMPT},score:{_SCORE},incident:{_INCIDENT},incident_entity:array<{_ENTITY}>,"
    f"tier_transition:array<{_TRANSITION}>,enforcement:array<{_ACTION}>,narrator_call:array<{_CALL}>>"
)
# table -> (payload section, primary key, rule on a repeated key)
TABLES = {
    "attempt": ("attempt", ["attempt_uid"], "first"),
    "score": ("score", ["attempt_uid"], "first"),
    "incident": ("incident", ["incident_id"], "last"),
    "entity": ("incident_entity", ["incident_id", "entity_type", "entity_key"], "last"),
    "transition": ("tier_transition", ["transition_id"], "first"),
    "enforcement": ("enforcement", ["action_id"], "first"),
    "narrator_call": ("narrator_call", ["call_id"], "first"),
}


def parse_envelopes(lines: DataFrame, text: str = "value") -> DataFrame:
    """One struct per line; a torn or blank line yields a null payload."""
    return lines.withColumn("_e", F.from_json(F.trim(text), ENVELOPE_TYPE, {"mode": "PERMISSIVE"}))


def route_envelopes(lines: DataFrame, text: str = "value", order: str = "seq") -> dict[str, DataFrame]:
    """The seven tables of a spool; every frame keeps the line's ``order`` for the repeated-key rule."""
    parsed = parse_envelopes(lines, text).filter(F.col("_e.payload").isNotNull())
    out = {}
    for name, (section, _, _) in TABLES.items():
        field = F.col(f"_e.payload.{section}")
        if isinstance(parsed.select(field.alias("x")).schema["x"].dataType, T.ArrayType):
            rows = parsed.select(F.col(order), F.explode(field).alias("_r"))
        else:
            rows = parsed.select(F.col(order), field.alias("_r")).filter(F.col("_r").isNotNull())
        out[name] = rows.select(order, "_r.*")
    return out


def write_tables(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = [], mode: str = "append") -> None:
    """Partitioned Parquet or JSON lines with sorted keys; refuses a column that would hold a raw card number."""
    bad = [c for c in df.columns if FORBIDDEN_NAME.search(c)]
    if bad:
        raise ValueError(f"refusing to write columns that look like card numbers: {bad}")
    if fmt == "parquet":
        df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    elif fmt == "json":
        kept = sorted(c for c in df.columns if c not in partition_by)
        line = F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})
        df.select(*partition_by, line.alias("value")).write.mode(mode).partitionBy(*partition_by).text(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
