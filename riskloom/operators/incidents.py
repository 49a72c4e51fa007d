"""Incidents per entity: sessions of detector fires, their state, metrics, identifiers and read models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import columns as C
from riskloom.operators.prefix import counted_once, running

ENTITY = ["merchant_id", "entity_type", "entity_key"]
COOLDOWN_MS = K.POLICY["cooldown_s"] * 1000


def resolve_entity(df: DataFrame, scope: Column) -> DataFrame:
    """Narrowest usable key for the scope: card or bin when present, else ip and agent class, else ip."""
    filled = lambda name: F.length(F.trim(F.coalesce(F.col(name), F.lit("")))) > 0
    kind = (
        F.when((scope == "card") & filled("card_hash"), "card")
        .when((scope == "bin") & filled("bin"), "bin")
        .when((scope != "ip") & filled("ip") & filled("ua_class"), "ipua")
        .when(filled("ip"), "ip")
        .otherwise(F.raise_error(F.lit("no identifier to scope enforcement")))
    )
    key = (
        F.when(F.col("entity_type") == "card", F.col("card_hash"))
        .when(F.col("entity_type") == "bin", F.col("bin"))
        .when(F.col("entity_type") == "ipua", C.ipua_key(F.col("ip"), F.col("ua_class")))
        .otherwise(F.col("ip"))
    )
    return df.withColumn("entity_type", kind).withColumn("entity_key", key)


def evidence_scope(rules_fired: Column) -> Column:
    """``bin`` when the issuer fan-out rule alone fired, else ``ip``."""
    return F.when((F.size(rules_fired) == 1) & F.array_contains(rules_fired, K.RULES[2][0]), "bin").otherwise("ip")


def incident_sessions(df: DataFrame, cooldown_ms: int = COOLDOWN_MS, **kw) -> DataFrame:
    """Assigns attempts to incidents; needs the entity columns and ``fired``.

    A fire opens an incident when the previous fire of the entity is at least two cooldowns back. Attempts
    belong to it until two cooldowns after its latest fire. Adds ``opens``, ``prev_fire_ms``, ``opened_at``,
    ``last_fire_ms``, ``warm_since`` (first fire since the entity last cooled) and ``incident_id``, the last
    four null outside incidents.
    """
    kw = counted_once(df, ENTITY, kw)
    ts = F.col("ingest_ms")
    seen = running(df, ENTITY, {"_prev": ("max", F.when(F.col("fired"), ts), "before")}, **kw)
    gap = ts - F.col("_prev")
    opens = F.col("fired") & (F.col("_prev").isNull() | (gap >= 2 * cooldown_ms))
    warms = F.col("fired") & (F.col("_prev").isNull() | (gap >= cooldown_ms))
    placed = running(
        seen.withColumn("opens", opens), ENTITY,
        {"_open": ("max", F.when(F.col("opens"), ts)), "_warm": ("max", F.when(warms, ts))}, **kw,
    )
    last = F.greatest(F.col("_prev"), F.when(F.col("fired"), ts))
    inside = F.col("_open").isNotNull() & (ts < last + 2 * cooldown_ms)
    return placed.select(
        *df.columns, "opens", F.col("_prev").alias("prev_fire_ms"),
        F.when(inside, F.col("_open")).alias("opened_at"),
        F.when(inside, last).alias("last_fire_ms"),
        F.when(inside, F.col("_warm")).alias("warm_since"),
        F.when(inside, incident_id(F.col("_open"))).alias("incident_id"),
    )


# --- identifiers ------------------------------------------------------------------------
def incident_id(opened_at: Column) -> Column:
    return C.short_id("I", F.col("merchant_id"), F.col("entity_type"), F.col("entity_key"), opened_at)


def transition_id(incident: Column, ordinal: Column) -> Column:
    return C.short_id("T", incident, ordinal)


def action_id(incident: Column, entity_type: Column, entity_key: Column, tier: Column) -> Column:
    return C.short_id("A", incident, entity_type, entity_key, tier)


# --- per-incident tables ----------------------------------------------------------------
def corroborated(rows: DataFrame, **kw) -> DataFrame:
    """Adds ``corroborated``: two rule families over two buckets within the incident so far; false outside.

    ``rows`` come from ``incident_sessions`` with ``families`` and ``bucket``. The entity stays part of the
    key, so the sessions' partitioning is reused.
    """
    has = F.size("families") > 0
    flags = {
        f"_f{i}": ("max", F.array_contains("families", family).cast("int"))
        for i, family in enumerate(dict.fromkeys(r[3] for r in K.RULES))
    }
    spans = {"_b0": ("min", F.when(has, F.col("bucket"))), "_b1": ("max", F.when(has, F.col("bucket")))}
    tracked = running(rows, [*ENTITY, "incident_id"], {**flags, **spans}, **kw)
    total = sum((F.coalesce(F.col(n), F.lit(0)) for n in flags), F.lit(0))
    met = F.col("incident_id").isNotNull() & (total >= 2) & F.coalesce(F.col("_b1") > F.col("_b0"), F.lit(False))
    return tracked.select(*rows.columns, met.alias("corroborated"))


def detector_merges(rows: DataFrame, **kw) -> DataFrame:
    """Fires whose detector the incident does not carry yet; each of them escalates an open incident.

    Once a second kind has fired the incident is ``both``, and every later single-detector fire counts as
    new again. Adds ``merges`` and ``incident_detector``, the incident's label after the row.
    """
    at = F.struct("ingest_ms", "seq")
    keys = [*ENTITY, "incident_id"]
    kw = counted_once(rows, keys, kw)
    known = running(rows, keys, {"_d0": ("max", F.when(F.col("opens"), F.col("detector")))}, **kw)
    other = F.col("fired") & ~F.col("opens") & (F.col("detector") != F.col("_d0"))
    mixed = running(known, keys, {"_mixed": ("min", F.when(other, at))}, **kw)
    later = F.col("fired") & ~F.col("opens") & (at > F.col("_mixed")) & (F.col("detector") != "both")
    merges = F.coalesce((at == F.col("_mixed")) | later, F.lit(False))
    return mixed.select(
        *rows.columns, merges.alias("merges"),
        F.when(F.col("_mixed").isNull(), F.col("_d0")).otherwise("both").alias("incident_detector"),
    )


def incident_metrics(rows: DataFrame) -> DataFrame:
    """One row per incident; ``rows`` are attempts inside incidents with entity history and detector values."""
    opening = lambda c: F.max(F.when(F.col("opens"), F.col(c)))
    grouped = rows.groupBy("incident_id", *ENTITY, "opened_at").agg(
        F.count(F.lit(1)).alias("attempts_total"),
        F.max("last_fire_ms").alias("last_fire_ms"),
        F.max("ingest_ms").alias("last_seen"),
        opening("attempts_before").alias("attempts_before_alert"),
        opening("cards_before").alias("cards_exposed_before_alert"),
        opening("entity_first_seen").alias("first_seen"),
        opening("cusum_stat").alias("cusum_stat_at_alert"),
        opening("detector").alias("opening_detector"),
        opening("signal_value").alias("opening_signal"),
    )
    return grouped.withColumn("time_to_detect_s", (F.col("opened_at") - F.col("first_seen")) / 1000.0)


def escalations(rows: DataFrame, event: Column, cooldown_ms: int = COOLDOWN_MS) -> DataFrame:
    """Latest escalation of each incident: events count while it is open, the first one per warm stretch.

    ``event`` marks the rows that escalate: detector merges and rises of the proposed tier.
    """
    counts = event & (F.col("ingest_ms") - F.col("last_fire_ms") < cooldown_ms)
    stretches = rows.groupBy("incident_id", "warm_since").agg(F.min(F.when(counts, F.col("ingest_ms"))).alias("_at"))
    hit = F.when(F.col("_at").isNotNull(), F.col("warm_since"))
    return stretches.groupBy("incident_id").agg(
        F.max_by("_at", hit).alias("escalated_at"),
        F.coalesce(F.max(hit) == F.max("warm_since"), F.lit(False)).alias("escalated"),
    )


def incident_state_at(incidents: DataFrame, now: Column, cooldown_ms: int = COOLDOWN_MS) -> DataFrame:
    """State at ``now``: open or escalated until one cooldown after the last fire, cooling for one more, then closed."""
    idle = now - F.col("last_fire_ms")
    escalated = F.coalesce(F.col("escalated"), F.lit(False)) if "escalated" in incidents.columns else F.lit(False)
    closed = idle >= 2 * cooldown_ms
    return incidents.withColumns(
        {
            "state": F.when(closed, "CLOSED").when(idle >= cooldown_ms, "COOLING").when(escalated, "ESCALATED").otherwise("OPEN"),
            "cooling_at": F.when(idle >= cooldown_ms, F.col("last_fire_ms") + cooldown_ms),
            "closed_at": F.when(closed, F.col("last_fire_ms") + 2 * cooldown_ms),
            "resolution": F.when(closed, "auto"),
            "resolved_by": F.when(closed, "auto"),
        }
    )


def worst_threat_state(incidents: DataFrame) -> DataFrame:
    """Most severe band over the live incidents of each merchant."""
    bands = F.array(*[F.lit(b) for b in ("calm", "resolved", "elevated", "under_attack")])
    rank = F.array_position(bands, C.threat_band(F.col("state")))
    return incidents.groupBy("merchant_id").agg(F.element_at(bands, F.max(rank).cast("int")).alias("threat_state"))


def pseudonyms(incidents: DataFrame) -> DataFrame:
    """``ip_1, ip_2, ...`` per merchant and type, in the order entities first had an incident."""
    first = incidents.groupBy(*ENTITY).agg(F.min(F.struct("opened_at", "entity_key")).alias("_first"))
    placed = first.select(*ENTITY, F.col("_first.opened_at").alias("ingest_ms"), F.col("entity_key").alias("seq"))
    ranked = running(placed, ["merchant_id", "entity_type"], {"_n": ("sum", F.lit(1))})
    return ranked.select(*ENTITY, F.concat("entity_type", F.lit("_"), F.col("_n")).alias("pseudonym"))


def live_incident_count(rows: DataFrame, cooldown_ms: int = COOLDOWN_MS, name: str = "live_incidents", **kw) -> DataFrame:
    """Adds the number of live incidents of the merchant at each attempt, its own opening included.

    Every fire schedules a close two cooldowns later, and a fire within that time cancels the close of the
    fire before it. All events come from the row itself, so the sessions are read once.
    """
    def event(at, order, change, row):
        return F.struct(at.alias("ingest_ms"), order.alias("seq"), F.lit(change).alias("d"), row.alias("row"))

    ts, early = F.col("ingest_ms"), F.lit(-1).cast("long")
    whole, none = F.struct(*rows.columns), F.lit(None)
    made = F.array_compact(
        F.array(
            F.when(F.col("opens"), event(ts, F.col("seq"), 1, whole)).otherwise(event(ts, F.col("seq"), 0, whole)),
            F.when(F.col("fired"), event(ts + 2 * cooldown_ms, early, -1, none)),
            F.when(F.col("fired") & ~F.col("opens"), event(F.col("prev_fire_ms") + 2 * cooldown_ms, early, 1, none)),
        )
    )
    events = rows.select("merchant_id", F.explode(made).alias("_e")).select("merchant_id", "_e.*")
    counted = running(events, ["merchant_id"], {"_live": ("sum", F.col("d"))}, **kw).filter(F.col("row").isNotNull())
    return counted.select("row.*", F.col("_live").cast("long").alias(name))


# --- narrative --------------------------------------------------------------------------
def incident_narratives(incidents: DataFrame, rule_results: DataFrame) -> DataFrame:
    """Adds ``narrative`` from the closed-vocabulary template.

    ``rule_results`` holds one row per incident and rule: ``name``, ``fired``, ``value``, ``threshold``,
    ``ordinal``. The primary rule has the highest value/threshold among fired rules, else among all; the
    earlier rule wins a tie.
    """
    ratio = F.when(F.col("threshold") != 0, F.col("value") / F.col("threshold")).otherwise(0.0)
    key = F.struct(F.col("fired"), ratio.alias("ratio"), (-F.col("ordinal")).alias("o"))
    label = F.col("name")
    for name, text in K.RULE_TEXT.items():
        label = F.when(F.col("name") == name, text).otherwise(label)
    best = rule_results.withColumn("_label", label).groupBy("incident_id").agg(
        F.max_by(F.struct("_label", "value", "threshold"), key).alias("_p"),
        F.array_sort(F.collect_list(F.when(F.col("fired"), F.struct("ordinal", "name")))).alias("_f"),
    )
    joined = incidents.join(best, "incident_id")
    number = lambda c: C.general_number(F.col(c))
    fired = F.array_join(F.transform("_f", lambda f: f["name"]), ", ")
    text = F.concat(
        F.lit("Entity "), "pseudonym", F.lit(" ("), "entity_type", F.lit(') was assigned tier "'), "tier",
        F.lit('". Triggering signal: '), "_p._label", F.lit(", value "), number("_p.value"),
        F.lit(" against threshold "), number("_p.threshold"), F.lit(". Rules fired: "),
        F.when(F.size("_f") > 0, fired).otherwise("none"), F.lit("."),
    )
    text = F.substring(text, 1, K.NARRATIVE_CHARS)
    fallback = F.concat(
        F.lit("Entity "), "pseudonym", F.lit(' was assigned tier "'), "tier", F.lit('". Evidence unavailable in renderable form.')
    )
    narrative = F.when(text.rlike(K.NARRATIVE_PATTERN), text).otherwise(fallback)
    return joined.select(*incidents.columns, narrative.alias("narrative"), F.lit("template").alias("narrative_source"))


# --- read models ------------------------------------------------------------------------
def list_incidents(incidents: DataFrame, state: str = "live") -> DataFrame:
    """Newest first; ``state`` is live, closed or all."""
    if state not in ("live", "closed", "all"):
        raise ValueError(f"unknown incident filter {state!r}")
    keep = {"live": F.col("state") != "CLOSED", "closed": F.col("state") == "CLOSED", "all": F.lit(True)}[state]
    return incidents.filter(keep).orderBy(F.col("opened_at").desc(), "incident_id")


def incident_detail(
    incidents: DataFrame, entities: DataFrame, transitions: DataFrame, actions: DataFrame, scores: DataFrame, attempts: DataFrame
) -> DataFrame:
    """The full read model per incident: entities, timeline, actions, newest decision, contributors, client evidence.

    Newest values are aggregates with map-side combine; only the short per-incident lists are collected,
    and they are bounded by entity types and tiers.
    """
    shown = C.truncated_key(F.col("entity_type"), F.col("entity_key"))
    entity_list = entities.groupBy("incident_id").agg(
        F.array_sort(F.collect_list(F.struct("pseudonym", "entity_type", shown.alias("entity_key_truncated"), "attempt_count", "first_seen", "last_seen"))).alias("entities")
    )
    timeline = transitions.groupBy("incident_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "transition_id", "from_tier", "to_tier", "trigger", "signal_value"))).alias("timeline")
    )
    action_list = actions.groupBy("incident_id").agg(
        F.array_sort(F.collect_list(F.struct("tier", "action_id", "entity_type", shown.alias("entity_key_truncated"), "requires_confirmation", "confirmed_by", "applied_at", "expires_at", "released_at"))).alias("enforcement")
    )
    newest = scores.filter(F.col("incident_id").isNotNull()).groupBy("incident_id").agg(
        F.max_by("decision", F.struct("scored_at", "attempt_uid")).alias("in_force_tier"),
        F.max_by("top_contributors", F.when(F.col("top_contributors").isNotNull(), F.struct("scored_at", "attempt_uid"))).alias("contributions"),
    )
    keys = F.explode(
        F.array(*[F.struct(F.lit(t).alias("entity_type"), F.col(c).alias("entity_key")) for t, c in (("ip", "ip"), ("ipua", "ipua_key"), ("bin", "bin"), ("card", "card_hash"))])
    )
    wanted = entities.select("entity_type", "entity_key").distinct()
    evidence = (
        attempts.select("ingest_ms", "seq", F.substring("user_agent", 1, 60).alias("user_agent"), keys.alias("_k"))
        .select("ingest_ms", "seq", "user_agent", "_k.entity_type", "_k.entity_key")
        .join(wanted, ["entity_type", "entity_key"], "left_semi")
        .groupBy("entity_type", "entity_key")
        .agg(F.max_by(F.struct("user_agent", F.col("ingest_ms").alias("observed_at")), F.struct("ingest_ms", "seq")).alias("_ev"))
    )
    client = entities.join(evidence, ["entity_type", "entity_key"]).groupBy("incident_id").agg(F.min_by("_ev", "pseudonym").alias("client_evidence"))
    out = incidents
    for part in (entity_list, timeline, action_list, newest, client):
        out = out.join(part, "incident_id", "left")
    return out.withColumn("in_force_tier", F.coalesce("in_force_tier", F.lit("challenge")))
