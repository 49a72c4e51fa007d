"""Tier resolution, control arm, enforcement rows and their lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import columns as C
from riskloom.functions.joins import join_groups
from riskloom.operators.automaton import pack, state_before
from riskloom.operators.incidents import ENTITY, action_id, transition_id
from riskloom.operators.prefix import running

MONITOR = K.TIERS.index("monitor")
THROTTLE = K.TIERS.index("throttle")


def tier_ladder(costs: DataFrame) -> DataFrame:
    """theta = C_FP / (C_FP + C_FN) per merchant and tier, unrounded.

    ``costs`` has one row per merchant and tier with the cost-model fields and ``abandonment``.
    """
    false_alarm = F.col("aov_minor") * F.col("margin_pct") * F.col("abandonment")
    miss = F.col("auth_fee_minor") + F.col("downstream_exposure_minor")
    return costs.select("merchant_id", "tier", (false_alarm / (false_alarm + miss)).alias("theta"))


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _thetas(thetas: dict | Column) -> dict[str, Column]:
    """Threshold per tier; a map column has null for the tiers that it lacks."""
    if isinstance(thetas, dict):
        return {t: _column(v) for t, v in thetas.items()}
    return {t: F.try_element_at(thetas, F.lit(t)) for t in K.TIERS[1:]}


# --- control arm ------------------------------------------------------------------------
def control_position(merchant: Column, version: Column, block: Column, n: int | Column) -> Column:
    digest = F.sha2(F.concat_ws(":", merchant, version.cast("string"), block.cast("string")), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("long")


def control_block_size(fraction: Column) -> Column:
    """Attempts of a block, 0 where there is no control arm."""
    return F.when(fraction > 0, F.greatest(F.lit(1), F.bround(1.0 / fraction).cast("long"))).otherwise(F.lit(0)).cast("long")


def control_arm(df: DataFrame, eligible: Column, version: Column, fraction: float | Column = K.POLICY["control_fraction"], **kw) -> DataFrame:
    """Adds ``control_arm``: one pseudo-random position in every block of N eligible attempts of a merchant."""
    if not isinstance(fraction, Column) and fraction <= 0:
        return df.withColumn("control_arm", F.lit(False))
    size = control_block_size(_column(fraction))
    n = F.greatest(size, F.lit(1))
    counted = running(df.withColumn("_eligible", eligible), ["merchant_id"], {"_ordinal": ("sum", F.col("_eligible").cast("long"), "before")}, **kw)
    ordinal = F.coalesce("_ordinal", F.lit(0))
    block = F.floor(ordinal / n)
    chosen = (ordinal % n) == control_position(F.col("merchant_id"), version, block, n)
    return counted.withColumn("control_arm", F.col("_eligible") & chosen & (size > 0)).drop("_ordinal", "_eligible")


# --- hysteresis and blast radius --------------------------------------------------------
def hysteresis(
    df: DataFrame, thetas: dict | Column, gap: float | Column = K.POLICY["hysteresis_gap"], **kw
) -> DataFrame:
    """Tier memory per entity: rise at theta, fall only below theta - gap.

    Needs ``target`` (rank before hysteresis), ``p``, ``incident_open``, ``at_cap``. The memory is one of
    six tiers, so an attempt is a map of six values; maps compose on the JVM and hot entities are split over tasks.
    Thresholds and gap may be columns; each row brings the tiers that its own values would hold.
    Adds ``l2_tier`` (rank) and ``advisory``.
    """
    limits = _thetas(thetas)
    none = F.lit(float("inf"))
    held = [F.coalesce(F.col("p") >= F.coalesce(limits[t] - gap, none) if t in limits else F.col("p") >= none, F.lit(True)) for t in K.TIERS]

    target, is_open, at_cap = F.col("target").cast("int"), F.col("incident_open"), F.coalesce(F.col("at_cap"), F.lit(False))

    def settled(current: int) -> Column:
        return F.when(~is_open, 0).when((F.lit(current) > target) & held[current], current).otherwise(target)

    after = [F.when(at_cap, 0).otherwise(settled(0)), *(settled(rank) for rank in range(1, len(K.TIERS)))]
    walked = state_before(df, ENTITY, pack(after), len(K.TIERS), "_before", **kw)
    tier = F.lit(None).cast("int")
    for rank in range(len(K.TIERS)):
        tier = F.when(F.col("_before") == rank, settled(rank)).otherwise(tier)
    return walked.withColumns({"l2_tier": tier.cast("int"), "advisory": at_cap & (F.col("_before") == 0)}).drop("_before")


def policy_resolve(
    df: DataFrame, thetas: dict | Column, policy: dict = K.POLICY, confirmed_ceiling: str | None = None, **kw
) -> DataFrame:
    """Proposed and in-force tier of every attempt.

    Needs the entity columns, ``p``, ``rule_tier``, ``incident_id``, ``corroborated`` and
    ``live_incidents``. Order of rules: ladder, corroboration cap, hysteresis, rule floor, ceiling (an
    operator-confirmed one in the column ``confirmed_ceiling`` wins), blast-radius cap, control arm.
    The cap counts live incidents, which no decision changes, so entities can be resolved independently.

    ``thetas`` is a threshold per tier or a map column; every value of ``policy`` may be a column, so a row can bring
    the settings of its merchant's pinned version (see ``resolve_pinned``).
    """
    ladder = F.col("tier_ladder") if "tier_ladder" in df.columns else F.lit("domestic")
    is_open = F.col("incident_id").isNotNull()
    from_score = C.tier_from_score(F.col("p"), _thetas(thetas), ladder)
    target = F.when(~is_open, 0).when(~F.coalesce(F.col("corroborated"), F.lit(False)), F.least(from_score, F.lit(MONITOR))).otherwise(from_score)
    rows = df.withColumns({"target": target, "incident_open": is_open, "at_cap": F.col("live_incidents") >= policy["k_max"]})
    rows = hysteresis(rows, thetas, policy["hysteresis_gap"], **kw)

    ceiling = C.tier_rank(_column(policy["auto_ceiling"]))
    if confirmed_ceiling is not None:
        ceiling = F.coalesce(C.tier_rank(F.col(confirmed_ceiling)), ceiling)
    proposed = F.greatest(F.col("l2_tier"), C.tier_rank(F.col("rule_tier")))
    rows = rows.withColumns({"_proposed": proposed, "_ceiling": ceiling})
    rows = rows.withColumns({"_force": F.least("_proposed", "_ceiling"), "requires_confirmation": F.col("_proposed") > F.col("_ceiling")})
    version = F.col("policy_version") if "policy_version" in df.columns else _column(policy["version"])
    rows = control_arm(rows, (F.col("_force") > 0) & ~F.col("advisory"), version, policy["control_fraction"], **kw)
    in_force = F.when(F.col("advisory") | F.col("control_arm"), 0).otherwise(F.col("_force"))
    return rows.select(
        *df.columns, "l2_tier", "advisory", "requires_confirmation", "control_arm",
        C.tier_name(F.col("_proposed")).alias("proposed_tier"), C.tier_name(in_force).alias("in_force_tier"),
    )


# --- pinned versions --------------------------------------------------------------------
#: What a version of a merchant's policy sets, and a row falls back on while its merchant has none.
SETTINGS = ("hysteresis_gap", "k_max", "control_fraction", "auto_ceiling")


def live_version(rows: DataFrame, versions: DataFrame, at: Column, name: str = "policy_version", **kw) -> DataFrame:
    """Adds the merchant's highest version created (``created_ms``) at or before ``at``, null before its first one.

    Versions are placed among the rows in time order and the highest so far is carried on, so there is no range join and a hot
    merchant's rows stay on many tasks (see ``running``).
    """
    marks = versions.select("merchant_id", F.col("created_ms").cast("long").alias("_at"), F.lit(0).alias("_after"), F.col("version").alias("_version"))
    placed = rows.withColumns({"_at": at.cast("long"), "_after": F.lit(1), "_version": F.lit(None).cast(versions.schema["version"].dataType)})
    found = running(placed.unionByName(marks, allowMissingColumns=True), ["merchant_id"], {"_live": ("max", F.col("_version"))}, "_at", "_after", **kw)
    return found.filter("_after = 1").select(*rows.columns, F.col("_live").alias(name))


def version_settings(rows: DataFrame, versions: DataFrame, thetas: dict, policy: dict, name: str = "policy_version") -> tuple[DataFrame, Column, dict]:
    """Joins the settings of each row's version as the struct ``_set``; returns them with the defaults filled in."""
    settings = versions.select("merchant_id", F.col("version").alias(name), F.struct("thetas", *SETTINGS).alias("_set"))
    joined = join_groups(rows, settings, ["merchant_id", name], "left")
    standard = F.create_map(*(F.lit(x) for tier, theta in thetas.items() for x in (tier, float(theta))))
    chosen = {**policy, **{k: F.coalesce(F.col("_set")[k], F.lit(policy[k])) for k in SETTINGS}}
    return joined, F.coalesce(F.col("_set.thetas"), standard), chosen


def resolve_pinned(df: DataFrame, versions: DataFrame, thetas: dict, policy: dict = K.POLICY, **kw) -> DataFrame:
    """``policy_resolve`` where an incident keeps the policy version that was live when it opened.

    ``versions`` has ``merchant_id``, ``version`` (rising with time), ``created_ms``, a map ``thetas`` and the columns of ``SETTINGS``.
    Attempts outside incidents take the version live at their own time. Where none is, ``thetas`` and ``policy`` apply.
    Adds ``policy_version``.
    """
    rows = live_version(df, versions, F.coalesce("opened_at", "ingest_ms"), **kw)
    rows, limits, chosen = version_settings(rows, versions, thetas, policy)
    rows = rows.withColumn("policy_version", F.coalesce("policy_version", F.lit(policy["version"])))
    return policy_resolve(rows, limits, chosen, **kw).drop("_set")


# --- transitions and enforcement --------------------------------------------------------
def tier_transitions(rows: DataFrame, **kw) -> DataFrame:
    """The opening row of each incident and every rise of its proposed tier."""
    ranked = rows.withColumn("_rank", C.tier_rank(F.col("proposed_tier")))
    tracked = running(ranked, ["incident_id"], {"_peak": ("max", F.col("_rank"), "before")}, **kw)
    peak = F.greatest(F.coalesce("_peak", F.lit(0)), F.lit(MONITOR))
    regime = F.col("regime") if "regime" in rows.columns else F.lit("in_control")
    def row(kind, source, target, trigger):
        return F.struct(F.lit(kind).alias("k"), source.alias("from_tier"), target.alias("to_tier"), F.concat_ws(":", *trigger).alias("trigger"))

    opening = row(0, F.lit(None).cast("string"), F.lit("monitor"), (F.lit("open"), F.col("detector")))
    rise = row(1, C.tier_name(peak), F.col("proposed_tier"), (F.lit("policy"), F.col("detector"), regime))
    made = F.array_compact(F.array(F.when(F.col("opens"), opening), F.when(F.col("_rank") > peak, rise)))
    stacked = tracked.select("incident_id", "signal_value", F.col("ingest_ms").alias("at"), "seq", F.explode(made).alias("_t"))
    # A tier rises at most once per rank, so an incident has at most six rows here.
    place = Window.partitionBy("incident_id").orderBy("at", "seq", "_t.k")
    stacked = stacked.withColumn("ordinal", F.row_number().over(place) - 1)
    return stacked.select(
        transition_id(F.col("incident_id"), F.col("ordinal")).alias("transition_id"),
        "incident_id", "ordinal", "_t.from_tier", "_t.to_tier", "_t.trigger", "signal_value", "at",
    )


def enforcement_rows(rows: DataFrame, ceiling: str = K.POLICY["auto_ceiling"], ttl_ms: int = K.POLICY["enforcement_ttl_ms"]) -> DataFrame:
    """First row per incident, entity and tier with friction; above the ceiling it waits for confirmation."""
    rank = C.tier_rank(F.col("proposed_tier"))
    kept = rows.filter(F.col("incident_id").isNotNull() & (rank >= THROTTLE) & ~F.col("control_arm") & ~F.col("advisory"))
    first = kept.groupBy("incident_id", *ENTITY, F.col("proposed_tier").alias("tier")).agg(F.min("ingest_ms").alias("_at"))
    auto = C.tier_rank(F.col("tier")) <= K.TIERS.index(ceiling)
    return first.select(
        action_id(F.col("incident_id"), F.col("entity_type"), F.col("entity_key"), F.col("tier")).alias("action_id"),
        "incident_id", *ENTITY, "tier", (~auto).alias("requires_confirmation"),
        F.when(auto, "auto").alias("confirmed_by"), F.when(auto, F.col("_at")).alias("applied_at"),
        (F.col("_at") + ttl_ms).alias("expires_at"), F.lit(None).cast("long").alias("released_at"), F.lit("auto").alias("applied_by"),
    )


def enforcement_lifecycle(
    actions: DataFrame, incidents: DataFrame, confirmations: DataFrame, resolutions: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Applies operator events; returns actions, incidents and the rejected events with a reason.

    ``confirmations``: event_id, incident_id, action_id, tier, at. ``resolutions``: event_id, incident_id,
    resolution, at. The first valid confirmation of an action wins; the latest resolution of an incident
    wins, and its first one releases the enforcement.
    """
    target = actions.select("action_id", F.col("incident_id").alias("_incident"), F.col("tier").alias("_tier"), F.col("requires_confirmation").alias("_needs"))
    known = incidents.select(F.col("incident_id"), F.lit(True).alias("_known"))
    checked = confirmations.join(target, "action_id", "left").join(known, "incident_id", "left")
    reason = (
        F.when(F.col("_known").isNull(), "unknown incident")
        .when(F.col("_incident").isNull() | (F.col("_incident") != F.col("incident_id")), "unknown action for this incident")
        .when((F.col("_tier") != F.col("tier")) | ~F.col("tier").isin("step_up", "block"), "tier is not a proposed enforcement")
        .when(~F.col("_needs"), "not awaiting confirmation")
    )
    checked = checked.withColumn("reason", reason)
    winners = checked.filter(F.col("reason").isNull()).groupBy("action_id").agg(
        F.min(F.struct("at", "event_id")).alias("_win")
    ).select("action_id", F.col("_win.at").alias("_confirmed_at"), F.col("_win.event_id").alias("_winner"))
    late = checked.filter(F.col("reason").isNull()).join(winners, "action_id").filter(F.col("event_id") != F.col("_winner"))
    rejected = checked.filter(F.col("reason").isNotNull()).select("event_id", F.lit("confirm").alias("kind"), "reason")
    rejected = rejected.unionByName(late.select("event_id", F.lit("confirm").alias("kind"), F.lit("not awaiting confirmation").alias("reason")))

    judged = resolutions.join(known, "incident_id", "left").withColumn(
        "reason",
        F.when(~F.col("resolution").isin("false_positive", "true_positive"), "unknown resolution").when(F.col("_known").isNull(), "unknown incident"),
    )
    rejected = rejected.unionByName(judged.filter(F.col("reason").isNotNull()).select("event_id", F.lit("resolve").alias("kind"), "reason"))
    settled = judged.filter(F.col("reason").isNull()).groupBy("incident_id").agg(
        F.max(F.struct("at", "event_id", "resolution")).alias("_last"), F.min("at").alias("_released")
    )
    out_actions = (
        actions.join(winners, "action_id", "left").join(settled, "incident_id", "left")
        .withColumns(
            {
                "requires_confirmation": F.col("requires_confirmation") & F.col("_winner").isNull(),
                "confirmed_by": F.when(F.col("_winner").isNotNull(), "operator").otherwise(F.col("confirmed_by")),
                "applied_at": F.coalesce("_confirmed_at", "applied_at"),
                "released_at": F.coalesce("released_at", "_released"),
            }
        )
        .select(*actions.columns)
    )
    closed = F.col("_last").isNotNull()
    out_incidents = incidents.join(settled, "incident_id", "left").withColumns(
        {
            "state": F.when(closed, "CLOSED").otherwise(F.col("state")),
            "closed_at": F.coalesce("_last.at", "closed_at"),
            "resolution": F.coalesce("_last.resolution", "resolution"),
            "resolved_by": F.when(closed, "operator").otherwise(F.col("resolved_by")),
        }
    ).select(*incidents.columns)
    return out_actions, out_incidents, rejected


def active_enforcement_count(actions: DataFrame) -> DataFrame:
    """Distinct unreleased entities per merchant."""
    return actions.filter(F.col("released_at").isNull()).groupBy("merchant_id").agg(
        F.countDistinct("entity_type", "entity_key").alias("active")
    )
