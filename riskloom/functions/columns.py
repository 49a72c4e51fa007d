"""Column expressions shared by the operators. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import constants as K



def _escape_char(c: Column) -> Column:
    """One character as a JSON escape: short forms first, then \\uXXXX, with surrogates above the BMP."""
    code = F.ascii(c)
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    high = F.floor((code - 0x10000) / 0x400) + 0xD800
    low = (code - 0x10000) % 0x400 + 0xDC00
    return (
        F.when(c == '"', '\\"')
        .when(c == "\\", "\\\\")
        .when(c == "\n", "\\n")
        .when(c == "\r", "\\r")
        .when(c == "\t", "\\t")
        .when(c == "\b", "\\b")
        .when(c == "\f", "\\f")
        .when(code > 0xFFFF, F.concat(unit(high), unit(low)))
        .when((code < 32) | (code > 126), unit(code))
        .otherwise(c)
    )


def json_text(col: Column) -> Column:
    """A JSON string literal, ASCII-only; null becomes the bare word null."""
    special = col.rlike(r'[^ !#-\[\]-~]')
    escaped = F.when(special, F.array_join(F.transform(F.split(col, ""), _escape_char), "")).otherwise(col)
    return F.when(col.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def json_number(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("null"))


def payload_digest() -> Column:
    """sha256 of the eight merchant-supplied fields as JSON with sorted keys and ``", "`` / ``": "`` separators."""
    parts = [
        ('{"amount_minor": ', json_number(F.col("amount_minor"))),
        (', "bin": ', json_text(F.col("bin"))),
        (', "card_hash": ', json_text(F.col("card_hash"))),
        (', "currency": ', json_text(F.col("currency"))),
        (', "exp_month": ', json_number(F.col("exp_month"))),
        (', "exp_year": ', json_number(F.col("exp_year"))),
        (', "last4": ', json_text(F.col("last4"))),
        (', "session_id": ', json_text(F.col("session_id"))),
    ]
    pieces = [piece for label, value in parts for piece in (F.lit(label), value)]
    return F.sha2(F.concat(*pieces, F.lit("}")), 256)


def idem_digest(payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.col("merchant_id"), F.col("event_id"), payload), 256)


def ua_class(user_agent: Column) -> Column:
    """Five-way class by ordered substring tests on the lower-cased agent."""
    agent = F.lower(F.coalesce(user_agent, F.lit("")))
    result = None
    for label, tokens in K.UA_TOKENS:
        hit = F.lit(False)
        for token in tokens:
            hit = hit | agent.contains(token)
        result = F.when(hit, label) if result is None else result.when(hit, label)
    return result.otherwise("unparseable")


def ipua_key(ip: Column, agent_class: Column) -> Column:
    return F.sha1(F.concat_ws("|", ip, agent_class))


def session_key(session: Column, ip: Column) -> Column:
    return F.coalesce(F.nullif(session, F.lit("")), F.concat(F.lit("nosession:"), ip))


def bucket(ts: Column, bucket_s: int = K.CUSUM_BUCKET_S) -> Column:
    return F.floor(ts / F.lit(bucket_s * 1000)).cast("long")


def hour_of_day(ts: Column) -> Column:
    return (F.floor(ts / F.lit(K.HOUR_MS)) % 24).cast("int")


# --- tiers ------------------------------------------------------------------------------
def tier_rank(tier: Column) -> Column:
    result = F.when(tier == K.TIERS[0], 0)
    for rank, name in enumerate(K.TIERS[1:], start=1):
        result = result.when(tier == name, rank)
    return result


def tier_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in K.TIERS]), rank.cast("int") + 1)


def tier_from_score(p: Column, thetas: dict[str, Column], ladder: Column | None = None) -> Column:
    """Rank of the highest ladder tier whose threshold ``p`` reaches; ``monitor`` below the lowest rung."""
    rank = F.lit(K.TIERS.index("monitor"))
    foreign = F.lit(False) if ladder is None else (ladder == "foreign")
    for name in K.COST_TIERS:
        reached = p >= thetas[name]
        if name not in K.LADDERS["domestic"]:
            reached = reached & foreign
        rank = F.when(reached, F.greatest(rank, F.lit(K.TIERS.index(name)))).otherwise(rank)
    return rank


def tier_ladder_values(model: dict = K.COST_MODEL) -> dict[str, float]:
    """theta = C_FP / (C_FP + C_FN) per tier, unrounded."""
    miss = model["auth_fee_minor"] + model["downstream_exposure_minor"]
    out = {}
    for tier in K.COST_TIERS:
        false_alarm = model["aov_minor"] * model["margin_pct"] * model["abandonment"][tier]
        out[tier] = false_alarm / (false_alarm + miss)
    return out


def expected_cost(tpr: Column, fpr: Column, prior, tier: str, model: dict = K.COST_MODEL) -> Column:
    """Expected cost of 10 000 attempts at one operating point."""
    miss = float(model["auth_fee_minor"] + model["downstream_exposure_minor"])
    false_alarm = model["aov_minor"] * model["margin_pct"] * model["abandonment"][tier]
    pi = prior if isinstance(prior, Column) else F.lit(float(prior))
    return F.lit(10_000.0) * (pi * (1 - tpr) * F.lit(miss) + (1 - pi) * fpr * F.lit(false_alarm))


# --- probabilities ----------------------------------------------------------------------
def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def logit(p: Column) -> Column:
    eps = K.PROBABILITY_EPS
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return F.ln(q / (1 - q))


def prior_correct(p: Column, pi_train, pi_serve) -> Column:
    """Moves a posterior from the training prior to the serving prior on the log-odds scale."""
    lift = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return sigmoid(logit(p) + logit(lift(pi_serve)) - logit(lift(pi_train)))


def serving_prior(regime: Column, rate_ratio: Column, pi0: float = K.COST_MODEL["prior_steady_state"]) -> Column:
    """pi0 while in control; under alarm the odds grow with the rate ratio, clamped to [pi0, 0.95]."""
    odds = F.greatest(rate_ratio, F.lit(0.0)) * F.lit(pi0 / (1.0 - pi0))
    lifted = F.least(F.greatest(odds / (1 + odds), F.lit(pi0)), F.lit(0.95))
    return F.when(regime == "alarm", lifted).otherwise(F.lit(pi0))


def apply_calibrator(margin: Column, a: float, b: float, pi_train: float, pi_serve) -> Column:
    return prior_correct(sigmoid(F.lit(float(a)) * margin + F.lit(float(b))), pi_train, pi_serve)


def interp_quantile(grid: Column, q: float) -> Column:
    """Linear interpolation of the value at ``q`` on an evenly spaced grid; 0.0 when the grid is empty."""
    q = min(max(q, 0.0), 1.0)
    last = F.size(grid) - 1
    pos = F.lit(q) * last
    low = F.least(F.floor(pos).cast("int"), F.greatest(last - 1, F.lit(0)))
    at = lambda i: F.element_at(grid, (i + 1).cast("int"))
    value = at(low) + (pos - low) * (at(F.least(low + 1, last)) - at(low))
    return F.when(grid.isNull() | (F.size(grid) == 0), F.lit(0.0)).otherwise(value)


def count_below(cuts: Column, value: Column, most: int) -> Column:
    """How many entries of the sorted array ``cuts`` (at most ``most``) are below ``value``, by bisection."""
    def halve(a, _):
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below = F.element_at(cuts, F.least(middle + 1, F.size(cuts))) < value
        return F.when(a["lo"] >= a["hi"], a).otherwise(
            F.struct(F.when(below, middle + 1).otherwise(a["lo"]).alias("lo"), F.when(below, a["hi"]).otherwise(middle).alias("hi"))
        )

    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    rounds = F.sequence(F.lit(1), F.lit(max(1, int(most).bit_length())))
    return F.aggregate(rounds, start, halve, lambda a: a["lo"])


def general_number(value: Column) -> Column:
    """Six significant digits without trailing zeros; an exponent of two digits or more outside 1e-4 to 1e6."""
    value = value.cast("double")
    parts = F.split(F.format_string("%.5e", value), "e")
    power = parts[1].cast("int")
    trimmed = lambda text: F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    written = F.concat(trimmed(parts[0]), F.lit("e"), parts[1])
    plain = F.lit(None).cast("string")
    for digits in range(10):
        plain = F.when(5 - power == digits, trimmed(F.format_string(f"%.{digits}f", value))).otherwise(plain)
    odd = F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(odd, F.regexp_replace(F.lower(value.cast("string")), "inity", "")).otherwise(F.coalesce(plain, written))


# --- identifiers ------------------------------------------------------------------------
def short_id(prefix: str, *parts: Column) -> Column:
    """Deterministic id: one letter and 25 upper-case hex digits of sha1 over the parts joined by ``|``."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha1(text), 1, 25)))


def truncated_key(entity_type: Column, key: Column) -> Column:
    plain = entity_type.isin("ip", "bin") & (F.length(key) <= 18)
    return F.when(plain | (F.length(key) <= 8), key).otherwise(F.concat(F.substring(key, 1, 8), F.lit("…")))


def threat_band(state: Column) -> Column:
    return (
        F.when(state == "OPEN", "elevated")
        .when(state == "ESCALATED", "under_attack")
        .when(state == "COOLING", "resolved")
        .otherwise("calm")
    )


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson score interval; (0, 1) when ``n`` is 0."""
    z = K.WILSON_Z
    size = F.nullif(n.cast("double"), F.lit(0.0))
    p = successes / size
    denom = 1 + F.lit(z * z) / size
    centre = p + F.lit(z * z) / (2 * size)
    margin = F.lit(z) * F.sqrt(p * (1 - p) / size + F.lit(z * z) / (4 * size * size))
    low = F.greatest(F.lit(0.0), (centre - margin) / denom)
    high = F.least(F.lit(1.0), (centre + margin) / denom)
    return F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(1.0))
