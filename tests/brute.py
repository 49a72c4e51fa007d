"""Plain-Python statements of the rules, one event at a time. Tests compare Spark results with these."""

from __future__ import annotations

import hashlib
import math
import random

TIERS = ["allow", "monitor", "throttle", "challenge", "step_up", "block"]


def stream(seed: int, n: int, keys: int = 3, members: int = 5, span: int = 200_000, ties: bool = True):
    """Random attempts with repeated times, bursts and gaps, in arrival order."""
    rng = random.Random(seed)
    times, t = [], 1_000_000
    for _ in range(n):
        t += rng.choice([0, 0, 1, 50, 400, 5_000]) if ties else rng.randint(1, 2_000)
        if rng.random() < 0.02:
            t += rng.randint(20_000, span)
        times.append(t)
    return [
        {
            "seq": i, "attempt_uid": f"u{i}", "ingest_ms": t, "merchant_id": f"m{rng.randint(0, 1)}", "ip": f"ip{min(rng.randint(0, keys), keys - 1)}",
            "card_hash": f"c{rng.randint(0, members)}", "bin": f"b{rng.randint(0, 2)}", "score": rng.random(), "x": rng.uniform(-1, 0.9),
        }
        for i, t in enumerate(times)
    ]


def windows(rows, key, width, member=None):
    """uid -> values in ``(t - w, t]`` up to and including the row."""
    out = {}
    for i, r in enumerate(rows):
        seen = [q for q in rows[: i + 1] if all(q[k] == r[k] for k in key) and r["ingest_ms"] - width < q["ingest_ms"]]
        out[r["attempt_uid"]] = len(seen) if member is None else [q[member] for q in seen]
    return out


def concentration(values):
    n = len(values)
    shares = [values.count(v) / n for v in set(values)]
    return sum(p * p for p in shares), 0.0 if len(shares) == 1 else -sum(p * math.log(p) for p in shares)


def anchored(rows, key, ttl):
    state, out = {}, {}
    for r in rows:
        k = tuple(r[c] for c in key)
        at = state.get(k)
        if at is None or r["ingest_ms"] >= at[0] + ttl:
            state[k] = at = [r["ingest_ms"], r["attempt_uid"], 0]
        at[2] += 1
        out[r["attempt_uid"]] = (at[0], at[1], at[2])
    return out


def walk(rows, key, step):
    s, out = {}, {}
    for r in rows:
        k = tuple(r[c] for c in key)
        s[k] = max(0.0, s.get(k, 0.0) + step(r))
        out[r["attempt_uid"]] = s[k]
    return out


def tokens(rows, rate, burst):
    """Exact thousandths of a token."""
    level, last, out = {}, {}, {}
    for r in rows:
        m, t = r["merchant_id"], r["ingest_ms"]
        x = level.get(m, burst * 1000)
        x = min(burst * 1000, x + max(0, t - last.get(m, t)) * rate)
        last[m] = t
        out[r["attempt_uid"]] = x >= 1000
        level[m] = x - 1000 if x >= 1000 else x
    return out


class Incidents:
    """Event-driven incident machine of one entity book per merchant."""

    def __init__(self, cooldown):
        self.cd, self.book, self.all = cooldown, {}, []

    def sweep(self, m, now):
        for inc in self.book.get(m, {}).values():
            if inc["state"] in ("OPEN", "ESCALATED") and now - inc["last"] >= self.cd:
                inc["cooling_at"], inc["state"] = inc["last"] + self.cd, "COOLING"
            if inc["state"] == "COOLING" and now - inc["cooling_at"] >= self.cd:
                inc["closed_at"], inc["state"] = inc["cooling_at"] + self.cd, "CLOSED"

    def step(self, r):
        m, e, t = r["merchant_id"], r["ip"], r["ingest_ms"]
        self.sweep(m, t)
        book = self.book.setdefault(m, {})
        inc = book.get(e)
        if inc is not None and inc["state"] != "CLOSED":
            inc["n"] += 1
            if r["families"]:
                inc["fam"].setdefault(r["bucket"], set()).update(r["families"])
            if r["fired"]:
                inc["last"] = t
                if inc["state"] == "COOLING":
                    inc["state"], inc["cooling_at"] = "OPEN", None
                if r["detector"] not in inc["detector"]:
                    inc["detector"] = "both"
                    if inc["state"] == "OPEN":
                        inc["state"], inc["escalated_at"] = "ESCALATED", t
            return inc
        if r["fired"]:
            inc = {"open": t, "last": t, "n": 1, "state": "OPEN", "detector": r["detector"], "fam": {}, "cooling_at": None, "closed_at": None, "escalated_at": None, "m": m, "e": e}
            if r["families"]:
                inc["fam"][r["bucket"]] = set(r["families"])
            book[e] = inc
            self.all.append(inc)
            return inc
        return None

    def live(self, m):
        return sum(i["state"] != "CLOSED" for i in self.book.get(m, {}).values())

    @staticmethod
    def corroborated(inc):
        return inc is not None and len(inc["fam"]) >= 2 and len(set().union(*inc["fam"].values())) >= 2


def policy(rows, thetas, gap, cooldown, k_max, fraction, version=1):
    machine, tier, ordinals, out = Incidents(cooldown), {}, {}, {}
    n = max(1, round(1 / fraction))
    for r in rows:
        inc = machine.step(r)
        m, key, p = r["merchant_id"], (r["merchant_id"], r["ip"]), r["score"]
        before = tier.get(key, 0)
        if inc is None:
            l2 = 0
            tier.pop(key, None)
        else:
            l2 = 1
            for name in ("throttle", "challenge", "block"):
                if p >= thetas[name]:
                    l2 = max(l2, TIERS.index(name))
            if not machine.corroborated(inc):
                l2 = min(l2, 1)
            if l2 < before:
                theta = thetas.get(TIERS[before])
                if not (theta is None or p < theta - gap):
                    l2 = before
            tier[key] = l2
        proposed = max(l2, TIERS.index(r["rule_tier"]))
        force = min(proposed, 3)
        advisory = machine.live(m) >= k_max and before == 0
        if advisory:
            tier.pop(key, None)
        control = False
        if force > 0 and not advisory:
            o = ordinals.get(m, 0)
            digest = hashlib.sha256(f"{m}:{version}:{o // n}".encode()).hexdigest()
            control = o % n == int(digest[:16], 16) % n
            ordinals[m] = o + 1
        out[r["attempt_uid"]] = (TIERS[proposed], TIERS[0 if advisory or control else force], control, advisory)
    return out, machine
