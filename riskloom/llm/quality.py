"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is encoded, a gated attention
softmax_k(w . (tanh(V h_k) * sigmoid(U h_k))) says how much each passage counts, and a logistic layer scores the weighted
sum of the passages. Encoder, gates and scorer are learned together by gradient descent.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.rows import LOWER, map_texts
from riskloom.llm.samples import held_out, labelled_sample

#: Words of a passage; labelled documents of each label to learn from, none with more passages than this.
PASSAGE, PER_LABEL, MOST_PASSAGES = 64, 1_000, 4_096
THRESHOLD = 0.3

#: Sizes of the passage encoding and of the attention gates.
ENCODED, GATES = 16, 8

#: Groups of bytes whose shares describe a passage.
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b"aeiou", b".", b",;:", b"!?", b"|", b"#$%&*@^~+=<>_\\/", b"\"'`()[]{}-", bytes(range(32)) + b"\x7f"]
_SHARES = np.array([[b in g for g in _GROUPS] for b in range(256)], np.float32)
FEATURES = len(_GROUPS) + 6


def features(text: bytes | None) -> np.ndarray:
    """One row of numbers per passage; a text without words is one passage of zeros."""
    words = (text or b"").split()
    out = np.zeros((max(1, -(-len(words) // PASSAGE)), FEATURES), np.float32)
    for k in range(0, len(words), PASSAGE):
        part = words[k : k + PASSAGE]
        row, n, joined = out[k // PASSAGE], len(part), b"".join(part)
        row[: len(_GROUPS)] = np.bincount(np.frombuffer(joined, np.uint8), minlength=256) @ _SHARES / len(joined)
        sizes = list(map(len, part))
        row[len(_GROUPS) :] = (n / PASSAGE, len(set(part)) / n, len(set(joined.translate(LOWER))) / 32, len(joined) / n / 8, min(4, max(sizes) / 16), sum(map(bytes.__eq__, part[1:], part)) / n)
    return out


class Bags:
    """The network and its gradient."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.spread, self.shift = mean, spread, 0.0
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"E": draw(FEATURES, ENCODED), "e": np.zeros(ENCODED), "V": draw(ENCODED, GATES), "U": draw(ENCODED, GATES), "w": draw(GATES), "c": draw(ENCODED), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        p = self.p
        x = (x - self.mean) / self.spread
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * s) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "sizes": sizes, "logit": z @ p["c"] + p["b"][0]}

    def gradient(self, f: dict, starts: np.ndarray, error: np.ndarray) -> dict:
        """``error``: the loss's derivative by each document's logit."""
        p, rows = self.p, lambda v: np.repeat(v, f["sizes"], axis=0)
        dz = error[:, None] * p["c"]
        da = (rows(dz) * f["h"]).sum(1)
        da = f["a"] * (da - rows(np.add.reduceat(f["a"] * da, starts)))
        dt, ds = da[:, None] * f["s"] * p["w"] * (1 - f["t"] ** 2), da[:, None] * f["t"] * p["w"] * f["s"] * (1 - f["s"])
        dh = (rows(dz) * f["a"][:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"E": f["x"].T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"] * da[:, None]).sum(0), "c": f["z"].T @ error, "b": np.array([error.sum()])}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return 1 / (1 + np.exp(-(self.forward(np.concatenate(bags).astype(np.float64), starts)["logit"] + self.shift)))


def train(bags: list[np.ndarray], labels: np.ndarray, prior: float, rounds: int = 250, rate: float = 0.02, decay: float = 1e-3) -> Bags:
    """Fits with both labels counting alike, then moves the scores to the share ``prior`` of label 1 among all labels."""
    x, starts = np.concatenate(bags).astype(np.float64), np.cumsum([0, *map(len, bags[:-1])])
    net = Bags(x.mean(0), x.std(0) + 1e-3)
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    m, v = ({k: np.zeros_like(w) for k, w in net.p.items()} for _ in range(2))
    for k in range(1, rounds + 1):
        f = net.forward(x, starts)
        for name, g in net.gradient(f, starts, weight * (1 / (1 + np.exp(-f["logit"])) - labels)).items():
            g = g + decay * net.p[name]
            m[name], v[name] = 0.9 * m[name] + 0.1 * g, 0.99 * v[name] + 0.01 * g * g
            net.p[name] = net.p[name] - rate * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-8)
    net.shift = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 0.0
    return net


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", per_label: int = PER_LABEL) -> Bags | None:
    """Learns from about ``per_label`` documents of each label, at most ``4 * per_label``, that are not held out; None without any.

    Documents of more than MOST_PASSAGES passages are scored but not learned from. Labels other than 0 and 1 are left out.
    """
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)").filter(~held_out("doc_id"))
    sample, counts = labelled_sample(rows, "label", "doc_id", per_label)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample.dropDuplicates()), "doc_id").limit(4 * per_label)

    def make():
        def work(texts):
            found = [features(t) for t in texts]
            return ([f.tobytes() if len(f) <= MOST_PASSAGES else None for f in found],)

        return work

    rows = map_texts(chosen, make, [("bag", T.BinaryType())], carry=["label"], text="text").filter("bag is not null").collect()
    if not rows:
        return None
    bags = [np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES) for r in rows]
    return train(bags, np.array([r.label for r in rows], float), counts.get(1, 0) / sum(counts.values()))


def score(docs: DataFrame, model: Bags | None, *, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` up) to the ``carry`` columns of every row.

    Null and empty texts are scored as one passage of zeros. Without a model every score is 0.5. Texts are read whole,
    repeated rows each; columns with the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        net = shared.value
        return lambda texts: (net.scores([features(t) for t in texts]) if net else np.full(len(texts), 0.5),)

    carry = docs.columns if carry is None else carry
    rows = docs.withColumn("held_out", held_out(doc_id))
    scored = map_texts(rows, make, [("score", T.DoubleType())], carry=[*carry, "held_out"], text=text)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
