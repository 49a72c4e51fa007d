"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; for each bit a logistic classifier over hashed byte n-grams predicts which
sign the text's language has. Decoding adds, for each language, the logistic losses of the bits' margins against its
codeword, weighted by how well each bit is predicted on the sample, and picks the least sum; a small lead over the
second marks the text as ambiguous.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.rows import LOWER, map_texts
from riskloom.llm.samples import held_out, labelled_sample

#: Hash buckets of the n-grams of 1 to 3 bytes, and bytes of a text looked at together.
BUCKETS, BLOCK = 1 << 15, 1 << 16
#: Labelled documents of each language that the bits are learned from.
PER_LANGUAGE = 400
#: Lead in loss below which a prediction is ambiguous.
LEAD = 0.5
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 per class: all splits for few classes, else ten random bits for each doubling of the classes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = np.arange(1, 1 << (n - 1))
        bits = (splits[None, :] >> np.arange(n)[:, None]) & 1
    else:
        rng = np.random.default_rng(11)
        while True:
            bits = rng.integers(0, 2, (n, math.ceil(10 * math.log2(n))))
            if len(np.unique(bits, axis=0)) == n and (bits.min(0) != bits.max(0)).all():
                break
    return bits * 2.0 - 1.0


def ngrams(text: bytes) -> np.ndarray:
    """Hash buckets of all n-grams."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    grams = [b + np.uint32(1), b[:-1] * np.uint32(257) + b[1:] + np.uint32(1 << 10), (b[:-2] * np.uint32(257) + b[1:-1]) * np.uint32(257) + b[2:] + np.uint32(1 << 20)]
    return (np.concatenate(grams) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def blocks(text: bytes):
    """The n-gram buckets of a text, block by block, each n-gram once."""
    text = text.translate(LOWER)
    for start in range(0, len(text), BLOCK):
        yield ngrams(text[max(0, start - 2) : start + BLOCK]) if start == 0 else _later(text, start)


def _later(text: bytes, start: int) -> np.ndarray:
    with_lead, lead = ngrams(text[start - 2 : start + BLOCK]), ngrams(text[start - 2 : start])
    counts = np.bincount(with_lead, minlength=BUCKETS) - np.bincount(lead, minlength=BUCKETS)
    return np.repeat(np.arange(BUCKETS), counts)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # bucket x bit
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def margins(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for grams in blocks(text):
            total += self.weights[grams].sum(axis=0, dtype=np.float64)
            n += len(grams)
        return total / max(1, n) + self.bias

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        loss = (self.trust * np.logaddexp(0, -self.code * self.margins(text))).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        odds = np.exp(loss[order[0]] - loss)
        return self.languages[order[0]], float(1 / odds.sum()), bool(len(order) > 1 and loss[order[1]] - loss[order[0]] < LEAD)


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Learns from about ``per_language`` documents of each language that are not held out; None without any.

    The sample's n-gram counts, at most BUCKETS for a document, come to the driver.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    sample, _ = labelled_sample(rows.filter(~held_out("doc_id") & F.col("text").rlike(r"\p{L}")), "lang", "doc_id", per_language)

    def counted():
        def work(texts):
            both = [np.unique(np.concatenate(list(blocks(t))), return_counts=True) for t in texts]
            return [b.astype("<u4").tobytes() for b, _ in both], [(n / n.sum()).astype("<f4").tobytes() for _, n in both]

        return work

    rows = map_texts(sample, counted, [("buckets", T.BinaryType()), ("shares", T.BinaryType())], carry=["lang"], text="text").collect()
    languages = sorted({r.lang for r in rows})
    return _train(languages, [(languages.index(r.lang), np.frombuffer(r.buckets, "<u4"), np.frombuffer(r.shares, "<f4")) for r in rows]) if rows else None


def _train(languages: list[str], rows: list[tuple], rounds: int = 60, scale: float = 100.0) -> LanguageModel:
    code = codewords(len(languages))
    labels = np.array([k for k, _, _ in rows])
    target = (code[labels] + 1) / 2
    row_of = np.repeat(np.arange(len(rows)), [len(b) for _, b, _ in rows])
    bucket, share = np.concatenate([b for _, b, _ in rows]).astype(np.int64), np.concatenate([s for _, _, s in rows]) * scale
    weight = 1.0 / np.bincount(labels)[labels] / len(languages)  # each language counts alike
    weights, bias, trust = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.ones(code.shape[1])
    for bit in range(code.shape[1]):
        w, b, m, v, step = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), 0.05
        for k in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-(np.bincount(row_of, share * w[bucket], len(rows)) + b)))
            g = weight * (p - target[:, bit])
            grad = np.append(np.bincount(bucket, share * g[row_of], BUCKETS) + 1e-5 * w, g.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            move = step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
            w, b = w - move[:-1], b - move[-1]
        right = ((p > 0.5) == (target[:, bit] > 0.5)) @ weight
        weights[:, bit], bias[bit], trust[bit] = w * scale, b, max(0.0, 2 * right - 1)
    return LanguageModel(languages, code, weights, bias, trust if trust.sum() > 0 else np.ones_like(trust))


def identify(docs: DataFrame, model: LanguageModel | None, *, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` to the ``carry`` columns of every row.

    Null texts, texts without a letter, and all texts where nothing was learned are ``und`` with score 0. Texts are read
    whole, repeated rows each; columns with the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value

        def work(texts):
            out = [known.predict(t) if known and t and _LETTER.search(t.decode()) else (UNKNOWN, 0.0, False) for t in texts]
            return tuple(map(list, zip(*out, strict=True)))

        return work

    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType())]
    return map_texts(docs, make, fields, carry=docs.columns if carry is None else carry, text=text)
