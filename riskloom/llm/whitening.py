"""Whitening of embeddings by a weighted covariance over distinct vectors.

Equal vectors are grouped, a group's weight is its number of rows or one, the covariance is a weighted sum of centred
matrix products, every distinct vector is whitened once, and the rows get their values by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.rows import stored
from riskloom.llm.vectors import common_length, finite, matrix, packed, products, sums

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components by default.
COMPONENTS = 32


def square_sums(diff: np.ndarray) -> list[Decimal]:
    """Exact sums of the squares of rows of 64-bit integers: limbs of 24 bits, whose products add up over 16,384 entries."""
    a, b, c = diff >> 48, (diff >> 24) & 0xFFFFFF, diff & 0xFFFFFF
    parts = [(u * v).sum(axis=1).tolist() for u, v in ((a, a), (a, b), (a, c), (b, b), (b, c), (c, c))]
    return [Decimal((aa << 96) + (ab << 73) + ((2 * ac + bb) << 48) + (bc << 25) + cc) for aa, ab, ac, bb, bc, cc in zip(*parts, strict=True)]


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, weights: str = "count") -> DataFrame:
    """A row for every usable row of ``vectors`` and component, at most ``components`` of them.

    Columns: ``vec_id``, ``component`` (from 1, by falling eigenvalue), ``n`` (sum of the weights), ``deviation`` (exact
    sum over dimensions of (n*x - S)^2, a decimal), ``whitened``, ``explained``, ``identity_error``. ``x`` are the entries
    as integers, ``S`` their weighted sums. With ``weights="count"`` a distinct vector counts once for each of its rows,
    with ``"one"`` once.

    Left out: rows whose vector is null, empty, or holds null or non-finite entries, and vectors of another length than
    most have. Ids may be null or repeated: every row comes back under its id. Components without variance (below
    d x 2^-52 of the largest, which is rounding) cannot be whitened and are left out, so equal vectors alone, a single row
    and an empty table give no rows. Other columns are not read. Entries must stay below 2^40 in size.
    """
    if weights not in ("count", "one"):
        raise ValueError("weights: count or one")
    usable = vectors.filter(finite(F.col(vector))).select(
        F.col(vec_id).alias("id"),
        F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long")).alias("x"),
    )
    packs = stored(packed(usable, "x", "id"), "packs")
    d = common_length(packs.select("x", F.explode("ids")), "x")
    packs = packs.filter(F.size("x") == d)
    weight = F.sum(F.size("ids")).cast("long") if weights == "count" else F.lit(1).cast("long")
    distinct = stored(packs.groupBy("x").agg(weight.alias("weight")), "distinct")

    n = distinct.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    total = np.array(sums(distinct, "x", "weight"), dtype=np.int64)
    covariance = products(distinct, "x", "weight", lambda x: (n * x - total) / n, d) / max(n, 1)
    values, basis = np.linalg.eigh(covariance) if d else (np.zeros(0), np.zeros((0, 0)))
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    whole = values > d * np.finfo(float).eps * max(values[:1], default=0.0)
    values, basis = values[whole], basis[:, whole]
    explained = [float(e / np.trace(covariance)) for e in values]
    project = basis / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            diff = n * matrix(batch.column("x")) - total
            white, far = (diff / n) @ project, square_sums(diff)
            yield pa.RecordBatch.from_arrays(
                [batch.column("x"), batch.column("weight"), pa.array(list(white), pa.list_(pa.float64())), pa.array(far, pa.decimal128(38, 0))], ["x", "weight", "white", "deviation"]
            )

    schema = "x array<long>, weight long, white array<double>, deviation decimal(38,0)"
    white = stored(distinct.mapInArrow(run, schema) if len(values) else distinct.limit(0).selectExpr("x", "weight", "cast(null as array<double>) white", "cast(null as decimal(38,0)) deviation"), "white")
    means = np.array(sums(white, "white", "weight")) / max(n, 1)
    error = float(np.abs(products(white, "white", "weight", lambda w: w - means, len(values)) / max(n, 1) - np.eye(len(values))).max(initial=0.0))

    shares = F.array(*(F.lit(e) for e in explained)) if explained else F.array().cast("array<double>")
    rows = packs.join(white, "x").select(F.explode("ids").alias("vec_id"), "white", "deviation")
    return rows.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
