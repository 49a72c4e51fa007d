"""Rows of vectors: which of them count, equal vectors packed together, sums of products over a table of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids in one pack, and bytes of vectors that a task holds while it packs.
PACK_IDS, PACK_BYTES = 1024, 64 << 20


def finite(vector: Column) -> Column:
    """True where the vector is there, has entries, and every entry is a finite number."""
    entries = vector.cast("array<double>")
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(entries) > 0) & sound, F.lit(False))


def common_length(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have, the smaller one where two tie; 0 without rows."""
    found = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found["d"] if found else 0


def packed(rows: DataFrame, key: str, ids: str, most: int | None = None) -> DataFrame:
    """``key``, ``ids``: equal vectors of a task share rows of up to ``PACK_IDS`` ids.

    A vector that very many rows have arrives at a shuffle as one row for 1,024 of them. With ``most``, a task keeps of
    each vector the ``most`` smallest ids, without null, and a vector is one row of a task's pack.
    """
    schema = T.StructType([rows.schema[key], T.StructField("ids", T.ArrayType(rows.schema[ids].dataType))])
    key_type, id_type = _arrow(rows.schema[key].dataType), _arrow(schema["ids"].dataType)

    def emit(held: dict) -> pa.RecordBatch:
        lengths = [len(k) // 8 for k in held]
        flat = np.frombuffer(b"".join(held), dtype=np.dtype(key_type.value_type.to_pandas_dtype()))
        keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat, key_type.value_type))
        return pa.RecordBatch.from_arrays([keys.cast(key_type), pa.array(list(held.values()), id_type)], [key, "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            vectors = batch.column(key)
            values, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for i, one in enumerate(batch.column(ids).to_pylist()):
                k = values[offsets[i] : offsets[i + 1]].tobytes()
                if k not in held:
                    held[k] = []
                    size += len(k)
                held[k].append(one)
                size += 16
                if len(held[k]) >= PACK_IDS:
                    if most is None:
                        yield emit({k: held.pop(k)})
                        size -= len(k) + 16 * PACK_IDS
                    else:
                        held[k] = smallest(held[k])
            if size > PACK_BYTES:
                yield emit({k: smallest(v) for k, v in held.items()})
                held, size = {}, 0
        if held:
            yield emit({k: smallest(v) for k, v in held.items()})

    def smallest(found: list) -> list:
        return found if most is None else sorted({x for x in found if x is not None})[:most]

    return rows.select(key, ids).mapInArrow(run, schema)


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of one length in a list column as rows; without a copy where Arrow allows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def sums(rows: DataFrame, vector: str, weight: str) -> list:
    """Weighted sums of the vectors by dimension: combined before the shuffle, one row per dimension comes back."""
    entries = rows.select(F.posexplode(vector).alias("j", "c"), weight)
    return [r[1] for r in entries.groupBy("j").agg(F.sum(F.col("c") * F.col(weight))).orderBy("j").collect()]


def products(rows: DataFrame, vector: str, weight: str, centre, d: int) -> np.ndarray:
    """Sum of ``weight * centred * centred'`` over all rows: matrix products within tasks, added up by entry.

    ``centre(X)`` gives the centred rows of a batch. A task sends d x d numbers, whatever its rows; the sums come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            y = centre(matrix(batch.column(vector)))
            total += (y * batch.column(weight).to_numpy().astype(float)[:, None]).T @ y
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    parts = rows.select(vector, weight).mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "c"))
    total = np.zeros((d, d))
    for r in parts.groupBy("i", "j").agg(F.sum("c").alias("c")).collect():
        total[r.i, r.j] = r.c
    return total


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
