"""Arrow helpers for operators that look at one document at a time, and a store for intermediate tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that separate words.
BLANKS = b" \t\n\x0b\x0c\r"
#: Text bytes held as Python objects at a time; a single longer text is held alone.
SLICE_BYTES = 4 << 20
#: Words remembered by a worker.
KNOWN_WORDS = 400_000

#: Deletes the separators; lower-cases A-Z; lower-cases and blanks out everything but letters, digits and bytes from 128 up.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``limit`` text bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


@cache
def _trim() -> Callable:
    """The C library's call that returns freed memory, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def give_back() -> None:
    """Returns what this worker has freed to the system: workers outlive their tasks, and an executor has more than cores.

    Collecting first empties Python's own lists of free objects, of which a few hold up whole stretches of memory.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def giving_back(run: Callable) -> Callable:
    """``run``, a function from batches to batches, and then ``give_back``."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return mapped


def map_texts(docs: DataFrame, make: Callable, fields: list[tuple[str, T.DataType]], *, carry: list[str], text: str) -> DataFrame:
    """One output row per document: the ``carry`` columns, then ``fields``.

    ``make()`` runs once per task and returns a function from a list of UTF-8 texts (None where the text is null) to one
    list of values per field; its ``end()``, where it has one, is called after the last text. Rows stay where they are: no
    shuffle. A carried column that has the name of a field is replaced by the field.
    """
    new = {name for name, _ in fields}
    carry = [c for c in dict.fromkeys(carry) if c not in new]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in carry] + [T.StructField(n, t) for n, t in fields])
    kinds = [(n, _arrow(t)) for n, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = part.column("__text").cast(pa.binary()).to_pylist()
                gc.disable()  # work makes no cycles, and the collector would walk its caches again and again
                try:
                    values = work(texts)
                finally:
                    gc.enable()
                made = [pa.array(v, k) for v, (_, k) in zip(values, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carry] + made, [*carry, *(n for n, _ in kinds)])
        if hasattr(work, "end"):
            work.end()

    return docs.select(*carry, F.col(text).cast("string").alias("__text")).mapInArrow(giving_back(run), schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class Known(dict):
    """Remembers ``make(key)`` for at most about ``limit`` keys."""

    def __init__(self, make: Callable, limit: int = KNOWN_WORDS):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which the driver and all executors must see.

    Only where the setting is missing and driver and executors are one process, as in tests, a temporary folder stands in;
    it goes when Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark.sparkContext.master)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@cache
def _own_folder(master: str) -> str:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="llm-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    path = scratch(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_ids(docs: DataFrame, doc_id: str) -> bool:
    """Whether every row has an id of its own; reads only the ids."""
    shared = docs.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).filter(F.col(doc_id).isNull() | (F.col("n") > 1))
    return not shared.limit(1).count()


def numbered(docs: DataFrame, doc_id: str, key: str) -> DataFrame:
    """The stored rows with a ``key`` of their own: numbers in the order of the ids, null last, then of a 128-bit hash of
    all columns (maps aside); equal rows come in any order."""
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = stored(docs.withColumn("__nr", F.monotonically_increasing_id()), "rows")
    order = rows.orderBy(F.col(doc_id).asc_nulls_last(), F.xxhash64(*hashed), F.xxhash64(F.lit(1), *hashed), "__nr").select("__nr")
    numbers = stored(order.withColumn(key, F.monotonically_increasing_id()), "row-keys")
    return stored(rows.join(numbers, "__nr").drop("__nr"), "keyed")


def row_keys(docs: DataFrame, doc_id: str, key: str = "__key") -> DataFrame:
    """``docs`` with a column ``key`` that is different for every row and ordered like the ids, null last: the id itself
    where every row has its own, or else the rows are ``numbered``."""
    return docs.withColumn(key, F.col(doc_id)) if own_ids(docs, doc_id) else numbered(docs, doc_id, key)
