"""Exact deduplication with Grace hash tables.

Each task first folds equal contents of its own rows, so a content that fills a third of the table is sent once per task.
Spark's shuffle deals the contents by digest; a task then holds its bucket in an open-addressing table that compares
complete contents. A bucket that does not fit is dealt into spill files by further bits of the hash, and each file is
treated the same way. Groups come back to the documents by a join on the digest, which Spark may split where skewed.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.rows import BLANKS, giving_back, map_texts, slices

#: Bytes of distinct content in a table before it spills; files it spills to; how often a file is dealt again.
TABLE_BYTES, FAN_BITS, DEPTH = 48 << 20, 4, 12


def normalised(text: bytes | None) -> bytes:
    return (text or b"").translate(None, BLANKS)


def better(a: tuple, b: tuple) -> tuple:
    """Of two (code points, id) the one that stays: more code points, then the smaller id; null ids last."""
    return a if (-a[0], a[1] is None, a[1]) <= (-b[0], b[1] is None, b[1]) else b


class OpenTable:
    """Contents in slots found by linear probing; a slot is a hit only if the whole content is equal."""

    def __init__(self):
        self.slots: list[int] = [-1] * 64
        self.entries: list[list] = []  # hash, content, best, count
        self.n_bytes = 0

    def add(self, key: int, content: bytes, best: tuple, count: int) -> None:
        at = self._find(key, content)
        if (k := self.slots[at]) >= 0:
            entry = self.entries[k]
            entry[2], entry[3] = better(entry[2], best), entry[3] + count
            return
        self.slots[at] = len(self.entries)
        self.entries.append([key, content, best, count])
        self.n_bytes += len(content) + 200
        if 2 * len(self.entries) > len(self.slots):
            self._grow()

    def _find(self, key: int, content: bytes) -> int:
        slots, mask = self.slots, len(self.slots) - 1
        at = key & mask
        while (k := slots[at]) >= 0 and not (self.entries[k][0] == key and self.entries[k][1] == content):
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for k, (key, *_) in enumerate(self.entries):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def grace(records: Iterable[tuple], limit: int = TABLE_BYTES, level: int = 0) -> Iterator[list]:
    """One (hash, content, best, count) per distinct content of ``records``, which have the same form.

    Equal contents must have equal hashes of 64 bits. ``level`` counts the bits already dealt by, from the top.
    """
    table, records = OpenTable(), iter(records)
    for record in records:
        table.add(*record)
        if table.n_bytes > limit and level < DEPTH:
            break
    else:
        yield from table.entries
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        paths = [Path(folder, str(k)) for k in range(1 << FAN_BITS)]
        files = [p.open("wb") for p in paths]
        shift = 64 - FAN_BITS * (level + 1)
        for source in (table.entries, records):
            for record in source:
                pickle.dump(tuple(record), files[(record[0] >> shift) & (len(files) - 1)])
        del table
        for f in files:
            f.close()
        for p in paths:
            yield from grace(_read(p), limit, level + 1)
            p.unlink()


def _read(path: Path) -> Iterator[tuple]:
    with path.open("rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def distinct_texts(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct text: ``digest`` (SHA-256, hex), ``keep_id``, ``keep_points``, ``group_size``."""
    kind = docs.schema[doc_id].dataType
    partial = T.StructType([T.StructField("digest", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("points", T.LongType()), T.StructField("id", kind), T.StructField("n", T.LongType())])
    final = T.StructType([T.StructField("digest", T.StringType()), T.StructField("keep_id", kind), T.StructField("keep_points", T.LongType()), T.StructField("group_size", T.LongType())])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = OpenTable()
        for batch in batches:
            ids = batch.schema.field("id").type
            for part in slices(batch):
                for key, t in zip(part.column("id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    content = normalised(t)
                    table.add(hash(content) & (1 << 64) - 1, content, (len((t or b"").decode()), key), 1)
                if table.n_bytes > table_bytes:
                    yield _batch(table.entries, ids)
                    table = OpenTable()
        if table.entries:
            yield _batch(table.entries, ids)

    def _batch(entries: list[list], ids: pa.DataType) -> pa.RecordBatch:
        columns = [hashlib.sha256(e[1]).hexdigest() for e in entries], [e[1] for e in entries], [e[2][0] for e in entries], pa.array([e[2][1] for e in entries], ids), [e[3] for e in entries]
        return pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, list) else c for c, k in zip(columns, (pa.string(), pa.binary(), pa.int64(), ids, pa.int64()), strict=True)], partial.names)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.DataType] = []

        def records():
            for batch in batches:
                ids[:] = [batch.schema.field("id").type]
                for part in slices(batch, "content"):
                    for d, c, p, i, n in zip(*(part.column(x).to_pylist() for x in partial.names), strict=True):
                        yield int(d[-16:], 16), c, (p, i), n

        found: list[tuple] = []
        for _, content, (points, key), n in grace(records(), table_bytes):
            found.append((hashlib.sha256(content).hexdigest(), key, points, n))
            if len(found) == 4096:
                yield _groups(found, ids[0])
                found = []
        if found:
            yield _groups(found, ids[0])

    def _groups(found: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        columns = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), ids, pa.int64(), pa.int64()), strict=True)], final.names)

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(giving_back(folded), partial).repartition("digest").mapInArrow(giving_back(grouped), final)


def exact_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Adds ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` to the ``carry`` columns of every row.

    Texts are equal when they are after deleting ASCII white space; null is empty, and empty texts are equal. Of equal
    texts the row with the most code points stays, then the one with the smallest id (null last). Rows that share id and
    text count each, and stay or go together. Columns with the new names are replaced.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("keep_id", "group_size", "kept", "text_sha256")]

    def make():
        def work(texts):
            return [hashlib.sha256(normalised(t)).hexdigest() for t in texts], [len((t or b"").decode()) for t in texts]

        return work

    fields = [("text_sha256", T.StringType()), ("__points", T.LongType())]
    members = map_texts(docs.withColumn("__id", F.col(doc_id)), make, fields, carry=[*carry, "__id"], text=text)
    groups = distinct_texts(docs, text=text, doc_id=doc_id, table_bytes=table_bytes).withColumnRenamed("digest", "text_sha256")
    kept = F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__points") == F.col("keep_points"))
    return members.join(groups, "text_sha256").select(*carry, "keep_id", "group_size", kept.alias("kept"), "text_sha256")
