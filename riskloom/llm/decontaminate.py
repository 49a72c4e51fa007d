"""Benchmark decontamination by Wu-Manber search over words.

Items are cut into windows of consecutive words. For each window length a shift table says how far the search may jump
when a block of words cannot end a window, and the last block of a window selects a bucket, within it the first block a
list of windows that are compared word by word. The tables hold at most ``block_windows`` windows; a larger benchmark is
searched in several passes over the same rows, whose marks add up.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.rows import ALNUM, giving_back, slices

#: Words of an item that form a window, and the least share of hit words (1 in so many) of a contaminated document.
WINDOW, SHARE = 13, 20
#: Windows in the tables of one pass: about 100 MB in each worker.
BLOCK_WINDOWS = 200_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


class WuManber:
    """Searches word sequences for windows of one length."""

    def __init__(self, windows: dict[tuple, list], length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key, jump = window[end - self.block : end], length - end
                self.shift[key] = min(self.shift.get(key, jump), jump)
            self.buckets[window[-self.block :]][window[: self.block]].append((window, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(end, items) of every window that ends there."""
        m, b, n = self.length, self.block, len(words)
        far, shift, end = m - b + 1, self.shift, m
        while end <= n:
            key = (words[end - 2], words[end - 1]) if b == 2 else (words[end - 1],)
            jump = shift.get(key, far)
            if jump:
                end += jump
                continue
            for window, items in self.buckets[key].get(tuple(words[end - m : end - m + b]), ()):
                if tuple(words[end - m : end]) == window:
                    yield end, items
            end += 1


def item_windows(words: list[bytes], size: int = WINDOW) -> set[tuple]:
    """Every run of ``size`` words; a shorter item is one window, an item without words none."""
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def searchers(rows: list[tuple], window: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
    for item, text in rows:
        for w in item_windows(words_of(text), window):
            named = by_length[len(w)][w]
            if item is not None:
                named.append(item)
    return [WuManber(windows, n) for n, windows in sorted(by_length.items())]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    carry: list[str] | None = None,
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    share: int = SHARE,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Marks documents that hold windows of benchmark items.

    Adds to the ``carry`` columns (all by default) of every row: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``,
    ``contaminated``, and ``items``, the ids of the items found as sorted strings. Words are runs of letters, digits and
    non-ASCII characters, A-Z in lower case. Null and empty texts have no words and no hits. Items that are null or have
    no words never occur. Items with a null id are searched like any other and only give no name. Repeated items and
    documents are judged row by row. Without items nothing is hit.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = 1 + n_bytes // (4 * block_windows)  # a window starts at a word, and words with their separator take 2 bytes or more
    carry = docs.columns if carry is None else carry
    carry = [c for c in carry if c not in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items")]
    kept = [F.struct(*(F.col(c) for c in carry)).alias("row")]
    state = docs.select(*kept, F.col(text).cast("string").alias("text"), F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    for k in range(passes):
        rows = [(r.item, r.text.encode()) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).toLocalIterator()]
        state = state.mapInArrow(giving_back(_scan(spark.sparkContext.broadcast(rows), window)), state.schema)
    found = T.StructType([*state.schema["row"].dataType.fields, *_FOUND.fields])
    return state.mapInArrow(giving_back(_finish(share, carry)), found)


_FOUND = T.StructType([T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("items", T.ArrayType(T.StringType())))])


def _scan(items, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = searchers(items.value, window)
        for batch in batches:
            for part in slices(batch):
                hits, found = part.column("hits").to_pylist(), part.column("items").to_pylist()
                for i, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    words = words_of(text)
                    marks, names = bytearray(hits[i] or len(words)), set(found[i] or ())
                    for s in search:
                        for end, ids in s.search(words):
                            marks[end - s.length : end] = b"\1" * s.length
                            names.update(ids)
                    hits[i], found[i] = bytes(marks), sorted(names)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), pa.array(hits, pa.binary()), pa.array(found, pa.list_(pa.string()))], ["row", "text", "hits", "items"])

    return run


def _finish(share: int, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            n_words, n_hit = [len(h) for h in hits], [sum(h) for h in hits]
            own = batch.column("row").flatten()
            made = [
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array(map(len, items), pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                pa.array([h > 0 and share * h >= n for h, n in zip(n_hit, n_words, strict=True)]),
                pa.array(items, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*own, *made], [*carry, *_FOUND.names])

    return run
