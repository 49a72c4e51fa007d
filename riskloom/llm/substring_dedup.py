"""Removal of repeated passages, found by recompression.

A window is ``size`` consecutive words. The first occurrence of a window, by (document, start), stays; words covered by a
later one go.

Compression names parts of the text in rounds. The first names runs of one word; every further round splits the symbols
by a bit of their name into left and right ones and names each left-right pair. A name is a hash of what it stands for,
so all tasks give equal parts equal names without exchanging a dictionary. Which words decide that a symbol stands where
it does is known exactly, its reach; if the reach lies within a window, every occurrence of that window has the symbol at
the same place. Each window is represented by the one of least name among such symbols of the highest round that has
one, those of one or two words last. Only if that symbol occurs again, or there is none, can the window occur again: then
windows with the same symbol are compared by a hash of all their words, 128 bits with the symbol's name.

Two exchanges do this, first of symbols, then of the windows left over. Both are dealt by name in packed rows, and a name
that repeats inside a slice of texts is sent once, so a passage of a third of all documents is no bottleneck.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.near_dedup import mixed
from riskloom.llm.rows import Known, numbered, own_ids, slices

SIZE = 20
#: Rounds of pairs, and those whose symbols may represent a window.
ROUNDS, LOWEST = 5, 2

_rng = np.random.default_rng(4)
_SALT = _rng.integers(0, 1 << 63, 64, np.uint64)
_PLACE = _rng.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_PACKED = [("doc", "<u4"), ("name", "<u8"), ("more", "<u8"), ("start", "<i4"), ("span", "u1")]


class Slice:
    """The words of some texts in one row, each text followed by a wall that nothing joins across."""

    def __init__(self, known: Known, texts: list[bytes | None]):
        words = [(t or b"").split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.sizes = sizes
        self.word = np.zeros(int(sizes.sum()) + len(words), np.uint64)
        self.wall = np.zeros(len(self.word), bool)
        self.wall[self.begin + sizes] = True
        self.word[~self.wall] = np.fromiter((known[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))

    def starts(self, size: int) -> np.ndarray:
        """Places where a window starts."""
        n = np.maximum(self.sizes - size + 1, 0)
        return np.repeat(self.begin - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, places, side="right") - 1


def runs(s: Slice) -> tuple[np.ndarray, ...]:
    """(name, reach from, reach to, wall, words) after naming the runs of one word."""
    same = (s.word[1:] == s.word[:-1]) & ~s.wall[1:] & ~s.wall[:-1]
    first = np.flatnonzero(np.append(True, ~same)) if len(s.word) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(s.word)))
    name = s.word[first]
    name = np.where(length > 1, mixed(name + length.astype(np.uint64) * _PLACE[0, 0]), name)
    return name, first - 1, first + length + 1, s.wall[first], length


def pairs(name: np.ndarray, low: np.ndarray, high: np.ndarray, wall: np.ndarray, words: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """The next round: neighbours of a left and a right symbol get one name."""
    left = ((mixed(name ^ _SALT[level]) & np.uint64(1)) == 1) & ~wall
    right = ~left & ~wall
    joined = np.append(left[:-1] & right[1:], False) if len(name) else left
    taken = np.append(False, joined[:-1]) if len(name) else left
    alone_left, alone_right = np.flatnonzero(left & ~joined), np.flatnonzero(right & ~taken)
    at = np.flatnonzero(joined)
    name, low, high, words = name.copy(), low.copy(), high.copy(), words.copy()
    new_high, new_low = high[np.minimum(alone_left + 1, len(high) - 1)], low[np.maximum(alone_right - 1, 0)]
    name[at] = mixed(name[at] * _PLACE[0, 1] + mixed(name[at + 1] ^ _SALT[level + 32]))
    high[at] = high[at + 1]
    words[at] += words[at + 1]
    high[alone_left] = np.maximum(high[alone_left], new_high)
    low[alone_right] = np.minimum(low[alone_right], new_low)
    keep = ~taken
    return name[keep], low[keep], high[keep], wall[keep], words[keep]


def representatives(s: Slice, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, windows) of the symbols that represent windows, and the windows that none represents."""
    levels = [runs(s)]
    for level in range(1, ROUNDS + 1):
        levels.append(pairs(*levels[-1], level))
    left = s.starts(size)
    names, firsts, spans = [], [], []
    for level in range(ROUNDS, LOWEST - 1, -1):
        name, low, high, _, words = levels[level]
        if not len(left) or not len(name):
            break
        named = mixed(name ^ _SALT[level + 16])
        key = (named >> np.uint64(1)) | ((words <= 2).astype(np.uint64) << np.uint64(63))
        first, last = np.searchsorted(low, left), np.searchsorted(high, left + size, side="right") - 1
        fits = first <= last
        first, last, windows = first[fits], last[fits], left[fits]
        symbol = first.copy()
        for k in range(1, int((last - first).max(initial=0)) + 1):
            other = np.minimum(first + k, last)
            symbol = np.where(key[other] < key[symbol], other, symbol)
        cut = (symbol[1:] != symbol[:-1]) | (np.diff(windows) != 1)
        begins = np.flatnonzero(np.append(True, cut)) if len(symbol) else np.zeros(0, np.int64)
        names.append(named[symbol[begins]])
        firsts.append(windows[begins])
        spans.append(np.diff(np.append(begins, len(windows))))
        left = left[~fits]
    empty = np.zeros(0, np.int64)
    return np.concatenate(names or [empty.astype(np.uint64)]), np.concatenate(firsts or [empty]), np.concatenate(spans or [empty]), left


def stretches(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places as (start, length) of at most 255 neighbours."""
    if not len(places):
        return places, places
    begins = np.flatnonzero(np.append(True, np.diff(places) != 1))
    lengths = np.diff(np.append(begins, len(places)))
    parts = -(-lengths // 255)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(places[begins], parts) + 255 * k, np.minimum(np.repeat(lengths, parts) - 255 * k, 255)


def window_hashes(s: Slice, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 64 bits of the words of each window."""
    one, two = np.zeros(len(places), np.uint64), np.zeros(len(places), np.uint64)
    for k in range(size):
        w = mixed(s.word[places + k] + _PLACE[1, k % 256])
        one += w * _PLACE[0, k % 256]
        two += (w >> np.uint64(17)) * _PLACE[1, (k + 128) % 256]
    return mixed(one), mixed(two)


def _order(ids: list) -> np.ndarray:
    """The rank of each id, null last."""
    ranks = {x: k for k, x in enumerate(sorted(set(ids), key=lambda x: (x is None, x if x is not None else 0)))}
    return np.fromiter((ranks[x] for x in ids), np.int64, len(ids))


def _pack(bucket: int, ids: list, asks: bool, columns: dict[str, np.ndarray]) -> tuple:
    # Documents and starts as steps from one to the next, mostly 0 and 1, which compress well.
    columns = {**columns, **{n: np.diff(columns[n].astype(np.int64), prepend=0) for n in ("doc", "start")}}
    return (bucket, ids, asks, *(columns[n].astype(t).tobytes() for n, t in _PACKED))


def _unpack(row: dict) -> dict[str, np.ndarray]:
    columns = {n: np.frombuffer(row[n], t) for n, t in _PACKED}
    return {**columns, **{n: np.cumsum(columns[n].astype("<i4").astype(np.int64)) for n in ("doc", "start")}}


def _deal(ids: list, buckets: int, doc: np.ndarray, name: np.ndarray, more: np.ndarray, start: np.ndarray, span: np.ndarray) -> Iterator[tuple]:
    """A row for each bucket of names."""
    bucket = (name >> np.uint64(7)) % np.uint64(buckets)
    order = np.lexsort((start, doc, bucket))
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        docs, index = np.unique(doc[part], return_inverse=True)
        yield _pack(int(bucket[part[0]]), [ids[d] for d in docs], True, {"doc": index, "name": name[part], "more": more[part], "start": start[part], "span": span[part]})


def _tell(ids: list, doc: np.ndarray, name: np.ndarray, start: np.ndarray, span: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of what is already known about the documents; they only pass through the exchange."""
    order = np.lexsort((start, doc))
    for part in np.array_split(order, max(1, len(order) >> 14)) if len(order) else ():
        docs, index = np.unique(doc[part], return_inverse=True)
        place = xxhash.xxh3_64_intdigest(repr((ids[docs[0]], int(start[part[0]]))).encode()) % buckets
        yield _pack(place, [ids[d] for d in docs], False, {"doc": index, "name": name[part], "more": np.zeros(len(part), np.uint64), "start": start[part], "span": span[part]})


def _emit(rows: Iterator[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    types = [pa.int32(), pa.list_(kind), pa.bool_(), *(pa.binary() for _ in _PACKED)]
    names = ["bucket", "ids", "asks", *(n for n, _ in _PACKED)]
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 256:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _new_words() -> Known:
    return Known(xxhash.xxh3_64_intdigest)


def _symbols(size: int, buckets: int):
    """Sends symbols by name; tells where a window is in question already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _new_words()
        for batch in batches:
            for part in slices(batch):
                yield from _emit(_symbol_rows(known, part, size, buckets), batch.schema.field("id").type)

    return run


def _symbol_rows(known: Known, part: pa.RecordBatch, size: int, buckets: int) -> Iterator[tuple]:
    ids = part.column("id").to_pylist()
    s = Slice(known, part.column("text").cast(pa.binary()).to_pylist())
    name, first, span, left = representatives(s, size)
    _, index, times = np.unique(name, return_inverse=True, return_counts=True)
    leads = np.zeros(len(times), np.int64)
    leads[index[::-1]] = np.arange(len(name))[::-1]
    asked = np.zeros(len(name), bool)
    asked[leads] = True
    again = times[index] > 1
    start, length = stretches(left)
    told = np.concatenate((name[again], np.zeros(len(start), np.uint64)))
    start, length = np.concatenate((first[again], start)), np.concatenate((span[again], length))
    doc = s.document(start)
    yield from _tell(ids, doc, told, start - s.begin[doc], length, buckets)
    doc = s.document(first[asked])
    yield from _deal(ids, buckets, doc, name[asked], np.zeros(int(asked.sum()), np.uint64), first[asked] - s.begin[doc], span[asked])


def _windows(size: int, buckets: int):
    """Sends the windows in question by their words; tells which are repeats already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _new_words()
        for batch in batches:
            for part in slices(batch):
                yield from _emit(_window_rows(known, part, size, buckets), batch.schema.field("id").type)

    return run


def _marks(told: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The places of all (start, span) told about one document, and the names told with them."""
    start, span, name = (np.concatenate([np.frombuffer(m[n], t) for m in told]) for n, t in (("start", "<i4"), ("span", "u1"), ("name", "<u8")))
    span = span.astype(np.int64)
    places, index = np.unique(np.repeat(start - (np.cumsum(span) - span), span) + np.arange(span.sum()), return_index=True)
    return places, np.repeat(name, span)[index]


def _window_rows(known: Known, part: pa.RecordBatch, size: int, buckets: int) -> Iterator[tuple]:
    ids, told = part.column("id").to_pylist(), [_marks(t) for t in part.column("told").to_pylist()]
    s = Slice(known, part.column("text").cast(pa.binary()).to_pylist())
    places, name = np.concatenate([s.begin[k] + t[0] for k, t in enumerate(told)]), np.concatenate([t[1] for t in told])
    doc = s.document(places)
    one, two = window_hashes(s, places, size)
    name = np.where(name == 0, one, name)
    rank = _order(ids)
    order = np.lexsort((places, rank[doc], two, name))
    a, b = name[order], two[order]
    lead = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    later = np.sort(order[~lead])
    if len(later):
        # Neighbours in one document as one stretch; walls keep documents apart.
        start, span = stretches(np.unique(places[later]))
        d = s.document(start)
        yield from _tell(ids, d, np.zeros(len(start), np.uint64), start - s.begin[d], span, buckets)
    first = np.sort(order[lead])
    yield from _deal(ids, buckets, doc[first], name[first], two[first], places[first] - s.begin[doc[first]], np.ones(len(first), np.uint8))


def _buckets(first_stays: bool):
    """Looks at all rows of a bucket together: answers every occurrence of a repeated name, or every one but the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for k in range(0, batch.num_rows, 256):
                for row in batch.slice(k, 256).to_pylist():
                    if held and row["bucket"] != held[0]["bucket"]:
                        yield from _answers(held, first_stays, kind)
                        held = []
                    held.append(row)
        if held:
            yield from _answers(held, first_stays, kind)

    return run


def _answers(rows: list[dict], first_stays: bool, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    asking = [(r["ids"], _unpack(r)) for r in rows if r["asks"]]
    if asking:
        name, more, start, doc = (np.concatenate([c[n] for _, c in asking]) for n in ("name", "more", "start", "doc"))
        n = [len(c["doc"]) for _, c in asking]
        if first_stays:
            base = np.cumsum([0, *(len(ids) for ids, _ in asking[:-1])])
            rank = _order([i for ids, _ in asking for i in ids])[np.repeat(base, n) + doc]
            order = np.lexsort((start, rank, more, name))
        else:
            order = np.argsort(name, kind="stable")
        a, b = name[order], more[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        repeated = np.zeros(len(name), bool)
        repeated[order] = ~new if first_stays else ~new | np.append(~new[1:], False)
        for (ids, columns), hit in zip(asking, np.split(repeated, np.cumsum(n)[:-1]), strict=True):
            out += _by_document(ids, columns, hit, not first_stays)
    for r in rows:
        if not r["asks"]:
            columns = _unpack(r)
            out += _by_document(r["ids"], columns, np.ones(len(columns["doc"]), bool), not first_stays)
    for k in range(0, len(out), 4096):
        columns = zip(*out[k : k + 4096], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.binary(), pa.binary(), pa.binary()), strict=True)], ["id", "start", "span", "name"])


def _by_document(ids: list, columns: dict, hit: np.ndarray, named: bool) -> Iterator[tuple]:
    """(id, starts, spans, names) of the marked places; names are zero where nobody asks for them."""
    doc, start, span, name = (columns[n][hit] for n in ("doc", "start", "span", "name"))
    if not named and len(doc):
        # Neighbours as one stretch, whatever document: a document's places are spread by more than a stretch.
        apart = doc * (1 << 32) + start
        places = np.unique(np.repeat(apart - (np.cumsum(span.astype(np.int64)) - span), span) + np.arange(span.sum(dtype=np.int64)))
        at, span = stretches(places)
        doc, start, name = at >> 32, at & 0xFFFFFFFF, np.zeros(len(at), np.uint64)
    order = np.argsort(doc, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else ():
        yield ids[doc[part[0]]], start[part].astype("<i4").tobytes(), span[part].astype("u1").tobytes(), name[part].astype("<u8").tobytes()


def _exchange(rows: DataFrame, ask, first_stays: bool, kind: T.DataType) -> DataFrame:
    """What is told about each document: ``id``, ``told``."""
    packed = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("asks", T.BooleanType()), *(T.StructField(n, T.BinaryType()) for n, _ in _PACKED)])
    answer = T.StructType([T.StructField("id", kind), T.StructField("start", T.BinaryType()), T.StructField("span", T.BinaryType()), T.StructField("name", T.BinaryType())])
    dealt = rows.mapInArrow(ask, packed).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_buckets(first_stays), answer).groupBy("id").agg(F.collect_list(F.struct("start", "span", "name")).alias("told"))


def remove_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked for, ``kept_text``.

    Words are separated by ASCII white space and compared unchanged. A word goes if a window of ``size`` words covers it
    whose words also start earlier: in a document with a smaller id (null last) or earlier in the same one. Null and empty
    texts and texts shorter than a window lose nothing. Rows that share an id, or have none, are documents of their own, one
    after the other. ``kept_text`` is the kept words joined by one space. Other columns are left out.
    """
    if not 4 <= size <= 255:
        raise ValueError("windows have 4 to 255 words")
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, given = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")), "id"
    if not own_ids(docs, doc_id):
        rows, given = numbered(rows.withColumnRenamed("id", "own"), "own", "id"), "own"
    kind = rows.schema["id"].dataType

    def with_told(told: DataFrame, how: str) -> DataFrame:
        return rows.join(told.withColumnRenamed("id", "of"), F.col("id").eqNullSafe(F.col("of")), how).select("id", *([given] if given != "id" else []), "text", "told")

    questions = _exchange(rows.select("id", "text"), _symbols(size, buckets), False, kind)
    repeats = _exchange(with_told(questions, "inner").select("id", "text", "told"), _windows(size, buckets), True, kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = [_kept(t, told, size) for t, told in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("told").to_pylist(), strict=True)]
                n, gone, kept = zip(*out, strict=True)
                columns = [part.column(given), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                columns += [pa.array([k.decode() for k in kept])] if keep_text else []
                yield pa.RecordBatch.from_arrays(columns, fields.names)

    fields = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    if keep_text:
        fields = fields.add("kept_text", T.StringType())
    return with_told(repeats, "left").select(given, "text", "told").mapInArrow(cut, fields)


def _kept(text: bytes | None, told: list[dict] | None, size: int) -> tuple[int, int, bytes]:
    words = (text or b"").split()
    if not told:
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    starts, _ = _marks(told)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    stays = np.cumsum(edge[:-1]) == 0
    return len(words), int((~stays).sum()), b" ".join(compress(words, stays.tolist()))
