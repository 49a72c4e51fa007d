"""Ranked lexical search by two trees: one over the items, one over the documents of a chunk.

A node holds, for every term below it, the largest weight (items) or the largest impact (documents). The sum of products of
two nodes bounds every score of an item and a document below them, so a pair of nodes whose bound is under the weakest k-th
score of its items is dropped whole, without losing a result. First k-th scores come from a sample of the documents; they
only speed the search up, the results are those of all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from riskloom.llm.rows import ALNUM, map_texts, stored

#: Results of an item; bytes of item text searched for in one pass over the documents.
BEST, BLOCK_BYTES = 50, 16 << 20
#: Documents and term entries of a chunk, documents of a leaf, children of a node over documents and over items.
CHUNK_ROWS, CHUNK_ENTRIES, LEAF, FAN, ITEM_FAN = 8192, 1 << 20, 16, 8, 4
#: Documents in the sample that gives the first k-th scores, about; leaves scored at once; bytes of a text split at once.
SEED_ROWS, LEAVES, PIECE = 8192, 32, 1 << 20
#: Parts in which the candidates of an item are ranked before they meet.
PARTS = 64


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, a stretch of about a megabyte at a time, cut between terms."""
    text = (text or b"").translate(ALNUM)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + PIECE) if len(text) - start > PIECE else len(text)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


class Level:
    """Nodes of one level: for each the terms below it in ascending order and their largest values."""

    def __init__(self, node: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int):
        key = node.astype(np.int64) * n_terms + term
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.value = np.maximum.reduceat(value[order], first)
        self.node, self.term = key[first] // n_terms, key[first] % n_terms
        self.size = int(self.node[-1]) + 1
        self.start = np.searchsorted(self.node, np.arange(self.size + 1))

    def sums(self, nodes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each of ``nodes``, which all have terms, the sum of values times weights."""
        many = self.start[nodes + 1] - self.start[nodes]
        ends = np.cumsum(many)
        at = np.arange(ends[-1]) + np.repeat(self.start[nodes] - ends + many, many)
        return np.add.reduceat(self.value[at] * weight[self.term[at]], ends - many)


def levels(node: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int, fan: int, leaf: int = 1) -> list[Level]:
    """The hierarchy over rows 0, 1, ...: rows, then nodes of ``leaf`` rows, then of ``fan`` nodes each up to a few."""
    out = [Level(node, term, value, n_terms)]
    while out[-1].size > fan or len(out) == 1:
        by = leaf if len(out) == 1 else fan
        out.append(Level(out[-1].node // by, out[-1].term, out[-1].value, n_terms))
    return out


def strongest_first(start: np.ndarray, term: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """An order of rows that puts rows with the same strongest two terms side by side. Every row has a term."""
    row = np.repeat(np.arange(len(start) - 1), np.diff(start))
    by = np.lexsort((term, -strength, row))
    one, two = by[start[:-1]], by[np.minimum(start[:-1] + 1, start[1:] - 1)]
    return np.lexsort((-strength[one], term[two], term[one]))


class Items:
    """The items of a block: their terms and weights, and the hierarchy over them. Pickled once, held by every worker."""

    def __init__(self, names: list, terms: list[np.ndarray], weight: np.ndarray):
        some = [i for i, t in enumerate(terms) if len(t)]
        lengths = np.array([len(terms[i]) for i in some])
        flat = np.concatenate([terms[i] for i in some])
        start = np.concatenate([[0], np.cumsum(lengths)])
        order = strongest_first(start, flat, weight[flat])
        self.names = [names[some[i]] for i in order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.weight = weight
        self.levels = levels(np.repeat(place, lengths), flat, weight[flat], len(weight), ITEM_FAN, ITEM_FAN)


class Search:
    """Results so far of all items of a block, as ascending (minus score, no id, id), and the searches that add to them."""

    def __init__(self, items: Items, k: int, floors: dict[int, int]):
        self.items, self.k = items, k
        self.best: list[list[tuple]] = [[] for _ in items.names]
        self.least = np.array([max(1, floors.get(i, 1)) for i in range(len(items.names))], np.int64)
        self.scratch = np.zeros(len(items.weight), np.int64)

    def add(self, ids: list, start: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """Searches documents that all have terms of the items."""
        order = strongest_first(start, term, impact * self.items.weight[term])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.tree = levels(np.repeat(place, np.diff(start)), term, impact, len(self.items.weight), FAN, LEAF)
        self.ids = [ids[i] for i in order]
        by_id = sorted(range(len(ids)), key=lambda i: (self.ids[i] is None, self.ids[i]))
        self.id_rank = np.empty(len(ids), np.int64)
        self.id_rank[by_id] = np.arange(len(ids))
        top = len(self.items.levels) - 1
        for node in range(self.items.levels[top].size):
            self.visit(top, node, len(self.tree) - 1, np.arange(self.tree[-1].size))

    def visit(self, height: int, node: int, depth: int, nodes: np.ndarray) -> None:
        """Searches the items below a node of their tree among the documents below ``nodes`` of theirs."""
        above = self.items.levels[height]
        mine = slice(above.start[node], above.start[node + 1])
        self.scratch[above.term[mine]] = above.value[mine]
        bound = self.tree[depth].sums(nodes, self.scratch)
        if height == 0 and depth == 1:
            self.score(node, nodes, bound)
            self.scratch[above.term[mine]] = 0
            return
        self.scratch[above.term[mine]] = 0
        nodes = nodes[bound >= self.weakest(height, node)]
        if not len(nodes):
            return
        if depth > 1:
            fan = FAN
            nodes = (nodes[:, None] * fan + np.arange(fan)).ravel()
            nodes, depth = nodes[nodes < self.tree[depth - 1].size], depth - 1
        if height:
            for child in range(node * ITEM_FAN, min(node * ITEM_FAN + ITEM_FAN, self.items.levels[height - 1].size)):
                self.visit(height - 1, child, depth, nodes)
        else:
            self.visit(0, node, depth, nodes)

    def weakest(self, height: int, node: int) -> int:
        span = ITEM_FAN**height
        return int(self.least[node * span : (node + 1) * span].min())

    def score(self, item: int, leaves: np.ndarray, bound: np.ndarray) -> None:
        """Scores the documents of the leaves, those of the highest bounds first; the item's weights are in the scratch."""
        order = np.argsort(-bound, kind="stable")
        for lo in range(0, len(order), LEAVES):
            some = order[lo : lo + LEAVES]
            some = leaves[some[bound[some] >= self.least[item]]]
            if not len(some):
                return
            rows = (some[:, None] * LEAF + np.arange(LEAF)).ravel()
            rows = rows[rows < len(self.ids)]
            score = self.tree[0].sums(rows, self.scratch)
            good = score >= self.least[item]
            rows, score = rows[good], score[good]
            for i in np.lexsort((self.id_rank[rows], -score))[: self.k].tolist():
                one = self.ids[rows[i]]
                self.best[item].append((-int(score[i]), one is None, one))
            self.best[item].sort()
            del self.best[item][self.k :]
            if len(self.best[item]) == self.k:
                self.least[item] = max(self.least[item], -self.best[item][-1][0])


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L, in integers; n and tf by entry."""
    wide = n.astype(object) if 50 * n_docs * int(n.max(initial=0)) >= 1 << 63 else n
    m = 50 + ((50 * wide * n_docs) // n_terms).astype(np.int64)
    return (10**9 * tf) // (1000 * tf + 20 * m)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = BEST,
    block_bytes: int = BLOCK_BYTES,
    seed_rows: int = SEED_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score`` (above 0).

    Terms are runs of letters, digits and non-ASCII characters with A-Z in lower case; null and empty texts have none. Rows
    of ``items`` with one id, null included, are one item with the terms of all of them; an item without terms, or whose
    terms occur nowhere, gets no rows. Every row of ``docs`` is a document of its own, also where ids repeat or are null;
    equal scores rank by id, null last. Other columns are not read. Items are searched for in blocks of about
    ``block_bytes``, a pass over the documents each; a block's terms and its items' results are what a worker holds.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + n_bytes // block_bytes
    schema = T.StructType([items.schema["item_id"], T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.LongType())])
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toLocalIterator()
        found = found.unionByName(_search_block(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), mine, schema, k, seed_rows, chunk_rows))
    ranked = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, items: Iterator, schema: T.StructType, k: int, seed_rows: int, chunk_rows: int) -> DataFrame:
    spark = docs.sparkSession
    known: dict[bytes, int] = {}
    terms: dict = {}
    for r in items:
        mine = terms.setdefault(r.item_id, set())
        for words in pieces(r.text.encode()):
            mine.update(known.setdefault(w, len(known)) for w in words)
    if not known:
        return spark.createDataFrame([], schema)

    shared = spark.sparkContext.broadcast(known)

    def make():
        get = shared.value.get

        def count(texts: list) -> tuple:
            sizes, found, times = [], [], []
            for text in texts:
                n, counts = 0, Counter()
                for words in pieces(text):
                    n += len(words)
                    counts.update(map(get, words))
                counts.pop(None, None)
                sizes.append(n)
                found.append(list(counts))
                times.append(list(counts.values()))
            return sizes, found, times

        return count

    fields = [("n", T.LongType()), ("terms", T.ArrayType(T.IntegerType())), ("tf", T.ArrayType(T.LongType()))]
    counted = stored(map_texts(docs, make, fields, carry=["doc_id"], text="text").filter("n > 0"), "counted")
    shared.unpersist()
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r[0]: r[1] for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    if not df:
        return spark.createDataFrame([], schema)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(len(known))], np.int64)
    names = list(terms)
    block = Items(names, [np.array(sorted(t for t in terms[x] if weight[t]), np.int64) for x in names], weight) if weight.any() else None
    if block is None:
        return spark.createDataFrame([], schema)
    entries = counted.filter(F.size("terms") > 0)

    def candidates(rows: DataFrame, floors: dict[int, int]) -> DataFrame:
        held = spark.sparkContext.broadcast((block, floors))
        kind = T.StructType([T.StructField("item", T.IntegerType()), *schema.fields])
        types = [_arrow(f.dataType) for f in kind.fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, floors = held.value
            search = Search(block, k, floors)
            for batch in batches:
                sizes = batch.column("terms").value_lengths().to_numpy()
                ends = np.cumsum(sizes)
                lo = 0
                while lo < len(sizes):
                    hi = max(lo + 1, min(lo + chunk_rows, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK_ENTRIES, side="right"))))
                    _add(search, batch.slice(lo, hi - lo), n_docs, n_terms)
                    lo = hi
            rows = [(i, block.names[i], one, -far) for i, best in enumerate(search.best) for far, _, one in best]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], kind.names)

        made = rows.mapInArrow(run, kind)
        for by in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))], ["item"]):
            best = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            made = made.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return made

    step = max(1, n_docs // seed_rows)
    sample = candidates(entries.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0), {})
    floors = {r["item"]: r["score"] for r in sample.filter(F.col("rank") == k).select("item", "score").collect()}
    return stored(candidates(entries, floors).select(schema.names), "candidates")


def _add(search: Search, batch: pa.RecordBatch, n_docs: int, n_terms: int) -> None:
    sizes = batch.column("terms").value_lengths().to_numpy().astype(np.int64)
    term = batch.column("terms").flatten().to_numpy().astype(np.int64)
    tf, n = batch.column("tf").flatten().to_numpy(), np.repeat(batch.column("n").to_numpy(), sizes)
    heavy = search.items.weight[term] > 0  # a term that all documents hold adds nothing
    kept = np.add.reduceat(heavy.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    ids = batch.column("doc_id").to_pylist()
    if heavy.any():
        start = np.concatenate([[0], np.cumsum(kept[kept > 0])])
        search.add([x for x, m in zip(ids, kept, strict=True) if m], start, term[heavy], impacts(tf[heavy], n[heavy], n_docs, n_terms))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
