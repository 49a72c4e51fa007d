"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its 5-word shingles; documents with equal sets are one class and only the smallest id goes on.
Every tree starts by putting documents with the same minwise token of one coordinate into a node. Nodes of few documents
are compared exhaustively. Documents of larger nodes branch: one child for the minwise token of each of BRANCHES further
coordinates, down to DEPTH; a node of which a child would hold more than half is dense and compared as it is. A pair of
similarity s survives a level with 1 - (1 - s) ** BRANCHES and a tree with at least s times that for every level; there are
as many independent trees as miss a pair at the threshold about once in a million.

Components need no pair whose ends are linked already. A first pass compares each document only with the most central of
its node in the first tree, the one whose minwise tokens most other documents share. The second pass compares, in every node, the documents outside the node's most frequent
component with all documents; both sides are dealt into blocks, so a node of any size is many bounded tasks and no pair
is left out. Documents are compared by sketches of all minwise tokens first; a pair at the threshold is lost there less
than once in a million. Groups of documents that promising pairs connect are then compared on their full sets, so a text is
fetched once per pass however many nodes its document is in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.graph import components
from riskloom.llm.rows import LOWER, Known, giving_back, map_texts, slices, stored

SHINGLE, PERCENT = 5, 85
#: Shape of the trees; documents of a node that is compared as it is; documents of one side of a block whose texts are compared,
#: and of one whose sketches are, which are small.
BRANCHES, DEPTH, SMALL, BLOCK, SKETCH_BLOCK = 3, 3, 16, 128, 1024
#: Minwise coordinates that trees branch by, and those of a sketch (8 bits of each).
COORDINATES, SKETCH = 36, 160
#: The least threshold that the coordinates are enough for, in percent, and the share of pairs at it that trees may miss.
LEAST_PERCENT, MISSED = 60, 1e-6
#: Coordinates that say how central a document is.
CENTRAL = 24

_rng = np.random.default_rng(9)
_MULTIPLY = _rng.integers(0, 1 << 31, SKETCH, np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _rng.integers(0, 1 << 32, SKETCH, np.uint32)
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(known: Known, text: bytes | None) -> np.ndarray:
    words = (text or b"").translate(LOWER).split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(known: Known, text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles; the whole sequence is one where there are fewer words than a shingle has."""
    words = word_hashes(known, text)
    n = len(words)
    if n == 0:
        return words
    size = min(SHINGLE, n)
    total = np.full(n - size + 1, np.uint64(size), np.uint64)
    for k in range(size):
        total += mixed(words[k : n - size + 1 + k] ^ _PLACE[k]) * _PLACE[k]
    return np.unique(mixed(total))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least hash of the set in each coordinate."""
    high, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(high), 1024):
        np.minimum(least, ((high[k : k + 1024, None] ^ _FLIP) * _MULTIPLY).min(0), out=least)
    return least


def new_words() -> Known:
    return Known(xxhash.xxh3_64_intdigest)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < percent * large:
        return False
    both = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
    return 100 * both >= percent * (small + large - both)


def signatures(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``id``, ``n_shingles``, ``set_hash`` (128 bits of the whole set), ``mins`` and ``sketch`` (null for an empty set)."""

    def make():
        known = new_words()

        def work(texts):
            sets = [shingle_set(known, t) for t in texts]
            least = [minwise(s) if len(s) else None for s in sets]
            mins = [None if m is None else m[:COORDINATES].view(np.int32) for m in least]
            return [len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], mins, [None if m is None else ((m * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes() for m in least]

        return work

    fields = [("n_shingles", T.LongType()), ("set_hash", T.BinaryType()), ("mins", T.ArrayType(T.IntegerType())), ("sketch", T.BinaryType())]
    return map_texts(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), make, fields, carry=["id"], text="text")


def trees_for(percent: int) -> int:
    """Trees that together miss a pair at the threshold no oftener than MISSED."""
    s = percent / 100
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-s * (1 - (1 - s) ** BRANCHES) ** DEPTH)))


def agreeing(percent: int) -> int:
    """Coordinates of a sketch that a pair at the threshold shares but about once in ten million: 5.3 deviations below the mean."""
    p = percent / 100 + (1 - percent / 100) / 256
    return math.floor(SKETCH * p - 5.3 * math.sqrt(SKETCH * p * (1 - p)))


def _child(tree, trees: int, level: int, branch: int):
    """The coordinate by which a tree branches."""
    return F.lit(trees) + F.pmod(tree * 5 + F.lit(level * BRANCHES + branch), F.lit(COORDINATES - trees))


def tree_nodes(members: DataFrame, trees: int) -> DataFrame:
    """``node``, ``id``, ``comp``, ``size``, ``main``, ``of_main`` for every node to be compared; nodes with one component are left out.

    ``members``: ``id``, ``comp``, ``mins``. Only ids travel with the nodes; minwise tokens are fetched for those that branch.
    """
    level = members.select("id", "comp", F.posexplode(F.slice("mins", 1, trees)).alias("tree", "token")).select("id", "comp", "tree", F.xxhash64("tree", "token").alias("node"))
    leaves = []
    for depth in range(1, DEPTH + 1):
        sizes = level.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.sum("n").alias("size"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("of_main"))
        level = stored(level.join(sizes.filter("size > of_main"), "node"), f"level{depth}")
        big = F.col("size") > SMALL
        if depth == DEPTH:
            leaves.append(level.drop("tree"))
            break
        leaves.append(level.filter(~big).drop("tree"))
        steps = F.array(*(_child(F.col("tree"), trees, depth, b) for b in range(BRANCHES)))
        parted = level.filter(big).join(members.select("id", "mins"), "id").withColumn("c", F.explode(steps))
        parted = parted.select(*level.columns, F.xxhash64("node", "c", F.element_at("mins", F.col("c") + 1)).alias("child"))
        parted = stored(parted, f"parted{depth}")
        heavy = parted.groupBy("node", "child").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")).filter("2 * n > size").select("node").distinct()
        leaves.append(level.join(heavy, "node", "left_semi").select(*leaves[0].columns))
        level = parted.join(heavy, "node", "left_anti").select("id", "comp", "tree", F.col("child").alias("node"))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def centrality(classes: DataFrame) -> DataFrame:
    """``id``, ``central``: how often other documents share the document's minwise tokens; documents that share none are left out."""
    tokens = classes.select("id", F.posexplode(F.slice("mins", 1, CENTRAL)).alias("c", "token")).select("id", F.xxhash64("c", "token").alias("key"))
    shared = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return tokens.join(shared, "key").groupBy("id").agg(F.sum("n").alias("central"))


def cells(nodes: DataFrame, block: int) -> DataFrame:
    """Deals each node into cells of about ``block`` documents to compare (``asks``) with ``block`` documents.

    ``nodes``: ``node``, ``asks``, ``size``, ``n_ask`` and what to carry. A cell is named ``cell``.
    """
    across, down = F.ceil(F.col("size") / block).cast("int"), F.ceil(F.col("n_ask") / block).cast("int")
    place = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    member = nodes.withColumn("row", F.explode(F.sequence(F.lit(0), down - 1))).withColumn("column", place("column", across)).withColumn("asks", F.lit(False))
    asking = nodes.filter("asks").withColumn("column", F.explode(F.sequence(F.lit(0), across - 1))).withColumn("row", place("row", down))
    return member.unionByName(asking).withColumn("cell", F.xxhash64("node", "row", "column")).drop("node", "size", "n_ask", "row", "column")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[tuple]]]:
    """Rows of equal first column, which are neighbours."""
    held: list[tuple] = []
    for batch in batches:
        for part in slices(batch, "text") if "text" in batch.schema.names else (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
            for row in zip(*(part.column(k).to_pylist() for k in range(part.num_columns)), strict=True):
                if held and row[0] != held[0][0]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def _near(sketches: np.ndarray, k: int, agree: int) -> np.ndarray:
    return np.flatnonzero((sketches == sketches[k]).sum(1) >= agree)


def _sketches(rows: list[tuple], at: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[at] for r in rows), np.uint8).reshape(-1, SKETCH)


class _Forest(dict):
    """Roots of merged sets."""

    def root(self, x):
        """Halves the path on its way: in a large group of near copies every pair asks for it."""
        while x in self:
            up = self[x]
            self[x] = x = self.get(up, up)
        return x

    def merge(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self[a] = b
        return a != b


def _promising(percent: int):
    """(id, id) of promising pairs across components, as many as connect all that such pairs connect in the cell."""
    agree = agreeing(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for rows in _groups(batches):
            sketches, forest = _sketches(rows, 4), _Forest()
            found = [(rows[k][1], rows[j][1]) for k in range(len(rows)) if rows[k][3] for j in _near(sketches, k, agree) if rows[j][2] != rows[k][2] and forest.merge(rows[k][1], rows[j][1])]
            if found:
                yield found

    return run


def _confirmed(percent: int):
    """(id, id) of similar pairs across components, as many as connect the components that they connect."""

    agree = agreeing(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        known = new_words()
        for rows in _groups(batches):
            sketches, forest, sets, found = _sketches(rows, 4), _Forest(), {}, []
            for k, r in enumerate(rows):
                for j in _near(sketches, k, agree) if r[3] else ():
                    if forest.root(r[2]) == forest.root(rows[j][2]):
                        continue
                    for i in {k, j} - sets.keys():
                        sets[i] = shingle_set(known, rows[i][5].encode())
                    if similar(sets[k], sets[j], percent) and forest.merge(r[2], rows[j][2]):
                        found.append((r[1], rows[j][1]))
            if found:
                yield found

    return run


def _pairs(run, kind: T.DataType):
    """An Arrow function from one that yields lists of pairs of ids."""
    from pyspark.sql.pandas.types import to_arrow_type

    ids = to_arrow_type(kind)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in run(batches):
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, ids), pa.array(b, ids)], ["a", "b"])

    return giving_back(mapped), T.StructType([T.StructField("a", kind), T.StructField("b", kind)])


def promising(dealt: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b``: promising pairs of ``cells``, enough to connect what all of them connect."""
    rows = dealt.join(sketches, "id").select("cell", "id", "comp", "asks", "sketch")
    run, schema = _pairs(_promising(percent), dealt.schema["id"].dataType)
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, schema)


def links(docs: DataFrame, dealt: DataFrame, sketches: DataFrame, *, text: str, doc_id: str, percent: int) -> DataFrame:
    """``a``, ``b``: links of ``cells`` confirmed on the full sets, enough to connect what all of them connect."""
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    rows = texts.join(dealt.join(sketches, "id"), "id").select("cell", "id", "comp", "asks", "sketch", "text")
    run, schema = _pairs(_confirmed(percent), dealt.schema["id"].dataType)
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, schema)


def _asked(groups: DataFrame) -> DataFrame:
    """Adds ``size``, ``asks`` (not of the group's main component) and ``n_ask``; groups of one component are left out.

    ``groups``: ``node``, ``id``, ``comp``.
    """
    sizes = groups.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.sum("n").alias("size"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("of_main"))
    joined = groups.join(sizes.filter("size > of_main"), "node")
    return joined.withColumn("asks", F.col("comp") != F.col("main")).withColumn("n_ask", F.col("size") - F.col("of_main")).drop("main", "of_main")


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles``, ``component_id``, ``kept``.

    Documents with 100 * intersection >= percent * union of their shingle sets are linked; ``component_id`` is the smallest
    id reached, ``kept`` says that it is the document's own. Documents without words (null and empty texts too) are linked
    with nothing. Rows with a null id have a null component and are kept; rows that share an id are one document of several
    texts. Other columns are left out. Intermediate tables are written while the result is built. Thresholds below
    LEAST_PERCENT are refused.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent: {LEAST_PERCENT} to 100")
    rows = stored(signatures(docs, text=text, doc_id=doc_id), "signatures")
    classes = rows.filter("n_shingles > 0 and id is not null").groupBy("set_hash").agg(F.min("id").alias("id"), F.first("mins").alias("mins"), F.first("sketch").alias("sketch"))
    classes = stored(classes, "classes")
    sketches = classes.select("id", "sketch").dropDuplicates(["id"])

    # Every document with the most central of its node in the first tree.
    reps = classes.select("id", F.xxhash64(F.element_at("mins", 1)).alias("node"), F.col("id").alias("comp"))
    placed = reps.join(centrality(classes), "id")
    pivots = placed.groupBy("node").agg(F.min_by("id", F.struct(-F.col("central"), "id")).alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    first = reps.join(pivots, "node").withColumn("asks", F.col("id") == F.col("pivot")).withColumn("n_ask", F.lit(1)).drop("pivot")
    close = stored(promising(cells(first, SKETCH_BLOCK), sketches, percent), "close")
    stars = close.select(F.col("a").alias("id"), F.col("a").alias("node")).distinct().unionByName(close.select(F.col("b").alias("id"), F.col("a").alias("node")))
    sizes = stars.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    stars = stars.join(sizes, "node").withColumn("comp", F.col("id")).withColumn("asks", F.col("id") == F.col("node")).withColumn("n_ask", F.lit(1))
    found = stored(links(docs, cells(stars, BLOCK), sketches, text=text, doc_id=doc_id, percent=percent), "found")
    known = stored(components(found), "known")

    # In every node of every tree, documents outside the main component with all.
    labelled = classes.select("id", "mins").join(known.select("id", F.col("component").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    labelled = stored(labelled, "labelled")
    nodes = tree_nodes(labelled, trees_for(percent))
    nodes = nodes.withColumn("asks", F.col("comp") != F.col("main")).withColumn("n_ask", F.col("size") - F.col("of_main")).drop("main", "of_main")
    close = stored(promising(cells(nodes, SKETCH_BLOCK), sketches, percent), "across")
    groups = components(close).withColumnRenamed("component", "node").join(labelled.select("id", "comp"), "id")
    more = stored(links(docs, cells(_asked(stored(groups, "groups")), BLOCK), sketches, text=text, doc_id=doc_id, percent=percent), "more")

    final = components(found.unionByName(more))
    reached = classes.select("set_hash", F.col("id").alias("rep")).join(final, F.col("rep") == F.col("id"), "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    joined = rows.select("id", "n_shingles", "set_hash").join(reached, "set_hash", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return joined.select(F.col("id").alias(doc_id), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
