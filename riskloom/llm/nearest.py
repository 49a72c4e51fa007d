"""Approximate nearest neighbours: a small-world graph per shard, kept as flat arrays, all shards searched and merged.

Equal vectors are one node. Rows are dealt to shards by a hash of the vector, so shards are even and no vector is hot.
Every query is searched in every shard; cells of one shard and a block of queries are the unit of work, and what the
shards find is merged a few dozen shards at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.rows import stored
from riskloom.llm.small_world import build, find, one_length
from riskloom.llm.vectors import common_length, finite, matrix, packed

#: Neighbours by default; nodes that a walk through a shard keeps.
NEIGHBOURS, WIDTH = 20, 192
#: Distinct vectors of a shard, and bytes of them; queries of a cell; lists merged at once.
SHARD_ROWS, SHARD_BYTES, QUERY_ROWS, MERGED = 4096, 32 << 20, 4096, 64
#: Ids of equal vectors that can be among the nearest ``k`` of a row: k, and its own.
OWN = 1


def _usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    entries = F.col(vector).cast("array<double>")
    sound = finite(F.col(vector)) & F.exists(entries, lambda c: c != 0) & F.col(vec_id).isNotNull()
    return vectors.filter(F.coalesce(sound, F.lit(False))).select(F.col(vec_id).alias("id"), F.transform(entries, lambda c: c + F.lit(0.0)).alias("x"))


def build_index(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Graphs over all usable rows, a row per shard: ``shard``, ``rows``, ``d``, ``k``, ``vectors`` (doubles by node),
    ``links`` (one array per layer, lowest first), ``members`` and ``ids`` (for each node its smallest k + 1 ids, in a row).

    Rows whose id is null or whose vector is null, empty, all zero, of another length than most, or holds null or
    non-finite entries are left out. A repeated id stands for each of its vectors. The result is stored: a folder of it
    can be searched again. An empty table gives an index without shards.
    """
    rows = _usable(vectors, vec_id, vector)
    most = k + OWN
    packs = stored(packed(rows, "x", "id", most), "members")
    d = common_length(packs, "x")
    packs = packs.filter(F.size("x") == d).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(MERGED)))
    smallest = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids")
    nodes = stored(packs.groupBy("x", "part").agg(smallest).groupBy("x").agg(smallest), "nodes")
    per_shard = max(64, min(shard_rows, SHARD_BYTES // (8 * max(d, 1))))
    shards = max(1, -(-nodes.count() // per_shard))
    id_type = rows.schema["id"].dataType.simpleString()

    def graph(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = matrix(table.column("x").combine_chunks())
        by = np.lexsort(x.T[::-1])  # the graph does not depend on the order of arrival
        order, layers = build(one_length(x[by]))
        order = by[order]
        ids = table.column("ids").combine_chunks().take(pa.array(order))
        made = {
            "shard": table.column("shard").slice(0, 1),
            "rows": pa.array([len(x)], pa.int32()),
            "d": pa.array([d], pa.int32()),
            "k": pa.array([k], pa.int32()),
            "vectors": pa.array([x[order].tobytes()], pa.binary()),
            "links": pa.array([[a.tobytes() for a in layers]], pa.list_(pa.binary())),
            "members": pa.array([ids.value_lengths().to_numpy().astype(np.int32).tobytes()], pa.binary()),
            "ids": pa.array([ids.flatten().to_pylist()], pa.list_(ids.type.value_type)),
        }
        return pa.table(made)

    schema = f"shard int, rows int, d int, k int, vectors binary, links array<binary>, members binary, ids array<{id_type}>"
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("x"), F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("shard").applyInArrow(graph, schema), "graphs")


def search(index: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", width: int = WIDTH, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The nearest rows of the index for every usable row of ``queries``: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``score`` is the inner product in double precision, ties go to the smaller id. Rows with the query's own id are no
    neighbours of it. Queries are left out as in the index; one of another length than the index's finds nothing. Equal
    rows of ``queries`` count once; an id with several vectors gets a list for each. Equal vectors are searched once. ``k``
    is the index's. A ``width`` of at least a shard's rows reaches whatever its graph connects.
    """
    head = index.select("d", "k").first()
    rows = _usable(queries, vec_id, vector).distinct()
    d, k = (head["d"], head["k"]) if head else (0, NEIGHBOURS)
    most, shards = k + OWN, index.agg(F.coalesce(F.max("shard") + 1, F.lit(0))).first()[0]
    packs = stored(packed(rows.filter(F.size("x") == d), "x", "id"), "query-packs")
    asked = stored(packs.select("x").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-asked.count() // query_rows))
    id_type = rows.schema["id"].dataType.simpleString()
    hit = f"struct<far:double,id:{id_type}>"

    def walk(key: tuple, graphs: pa.Table, some: pa.Table) -> pa.Table:
        found, number = [], []
        for g in graphs.to_pylist() if some.num_rows else ():
            x = np.frombuffer(g["vectors"], float).reshape(g["rows"], -1)
            links = [np.frombuffer(a, np.int32) for a in g["links"]]
            layers = [a.reshape(-1, w) for a, w in zip(links, _widths(links, g["rows"]), strict=True)]
            members = np.concatenate([[0], np.cumsum(np.frombuffer(g["members"], np.int32))])
            for batch in some.select(["query", "x"]).to_batches(1024):
                q = matrix(batch.column("x"))
                near = find(one_length(x), layers, np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32), width)
                score = np.where(near >= 0, np.einsum("bkd,bd->bk", x[near], q), -np.inf)
                first = np.argsort(-score, axis=1, kind="stable")
                for n, line in enumerate(first.tolist()):
                    hits = []
                    for c in line:
                        s, node = score[n, c], near[n, c]
                        if node < 0 or (len(hits) >= most and -s > hits[most - 1][0]):
                            break
                        hits += [(-s, one) for one in g["ids"][members[node] : members[node + 1]]]
                        hits.sort()
                        del hits[most:]
                    found.append([{"far": s, "id": one} for s, one in hits])
                number += batch.column("query").to_pylist()
        kind = pa.list_(pa.struct([("far", pa.float64()), ("id", _id_kind(graphs))]))
        return pa.table({"query": pa.array(number, pa.int64()), "shard": pa.array([key[0]] * len(number), pa.int32()), "hits": pa.array(found, kind)})

    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(shards, 1) - 1))))
    cells = graphs.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInArrow(walk, f"query long, shard int, hits array<{hit}>")
    best = F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, most).alias("hits")
    while shards > MERGED:
        shards = -(-shards // MERGED)
        cells = cells.groupBy("query", F.floor(F.col("shard") / MERGED).cast("int").alias("shard")).agg(best)
    merged = asked.join(cells.groupBy("query").agg(best), "query").select("x", "hits")
    each = packs.join(merged, "x").select(F.explode("ids").alias("query_id"), "hits")
    others = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score")
    )


def _widths(links: list[np.ndarray], rows: int) -> Iterator[int]:
    from riskloom.llm.small_world import BASE_LINKS, LINKS

    for v in range(len(links)):
        yield BASE_LINKS if v == 0 else LINKS


def _id_kind(graphs: pa.Table) -> pa.DataType:
    return graphs.schema.field("ids").type.value_type
