"""Whitening, lexical search and nearest neighbours against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm import lexical_search
from riskloom.llm.lexical_search import rank_documents
from riskloom.llm.nearest import build_index, search
from riskloom.llm.small_world import build, find, one_length
from riskloom.llm.whitening import square_sums, whiten

VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), *(T.StructField(c, T.StringType()) for c in ("x", "id", "score", "rank", "weight", "shard"))]
)


def vector_rows(n, d, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    found = rng.normal(size=(n, d)).astype(np.float32)
    found[: n // 2] += 3 * rng.normal(size=d).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(found)]
    return rows + [(n + i, found[3].tolist()) for i in range(copies)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *["c"] * 6) for i, v in rows], VECTORS)


BROKEN = [(901, None), (902, []), (903, [float("nan")] * 6), (904, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (905, [1.0, float("inf")] * 3), (906, [1.0, 2.0])]


def whitened(rows, scale=64):
    x = np.array([[math.floor(scale * c) + 1_000_000 for c in v] for _, v in rows], object)
    n, total = len(x), x.sum(axis=0)
    gap = ((n * x - total) / n).astype(float)
    e, u = np.linalg.eigh(gap.T @ gap / n)
    return ((n * x - total) ** 2).sum(axis=1), gap @ u[:, ::-1] / np.sqrt(e[::-1]), e[::-1] / e.sum()


@pytest.mark.parametrize("copies", [0, 60])
def test_whitening(spark, copies):
    rows = vector_rows(90, 6, copies=copies)
    got = whiten(frame(spark, [*rows, *BROKEN]).repartition(5), components=4).toPandas()
    assert set(got.vec_id) == {i for i, _ in rows} and len(got) == 4 * len(rows)
    far, white, share = whitened(rows)
    assert got.n.unique().tolist() == [len(rows)] and got.identity_error.max() < 1e-9
    for c in range(4):
        mine = got[got.component == c + 1].set_index("vec_id").loc[[i for i, _ in rows]]
        assert [int(x) for x in mine.deviation] == far.tolist()
        assert np.allclose(abs(mine.whitened), abs(white[:, c]), atol=1e-9) and np.isclose(abs((mine.whitened.values * white[:, c]).sum()), (white[:, c] ** 2).sum())
        assert np.allclose(mine.explained, share[c])


def test_whitening_once_per_vector(spark):
    rows = vector_rows(40, 6, copies=30)
    got = whiten(frame(spark, rows), weights="one").toPandas()
    _, white, _ = whitened(rows[:40])
    mine = got[got.component == 1].set_index("vec_id")
    assert set(got.n) == {40} and len(mine) == 70
    assert np.allclose(abs(mine.loc[list(range(40))].whitened), abs(white[:, 0]), atol=1e-9) and (mine.loc[list(range(40, 70))].whitened == mine.loc[3].whitened).all()


def test_whitening_without_variance(spark):
    assert whiten(frame(spark, [])).count() == 0
    assert whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    flat = whiten(frame(spark, [(None if i == 2 else i, [float(i), 5.0]) for i in range(9)])).toPandas()
    assert sorted(flat.component.unique()) == [1] and len(flat) == 9 and flat.vec_id.isna().sum() == 1


def test_square_sums():
    rng = np.random.default_rng(3)
    x = rng.integers(-(1 << 62), 1 << 62, size=(20, 70))
    assert [int(v) for v in square_sums(x)] == [sum(int(c) ** 2 for c in r) for r in x]


def neighbours(rows, queries, k):
    found = {}
    for q, v in queries:
        scored = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in rows if i != q)
        found[q] = scored[:k]
    return found


@pytest.mark.parametrize("d,copies", [(6, 0), (24, 400)])
def test_nearest(spark, d, copies):
    rows = vector_rows(900, d, seed=d, copies=copies)
    zero = (910_000, [0.0] * d)
    table = frame(spark, [*rows, *BROKEN[:2], zero, (None, rows[0][1])]).repartition(6)
    index = build_index(table, k=10, shard_rows=300)
    assert index.agg(F.sum("rows")).first()[0] == 900
    queries = [r for r in rows if r[0] % 20 == 0]
    got = search(index, table.filter("vec_id % 20 = 0 or vec_id is null"), query_rows=64).toPandas()
    want = neighbours(rows, queries, 10)
    assert set(got.query_id) == set(want)
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and q not in set(g.vec_id)
        assert sorted(zip(-g.score, g.vec_id, strict=True)) == list(zip(-g.score, g.vec_id, strict=True))
        by_id = dict(rows)
        assert np.allclose(g.score, [np.dot(np.array(by_id[i], float), np.array(by_id[q], float)) for i in g.vec_id], rtol=0, atol=1e-12)
        hits += len(set(g.vec_id) & {i for _, i in want[q]})
    assert hits >= 0.97 * 10 * len(want)


def test_nearest_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0])]
    got = search(build_index(frame(spark, rows)), frame(spark, [r for r in rows if r[0] % 20 == 0])).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 7, 1.0), (0, 2, 20, 0.0), (20, 1, 7, 1.0), (20, 2, 0, 0.0)]
    empty = frame(spark, [])
    assert search(build_index(empty), frame(spark, rows)).count() == 0
    assert search(build_index(frame(spark, rows)), empty).count() == 0
    assert search(build_index(frame(spark, rows)), frame(spark, [(0, [1.0, 0.0, 0.0])])).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32)) * rng.uniform(0.5, 2, size=(3000, 1))
    x[:1000] = x[:1000] * 0.01 + rng.normal(size=32)  # a dense cluster
    order, layers = build(one_length(x))
    assert sorted(order) == list(range(3000)) and [len(a) for a in layers] == sorted((len(a) for a in layers), reverse=True)
    q = rng.normal(size=(200, 32))
    near = find(one_length(x)[order], layers, np.concatenate([q, np.zeros((200, 1))], axis=1).astype(np.float32), 192)
    want = np.argsort(-(q @ x[order].T), axis=1)[:, :20]
    assert np.mean([len(set(a.tolist()) & set(b.tolist())) / 20 for a, b in zip(near, want, strict=True)]) >= 0.95


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def ranked(docs, items, k):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    names = {}
    for i, t in items:
        names.setdefault(i, set()).update(terms_of(t))
    for item, words in names.items():
        scored = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out[item] = [(-s, i) for s, _, i in sorted(scored)[:k]]
    return {i: v for i, v in out.items() if v}


def by_item(result):
    out = {}
    for r in sorted(result.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.item_id, []).append((r.score, r.doc_id))
        assert r["rank"] == len(out[r.item_id])
    return out


def lexical_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    share /= share.sum()
    docs = [(i, " ".join(rng.choice(words, size=rng.integers(1, 60), p=share))) for i in range(n)]
    docs += [(n + i, docs[5][1].upper()) for i in range(n // 3)]
    items = [(i, " ".join(rng.choice(words, size=rng.integers(1, 20)))) for i in range(30)]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_bytes": 400, "seed_rows": 40, "chunk_rows": 50}])
def test_lexical_search(spark, options):
    docs, items = lexical_rows(400)
    docs += [(None, docs[7][1]), (None, docs[5][1]), (4, docs[9][1]), (900, None), (901, ""), (902, "... !?"), (903, "W1 w1,W1-é日本")]
    items += [(None, "w3 w7"), (3, "w250 w251"), (31, None), (32, "!"), (33, "nowhere"), (34, "日本 é w1 é日本")]
    table = spark.createDataFrame([(i, t, "c", "c", 1) for i, t in docs], "doc_id long, text string, item_id string, rank string, score long").repartition(5)
    asked = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    for k in (1, 7, 50):
        assert by_item(rank_documents(table, asked, k=k, **options)) == ranked(docs, items, k)


def test_lexical_search_empty_and_everywhere(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert rank_documents(docs.limit(0), items).count() == 0 and rank_documents(docs, items.limit(0)).count() == 0
    want = ranked([(1, "a b"), (2, "a")], [("x", "a")], 50)
    assert by_item(rank_documents(docs, items)) == want


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 64)
    text = " ".join(f"term{i} -- " for i in range(900)) + "x" * 500
    assert [w.decode() for p in lexical_search.pieces(text.encode()) for w in p] == terms_of(text)


def test_pairs_are_pruned(monkeypatch):
    """Most documents are never scored: bounds on nodes drop them."""
    docs, items = lexical_rows(4000, seed=2)
    known = {}
    rows = [[known.setdefault(w, len(known)) for w in terms_of(t)] for _, t in docs]
    weight = np.array([round(1000 * math.log(len(rows) / (1 + sum(t in r for r in map(set, rows))))) for t in range(len(known))], np.int64)
    names = [i for i, _ in items]
    wanted = [np.array(sorted({known[w] for w in terms_of(t) if w in known}), np.int64) for _, t in items]
    block = lexical_search.Items(names, wanted, weight)
    scored = []
    plain = lexical_search.Level.sums
    look = lexical_search.Search(block, 5, {})
    monkeypatch.setattr(lexical_search.Level, "sums", lambda self, nodes, w: (scored.append(len(nodes)) if self is look.tree[0] else None) or plain(self, nodes, w))
    counts = [Counter(r) for r in rows]
    start = np.cumsum([0, *map(len, counts)])
    term, tf = (np.array([x for c in counts for x in part(c)], np.int64) for part in (Counter.keys, Counter.values))
    look.add([i for i, _ in docs], start, term, 10**6 * tf // (1 + tf))
    assert sum(scored) < 0.5 * len(docs) * len(items)
