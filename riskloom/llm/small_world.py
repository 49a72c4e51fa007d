"""Navigable small-world graphs in layers, as flat neighbour arrays; many searches advance at once.

Nodes are numbered by falling level, so layer l holds the nodes 0 .. n_l - 1 and its links are one array of n_l rows. The
nearest by inner product are the nearest by distance once each vector has one more coordinate that brings all to one length.
"""

from __future__ import annotations

import numpy as np

#: Links of a node: above, and in the lowest layer. Nodes found when one is inserted, inserted at once, expanded at once.
LINKS, BASE_LINKS, FOUND, TOGETHER, STEP = 16, 32, 64, 256, 4


def one_length(x: np.ndarray) -> np.ndarray:
    """The vectors with a coordinate that makes all as long as the longest, in single precision."""
    squares = np.einsum("ij,ij->i", x, x)
    return np.concatenate([x, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0.0))[:, None]], axis=1).astype(np.float32)


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of each q[b] to each x[b, k]."""
    gap = x - q[:, None, :]
    return np.einsum("bkd,bkd->bk", gap, gap)


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nodes nearest to each q that a best-first walk along ``links`` finds: nodes (-1: none) and distances."""
    n, b = len(links), len(q)
    ids, dist, done = np.full((b, width), -1), np.full((b, width), np.inf, np.float32), np.ones((b, width), bool)
    seen = np.zeros((b, n), bool)
    rows = np.arange(b)
    e = entries.shape[1]
    ids[:, :e], dist[:, :e], done[:, :e] = entries, np.where(entries >= 0, _distances(q, x[entries]), np.inf), entries < 0
    for c in range(e):
        there = entries[:, c] >= 0
        twice = seen[rows, entries[:, c]] & there
        dist[twice, c], done[twice, c], ids[twice, c] = np.inf, True, -1
        seen[rows[there], entries[there, c]] = True
    live = rows
    while True:
        order = np.argsort(np.where(done[live], np.inf, dist[live]), axis=1)[:, :STEP]
        fresh = ~done[live[:, None], order]
        going = fresh.any(axis=1)
        live, order, fresh = live[going], order[going], fresh[going]
        if not len(live):
            break
        done[live[:, None], order] = True
        near = np.where(fresh[:, :, None], links[ids[live[:, None], order]], -1).reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[live[:, None], near]] = -1  # node -1 looks the last one up, which only hides what is -1 already
        at, k = np.nonzero(near >= 0)
        seen[live[at], near[at, k]] = True
        gap = np.full(near.shape, np.inf, np.float32)
        away = x[near[at, k]] - q[live[at]]
        gap[at, k] = np.einsum("id,id->i", away, away)
        all_ids, all_dist = np.concatenate([ids[live], near], axis=1), np.concatenate([dist[live], gap], axis=1)
        all_done = np.concatenate([done[live], near < 0], axis=1)
        best = np.argpartition(all_dist, width - 1, axis=1)[:, :width]
        ids[live], dist[live], done[live] = (np.take_along_axis(a, best, axis=1) for a in (all_ids, all_dist, all_done))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)


def spread(x: np.ndarray, near: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` of the nodes in each row of ``near``: first those nearer to the origin than to any one chosen before
    them, then the nearest of the others."""
    order = np.argsort(dist, axis=1, kind="stable")[:, : 2 * most]
    near, dist = np.take_along_axis(near, order, axis=1), np.take_along_axis(dist, order, axis=1)
    b, k = near.shape
    points = x[near]
    inner = np.einsum("bid,bjd->bij", points, points)
    squares = np.einsum("bii->bi", inner)
    apart = squares[:, :, None] + squares[:, None, :] - 2 * inner
    there = np.isfinite(dist)
    chosen = np.zeros((b, k), bool)
    for j in range(k):
        hidden = (chosen & (apart[:, j, :] < dist[:, j, None])).any(axis=1)
        chosen[:, j] = there[:, j] & ~hidden & (chosen.sum(axis=1) < most)
    rank = np.argsort(np.where(chosen, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.full((b, most), -1, np.int32)
    out[:, : rank.shape[1]] = np.where(np.take_along_axis(there, rank, axis=1), np.take_along_axis(near, rank, axis=1), -1)
    return out


def build(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """``order`` (the row of x of every node) and the links of each layer, lowest first, for vectors of one length."""
    n = len(x)
    draw = np.random.default_rng(seed).random(n)
    level = np.floor(-np.log(np.maximum(draw, 1e-300)) / np.log(LINKS)).astype(int)
    order = np.argsort(-level, kind="stable")
    x, level = x[order], level[order]
    layers = [np.full((int((level >= v).sum()), BASE_LINKS if v == 0 else LINKS), -1, np.int32) for v in range(level.max(initial=0) + 1)]
    start = 0
    while start < n:
        top = level[start]
        end = min(start + TOGETHER, int((level >= top).sum()))
        q, entries = x[start:end], np.zeros((end - start, 1), int)
        for v in range(len(layers) - 1, -1, -1):
            links = layers[v][:start]
            if v > top and start:
                entries = beam(x, links, q, entries, 1)[0]
                continue
            if v > top:
                continue
            near, dist = beam(x, links, q, entries, FOUND) if start else (np.zeros((end - start, 0), int), np.zeros((end - start, 0), np.float32))
            entries = near[:, :4] if start else entries
            among = _distances(q, np.broadcast_to(q, (len(q), *q.shape))) if len(q) <= 64 else _gram(q)
            np.fill_diagonal(among, np.inf)
            near = np.concatenate([near, np.broadcast_to(np.arange(start, end), among.shape)], axis=1)
            dist = np.concatenate([dist, among], axis=1)
            dist[near < 0] = np.inf
            layers[v][start:end] = spread(x, near, dist, layers[v].shape[1])
            _back(x, layers[v], start, end)
        start = end
    return order, layers


def _gram(q: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", q, q)
    return np.maximum(squares[:, None] + squares[None, :] - 2 * (q @ q.T), 0)


def _back(x: np.ndarray, links: np.ndarray, start: int, end: int) -> None:
    """Links back from the nodes that ``start`` .. ``end`` chose; a full node keeps a spread choice of old and new."""
    source, k = np.nonzero(links[start:end] >= 0)
    target, source = links[start:end][source, k], source + start
    by = np.argsort(target, kind="stable")
    target, source = target[by], source[by]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    for lo in range(0, len(nodes), TOGETHER):
        some, at, many = nodes[lo : lo + TOGETHER], first[lo : lo + TOGETHER], count[lo : lo + TOGETHER]
        come = np.full((len(some), int(many.max())), -1, np.int32)
        for r in range(len(some)):
            come[r, : many[r]] = source[at[r] : at[r] + many[r]]
        known = (come[:, :, None] == links[some][:, None, :]).any(axis=2)
        come[known] = -1
        near = np.concatenate([links[some], come], axis=1)
        dist = np.where(near >= 0, _distances(x[some], x[near]), np.inf)
        links[some] = spread(x, near, dist, links.shape[1])


def find(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, width: int) -> np.ndarray:
    """Nodes near each q in the lowest layer, nearest first; -1 where there are fewer than ``width``."""
    out = []
    for lo in range(0, len(q), TOGETHER):
        some = q[lo : lo + TOGETHER]
        entries = np.zeros((len(some), 1), int)
        for links in layers[:0:-1]:
            entries = beam(x, links, some, entries, 4)[0]
        out.append(beam(x, layers[0], some, entries, max(width, entries.shape[1]))[0][:, :width])
    return np.concatenate(out) if out else np.zeros((0, width), int)
