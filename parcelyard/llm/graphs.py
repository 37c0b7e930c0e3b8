"""Hierarchical navigable small-world graphs over unit vectors, in numpy.

Nodes are numbered so that those of the higher layers come first: layer ``l``
holds the nodes below ``sizes[l]``. Nodes enter a layer in batches; each batch
searches the graph as it stands, and its members also meet each other. Searches
run for many queries at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH = 16  # links of a new node; a node keeps up to twice as many
BUILD_BEAM = 48
_UPPER_BEAM = 8
_BATCH = 256
_STEP = 4  # nodes a query looks into at once
# Visited marks held at once, in bytes.
_MARKS = 32 << 20


@dataclass
class Graph:
    """Links per layer, -1 where there is none; the lowest layer comes first."""

    vectors: np.ndarray
    layers: list[np.ndarray]


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest of each row, in any order."""
    if sims.shape[1] <= k:
        return np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    return np.argpartition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k :]


def beam_search(
    vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """Per query the nodes found (-1 for none) and their cosines, best first.

    ``start`` has the nodes a query begins at, -1 for none, each once in a row.
    """
    n, count = len(links), len(queries)
    out_ids = np.full((count, beam), -1, dtype=np.int64)
    out_sims = np.full((count, beam), -np.inf, dtype=np.float32)
    chunk = int(max(1, min(_BATCH, _MARKS // max(n, 1))))
    for a in range(0, count, chunk):
        b = min(a + chunk, count)
        out_ids[a:b], out_sims[a:b] = _beam(vectors, links, queries[a:b], start[a:b], beam, n)
    return out_ids, out_sims


def _beam(vectors, links, queries, start, beam, n):
    count = len(queries)
    rows = np.arange(count)
    seen = np.zeros((count, n), dtype=bool)

    def cosines(r: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.einsum("pd,pd->p", queries[r], vectors[ids])

    new = start[:, :beam]
    sims = np.full(new.shape, -np.inf, dtype=np.float32)
    r, c = np.nonzero(new >= 0)
    sims[r, c] = cosines(r, new[r, c])
    seen[r, new[r, c]] = True
    ids = np.full((count, beam), -1, dtype=np.int64)
    ids[:, : new.shape[1]] = new
    best = np.full((count, beam), -np.inf, dtype=np.float32)
    best[:, : new.shape[1]] = sims
    fresh = best > -np.inf
    while True:
        active = np.flatnonzero(fresh.any(axis=1))
        if not len(active):
            break
        waiting = np.where(fresh[active], best[active], -np.inf)
        pick = _top(waiting, min(_STEP, beam))
        at = np.arange(len(active))[:, None]
        real = waiting[at, pick] > -np.inf
        fresh[active[:, None], pick] = False
        near = links[np.where(real, ids[active[:, None], pick], 0)].astype(np.int64)
        near[~real] = -1
        near = np.sort(near.reshape(len(active), -1), axis=1)
        ok = near >= 0
        ok[:, 1:] &= near[:, 1:] != near[:, :-1]
        ok &= ~seen[active[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(ok)
        found = near[r, c]
        seen[active[r], found] = True
        sims = np.full(near.shape, -np.inf, dtype=np.float32)
        sims[r, c] = cosines(active[r], found)
        all_sims = np.concatenate([best[active], sims], axis=1)
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_fresh = np.concatenate([fresh[active], ok], axis=1)
        keep = _top(all_sims, beam)
        best[active], ids[active] = all_sims[at, keep], all_ids[at, keep]
        fresh[active] = all_fresh[at, keep] & (all_sims[at, keep] > -np.inf)
    ids[best == -np.inf] = -1
    order = np.argsort(-best, axis=1, kind="stable")
    return ids[rows[:, None], order], best[rows[:, None], order]


def _select(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` links per row from candidates in order of cosine.

    A candidate that is nearer to a link already taken than to the node itself
    waits until all others had their turn.
    """
    rows, width = ids.shape
    held = vectors[np.maximum(ids, 0)]
    among = np.einsum("acd,aed->ace", held, held)
    taken = np.zeros((rows, width), dtype=bool)
    valid = ids >= 0
    for c in range(width):
        nearer = (among[:, c, :] > sims[:, c : c + 1]) & taken
        taken[:, c] = valid[:, c] & ~nearer.any(axis=1) & (taken.sum(axis=1) < k)
    rank = np.where(taken, 0, np.where(valid, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, axis=1, kind="stable")[:, :k]
    out = np.take_along_axis(np.where(valid, ids, -1), order, axis=1)
    if out.shape[1] < k:
        out = np.pad(out, ((0, 0), (0, k - out.shape[1])), constant_values=-1)
    return out


def _best_first(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    sims = np.where(ids >= 0, sims, -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def _add_back(vectors: np.ndarray, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    """Link targets back to sources; a full node selects anew."""
    sims = np.einsum("pd,pd->p", vectors[source], vectors[target])
    order = np.lexsort((-sims, target))
    source, target, sims = source[order], target[order], sims[order]
    first = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    rank = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
    some = rank < WIDTH  # of a hub's many new links the nearest
    source, sims, rank = source[some], sims[some], rank[some]
    nodes = target[first]
    group = np.searchsorted(nodes, target[some])
    for a in range(0, len(nodes), _BATCH):
        b = min(a + _BATCH, len(nodes))
        mine = (group >= a) & (group < b)
        new_ids = np.full((b - a, WIDTH), -1, dtype=np.int64)
        new_ids[group[mine] - a, rank[mine]] = source[mine]
        old = links[nodes[a:b]].astype(np.int64)
        ids = np.concatenate([old, new_ids], axis=1)
        all_sims = np.einsum("ad,acd->ac", vectors[nodes[a:b]], vectors[np.maximum(ids, 0)])
        ids, all_sims = _best_first(ids, all_sims, ids.shape[1])
        full = (ids >= 0).sum(axis=1) > links.shape[1]
        links[nodes[a:b]] = ids[:, : links.shape[1]]
        if full.any():
            links[nodes[a:b][full]] = _select(vectors, ids[full], all_sims[full], links.shape[1])


def _build_layer(vectors: np.ndarray, size: int, upper: list[np.ndarray]) -> np.ndarray:
    links = np.full((size, 2 * WIDTH), -1, dtype=np.int32)
    a = 0
    while a < size:
        b = min(size, a + _BATCH)
        own = vectors[a:b] @ vectors[a:b].T
        np.fill_diagonal(own, -np.inf)
        ids = np.broadcast_to(np.arange(a, b), own.shape)
        ids = np.where(own > -np.inf, ids, -1)
        ids, sims = _best_first(ids, own, BUILD_BEAM)
        if a:
            start = descend(vectors, upper, vectors[a:b])
            start = np.where(start < a, start, -1)
            start[(start >= 0).sum(axis=1) == 0, 0] = 0
            found, found_sims = beam_search(vectors, links[:a], vectors[a:b], start, BUILD_BEAM)
            ids = np.concatenate([found, ids], axis=1)
            sims = np.concatenate([found_sims, sims], axis=1)
            ids, sims = _best_first(ids, sims, BUILD_BEAM)
        chosen = _select(vectors, ids, sims, WIDTH)
        links[a:b, :WIDTH] = chosen
        r, c = np.nonzero(chosen >= 0)
        if len(r):
            _add_back(vectors, links, r + a, chosen[r, c])
        a = b
    return links


def _unique_links(links: np.ndarray) -> np.ndarray:
    """Each link of a node once."""
    out = np.sort(links, axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    return out


def descend(vectors: np.ndarray, upper: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Where to begin in the layer below ``upper`` (lowest of them first)."""
    start = np.zeros((len(queries), 1), dtype=np.int64)
    for links in reversed(upper):
        start, _ = beam_search(vectors, links, queries, start, _UPPER_BEAM)
    return start


def build(vectors: np.ndarray, levels: np.ndarray) -> Graph:
    """The graph of unit ``vectors`` whose ``levels`` fall from first to last."""
    layers: list[np.ndarray] = []
    top = int(levels[0]) if len(levels) else 0
    for level in range(top, -1, -1):
        size = int((levels >= level).sum())
        layers.insert(0, _unique_links(_build_layer(vectors, size, layers)))
    return Graph(vectors, layers)


def search(graph: Graph, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query up to ``beam`` nodes of the lowest layer and their cosines, best first."""
    start = descend(graph.vectors, graph.layers[1:], queries)
    return beam_search(graph.vectors, graph.layers[0], queries, start, beam)
