"""Near-duplicate embeddings by small-world graphs, one per shard.

Distinct vectors are dealt over shards by their hash. Each shard builds a graph
of its vectors; every vector then queries every shard's graph. A beam that is
full of links is widened for that query until it is not; and an audit compares a sample of each
group of queries, and vectors planted at the threshold's distance from members of
the shard, with all vectors of the shard: the beams of the whole group are doubled
until the audit's recall is good enough. Every pair
is verified in double precision. Links are counted where they are found, and of
the pairs only a spanning forest per pair of shards leaves a task; both grow
by blocks of queries, so a linked group's pairs are never held together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.llm import graphs
from parcelyard.llm.components import components
from parcelyard.llm.store import stored
from parcelyard.llm.words import mix

COSINE = 0.95
# Least number of shards.
SHARDS = 6
# Components of the vectors of one shard, expected: 24,000 vectors of 64. A task holds a
# shard and the queries of another, some 60 bytes per component each.
SHARD_VALUES = 1_536_000
# Results of a block of queries that a task holds at once.
_HELD = 1 << 20
FIRST_BEAM = 16
AUDIT = 128
RECALL = 0.98
# Single precision may put a pair on the wrong side of the threshold by so much.
_SLACK = 1e-4
_BLOCK = 1024


def usable(vector: Column) -> Column:
    """No null or non-finite component, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return vector.isNotNull() & F.coalesce(~bad & some, F.lit(False))


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(lists), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares stay finite."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _levels(nodes: np.ndarray) -> np.ndarray:
    """Each node's highest layer, drawn by its hash."""
    u = (mix(nodes.view(np.uint64)) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(graphs.WIDTH)).astype(np.int64)


def _build(table: pa.Table) -> pa.Table:
    """A shard's vectors in the order of its graph, with each node's links per layer."""
    nodes = table["node"].to_numpy()
    levels = _levels(nodes)
    order = np.lexsort((nodes, -levels))
    table = table.take(pa.array(order))
    unit = _unit(_matrix(table["embedding"], np.float64)).astype(np.float32)
    graph = graphs.build(unit, levels[order])
    ends = np.cumsum([0] + [sum(i < len(x) for x in graph.layers) for i in range(len(order))])
    flat = np.concatenate(
        [layer[i] for i in range(len(order)) for layer in graph.layers if i < len(layer)]
    )
    width = 2 * graphs.WIDTH
    links = pa.ListArray.from_arrays(pa.array((ends * width).astype(np.int32)), pa.array(flat))
    place = pa.array(np.arange(len(order), dtype=np.int32))
    return table.append_column("place", place).append_column("links", links)


def _graph(table: pa.Table) -> tuple[pa.Table, graphs.Graph, np.ndarray]:
    table = table.sort_by("place")
    unit = _unit(_matrix(table["embedding"], np.float64))
    lists = table["links"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    width = 2 * graphs.WIDTH
    flat = lists.flatten().to_numpy().reshape(-1, width)
    starts = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()) // width)])
    depth = np.diff(starts)
    layers = [flat[starts[:-1][depth > level] + level] for level in range(int(depth.max()))]
    return table, graphs.Graph(unit.astype(np.float32), layers), unit


def _exact(unit: np.ndarray, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs at or above a cosine, by blocks."""
    out = []
    for a in range(0, len(queries), _BLOCK):
        for b in range(0, len(unit), _BLOCK):
            r, c = np.nonzero(queries[a : a + _BLOCK] @ unit[b : b + _BLOCK].T >= threshold)
            out.append((r + a, c + b))
    return tuple(np.concatenate(x) for x in zip(*out))


def _verified(unit: np.ndarray, queries: np.ndarray, q: np.ndarray, t: np.ndarray, threshold: float):
    keep = np.zeros(len(q), dtype=bool)
    for a in range(0, len(q), 1 << 16):
        part = slice(a, a + (1 << 16))
        keep[part] = np.einsum("pd,pd->p", queries[q[part]], unit[t[part]]) >= threshold
    return q[keep], t[keep]


def _planted(unit: np.ndarray, count: int, cosine: float) -> np.ndarray:
    """Unit vectors at a given cosine from members spread over the shard, in drawn directions."""
    draw = np.random.default_rng(len(unit))
    base = unit[np.linspace(0, len(unit) - 1, count).astype(np.int64)]
    away = draw.normal(size=base.shape)
    away -= (away * base).sum(axis=1, keepdims=True) * base
    length = np.linalg.norm(away, axis=1, keepdims=True)
    away = np.divide(away, length, out=np.zeros_like(away), where=length > 1e-9)
    out = cosine * base + np.sqrt(1 - cosine**2) * away
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _groups(true: np.ndarray) -> np.ndarray:
    """A number per audited query, the same for those that share a linked node, directly or in turn."""
    near = (true.astype(np.float32) @ true.T.astype(np.float32)) > 0
    group = np.arange(len(true))
    while True:
        low = np.where(near, group, len(group)).min(axis=1, initial=len(group))
        low = np.minimum(low, group)
        if (low == group).all():
            return group
        group = low


def _recall(true: np.ndarray, seen: np.ndarray, real: int) -> float:
    """The lower of the recalls of the first ``real`` audited queries and of the planted ones.

    Each query with a link has a recall of its own. Queries of one linked group
    count as one, by their mean, so that a hub cannot outweigh pairs and small groups.
    """
    n = true.sum(axis=1)
    own = (true & seen).sum(axis=1) / np.maximum(n, 1)
    out = 1.0
    for part in (slice(0, real), slice(real, len(true))):
        some = n[part] > 0
        if some.any():
            _, group = np.unique(_groups(true[part][some]), return_inverse=True)
            means = np.bincount(group, weights=own[part][some]) / np.bincount(group)
            out = min(out, float(means.mean()))
    return out


def link_blocks(
    graph: graphs.Graph, unit: np.ndarray, queries: np.ndarray, threshold: float, beam: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) at or above ``threshold``, at most about ``_HELD`` at once.

    Beams in which even the last node is a link are searched again, wider; at a
    quarter of the nodes the query is compared with all, and so are all queries
    if ``beam`` is the number of nodes.
    """
    single = queries.astype(np.float32)
    left, wide = np.arange(len(queries)), beam
    while len(left):
        all_ = wide >= len(unit) or (wide > beam and wide >= len(unit) // 4)
        again = [left[:0]]
        rows = max(1, _HELD // (len(unit) if all_ else wide))
        for a in range(0, len(left), rows):
            part = left[a : a + rows]
            if all_:
                q, t = _exact(unit, queries[part], threshold)
                yield part[q], t
                continue
            ids, sims = graphs.search(graph, single[part], wide)
            full = sims[:, -1] >= threshold - _SLACK
            r, c = np.nonzero((sims >= threshold - _SLACK) & ~full[:, None])
            yield _verified(unit, queries, part[r], ids[r, c], threshold)
            again.append(part[full])
        left, wide = np.concatenate(again), min(2 * wide, len(unit))


def audited_beam(
    graph: graphs.Graph,
    unit: np.ndarray,
    queries: np.ndarray,
    threshold: float,
    audit: int,
    recall: float,
    own: np.ndarray | None = None,
) -> tuple[float, int]:
    """The recall of the last audit and the beam, the number of nodes where no graph is good enough.

    The audit takes the first ``audit`` queries (their order is a hash's), and as
    many vectors planted just within the threshold of nodes, and asks which of
    their links are found. ``own`` has each query's own node, -1 for none: it
    is found at once and says nothing about links, so the audit leaves it out.
    """
    audit = min(audit, len(queries))
    asked = np.concatenate([queries[:audit], _planted(unit, audit, threshold + _SLACK)])
    true = np.zeros((len(asked), len(unit)), dtype=bool)
    for q, t in link_blocks(graph, unit, asked, threshold, len(unit)):
        true[q, t] = True
    if own is not None:
        itself = np.flatnonzero(own[:audit] >= 0)
        true[itself, own[itself]] = False
    beam = FIRST_BEAM
    while beam < len(unit) // 4:  # no graph is worth more; compare with all
        seen = np.zeros_like(true)
        for q, t in link_blocks(graph, unit, asked, threshold, beam):
            seen[q, t] = True
        reached = _recall(true, seen, audit)
        if reached >= recall:
            return reached, beam
        beam *= 2
    return 1.0, len(unit)


def find_links(
    graph: graphs.Graph,
    unit: np.ndarray,
    queries: np.ndarray,
    threshold: float,
    audit: int,
    recall: float,
    own: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, float, int]:
    """All pairs of ``link_blocks`` with the beam of ``audited_beam``; its recall and the beam."""
    reached, beam = audited_beam(graph, unit, queries, threshold, audit, recall, own)
    q, t = zip(*link_blocks(graph, unit, queries, threshold, beam))
    return np.concatenate(q), np.concatenate(t), reached, beam


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep every component of the links (a, b) together, one per node at most."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def shard_count(classes: DataFrame) -> int:
    """Shards that hold ``SHARD_VALUES`` components each, of the length ``dim`` with the most."""
    most = classes.groupBy("dim").count().agg(F.max(F.col("dim") * F.col("count"))).first()[0] or 0
    return max(SHARDS, -(-most // SHARD_VALUES))


def near_duplicates(
    vectors: DataFrame,
    threshold: float = COSINE,
    *,
    shards: int | None = None,
    audit: int = AUDIT,
    recall: float = RECALL,
) -> DataFrame:
    """Per row of ``vectors`` its ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Rows link at a cosine of ``threshold`` or more in double precision. Equal
    vectors are searched for once and count as linked to each other. Vectors
    that are null, empty, zero, or hold a null or non-finite component link with
    nothing; nor do vectors of different lengths. A component is named by its
    smallest ``vec_id``; null ids name none unless there is no other. Repeated
    rows are rows of their own. Other columns take no part; an empty table gives
    an empty result. Without ``shards`` their number follows from the table.
    """
    vector = F.col("embedding")
    rows = vectors.select("vec_id", F.when(usable(vector), vector).alias("embedding"))
    # Where a row stands for itself alone, its node is null.
    rows = rows.withColumn("node", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))
    classes = rows.where("node IS NOT NULL").groupBy("node", F.size("embedding").alias("dim")).agg(
        F.count("*").alias("mult"),
        F.min("vec_id").alias("least"),
        F.any_value("embedding").alias("embedding"),
    )
    dealt = stored(classes, "vectors")
    if shards is None:
        shards = shard_count(dealt)
    dealt = dealt.withColumn("shard", F.pmod("node", F.lit(shards)).cast("int"))
    kind = dealt.schema["embedding"].dataType.simpleString()
    points = dealt.select("dim", "shard", "node", "mult", "embedding")
    graph_rows = stored(
        points.groupBy("dim", "shard").applyInArrow(
            _build,
            f"dim int, shard int, node long, mult long, embedding {kind}, "
            "place int, links array<int>",
        ),
        "graphs",
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asking = points.select("dim", F.col("shard").alias("i"), every.alias("j"), "node", "embedding")
    asked = graph_rows.select(
        "dim", every.alias("i"), F.col("shard").alias("j"),
        "node", "mult", "embedding", "place", "links",
    )

    def query(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["node", "n", "other"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        left = left.sort_by("node")
        right, graph, unit = _graph(right)
        asks = left["node"].to_numpy()
        # The audit's sample is the first nodes in the order of another hash.
        order = np.argsort(mix(asks.view(np.uint64)))
        asks = asks[order]
        queries = _unit(_matrix(left["embedding"], np.float64)[order])
        has, mult = right["node"].to_numpy(), right["mult"].to_numpy()
        by_node = np.argsort(has)
        at = by_node[np.minimum(np.searchsorted(has[by_node], asks), len(has) - 1)]
        own = np.where(has[at] == asks, at, -1)
        _, beam = audited_beam(graph, unit, queries, threshold, audit, recall, own)
        n = np.zeros(len(asks), np.int64)
        a = b = np.empty(0, np.int64)
        for q, t in link_blocks(graph, unit, queries, threshold, beam):
            other = asks[q] != has[t]
            q, t = q[other], t[other]
            n += np.bincount(q, weights=mult[t], minlength=len(asks)).astype(np.int64)
            a, b = _forest(np.concatenate([a, asks[q]]), np.concatenate([b, has[t]]))
        some = np.flatnonzero(n)
        # Counts have no other end, and links of the forest no count.
        is_count = np.arange(len(some) + len(a)) < len(some)
        other = np.concatenate([np.zeros(len(some), np.int64), b])
        return pa.table(
            {
                "node": pa.array(np.concatenate([asks[some], a])),
                "n": pa.array(np.concatenate([n[some], np.zeros(len(a), np.int64)])),
                "other": pa.array(other, mask=is_count),
            }
        )

    keys = ["dim", "i", "j"]
    found = asking.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        query, "node long, n long, other long"
    )
    found = stored(found, "links")
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.where("other IS NOT NULL"), "node", "other")
    rooted = dealt.select("node", "mult", "least").join(roots, "node", "left")
    rooted = rooted.join(counts, "node", "left")
    rooted = rooted.select(
        "node", "least", F.coalesce("root", "node").alias("root"),
        (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("node", "n_links", "component_id")
    # One vector may be a third of all rows, and so may rows without one: the third
    # key has both sides shuffled and spreads the latter.
    lone = F.pmod(F.xxhash64("vec_id"), F.lit(512))
    left = rows.select("vec_id", "node").withColumn(
        "_z", F.when(F.col("node").isNull(), lone).otherwise(F.pmod("node", F.lit(1)))
    )
    both = left.join(named.withColumn("_z", F.pmod("node", F.lit(1))), ["node", "_z"], "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return both.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
