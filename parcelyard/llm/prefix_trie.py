"""The trie of conversations' prefixes, a balanced-parentheses string per shard.

A conversation is a path of turns; every distinct prefix is a node. Paths are sorted
and dealt by ranges, so a shard holds neighbouring paths. Its trie is written as a
string of parentheses, one pair per node: the excess of open over closed ones and its
least value per block find the close that ends a node's subtree, ranks of ``()`` count
its leaves, and cumulative arrays over the nodes give its conversations and savings.

Only the first and the last path of a shard, its spines, can share nodes with other
shards. Their nodes bring what hangs on them inside the shard, are summed up per node,
and their own small tree is added up: two paths per shard, whatever the shards hold.
So a prefix of any number of conversations is spread over shards, and counted once.

Paths are cut into bands of ``BAND`` turns, so that no row holds a conversation of any
length. Bands are done from the deepest up; what a band's tries hold is passed to the
nodes of the band above at which they hang.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.runs import sha256_of_runs
from parcelyard.llm.store import cut
from parcelyard.operators.ranks import ranked

# Turns of a path in one row, and nodes of a shard's string.
BAND = 512
SHARD_NODES = 1 << 17
# Hexadecimal digits of the digest that stands for a turn.
_DIGEST = 32
# Parentheses per block of the excess.
_BLOCK = 256

NODES = (
    "node string, parent string, spine boolean, depth int, conv_id bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, size bigint"
)
_NAMES = [c.split()[0] for c in NODES.split(", ")]


class Parentheses:
    """A balanced string, given as an array of +1 (open) and -1 (close)."""

    def __init__(self, steps: np.ndarray):
        self.excess = np.cumsum(steps, dtype=np.int64)
        blocks = -(-len(steps) // _BLOCK)
        padded = np.full(blocks * _BLOCK, np.iinfo(np.int64).max)
        padded[: len(steps)] = self.excess
        self.least = padded.reshape(blocks, _BLOCK).min(axis=1) if blocks else padded
        leaf = (steps[:-1] == 1) & (steps[1:] == -1)
        self.leaves = np.concatenate([[0], np.cumsum(leaf)])

    def findclose(self, i: int) -> int:
        """The close of the open parenthesis at ``i``: the first place after it whose
        excess is less. Blocks whose least value is not are passed over."""
        below = self.excess[i] - 1
        stop = (i // _BLOCK + 1) * _BLOCK
        here = np.flatnonzero(self.excess[i + 1 : stop] <= below)
        if len(here):
            return i + 1 + int(here[0])
        block = stop // _BLOCK + int(np.argmax(self.least[stop // _BLOCK :] <= below))
        start = block * _BLOCK
        return start + int(np.argmax(self.excess[start : start + _BLOCK] <= below))

    def leaf_pairs(self, i: int, close: int) -> int:
        """Pairs ``()`` from the open parenthesis ``i`` to its close."""
        return int(self.leaves[close] - self.leaves[i])


class _Shard:
    """Paths in order, and the nodes that they add."""

    def __init__(self) -> None:
        self.steps: list[int] = []
        self.open: list[int] = []  # the nodes of the last path
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.key: list[str] = []
        self.size: list[int] = []
        self.weight: list[int] = []
        self.low: list[int] = []
        self.below: dict[int, tuple[int, int, int]] = {}
        self.last: tuple[str, str] | None = None
        self.first_path: set[int] = set()

    def add(self, row: dict) -> None:
        start, path, sizes = row["start"], row["path"], row["sizes"]
        same = 0
        if self.last is not None and self.last[0] == start:
            old = self.last[1]
            most = min(len(old), len(path)) // _DIGEST
            while same < most and old[same * _DIGEST : (same + 1) * _DIGEST] == path[same * _DIGEST : (same + 1) * _DIGEST]:
                same += 1
            same += 1  # the root
        while len(self.open) > same:
            self.open.pop()
            self.steps.append(-1)
        for depth in range(same, len(sizes) + 1):
            node = len(self.key)
            self.steps.append(1)
            self.parent.append(self.open[-1] if self.open else -1)
            self.depth.append(depth)
            self.key.append(node_key(start, path[: depth * _DIGEST]))
            self.size.append(sizes[depth - 1] if depth else 0)
            self.weight.append(0)
            self.low.append(row["root_low"] if depth == 0 and row["root_low"] is not None else row["low"])
            self.open.append(node)
        end = self.open[-1]
        self.weight[end] += row["n"]
        self.low[end] = min(self.low[end], row["low"])
        if row["n_children"] is not None:
            self.below[end] = (row["n_children"], row["n_leaves"], row["saved_tokens"])
        if self.last is None:
            self.first_path = set(self.open)
        self.last = (start, path)

    def rows(self) -> pa.RecordBatch:
        n = len(self.key)
        spine = np.zeros(n, bool)
        spine[list(self.first_path | set(self.open))] = True
        steps = np.array(self.steps + [-1] * len(self.open), dtype=np.int8)
        string = Parentheses(steps)
        opens = np.flatnonzero(steps == 1)
        closes = np.fromiter(map(string.findclose, opens.tolist()), np.int64, n)
        # A subtree is a stretch of nodes: as many as half its parentheses.
        first, end = np.arange(n), np.arange(n) + (closes - opens + 1) // 2

        def total(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(values)])
            return sums[end] - sums[first]

        parent = np.array(self.parent)
        low = np.array(self.low)
        for node in range(n - 1, -1, -1):
            if parent[node] >= 0 and low[node] < low[parent[node]]:
                low[parent[node]] = low[node]
        convs = total(np.array(self.weight))
        size = np.array(self.size)
        inner = ~spine
        saved = np.where(inner, (convs - 1) * size, 0)
        children = np.bincount(parent[inner & (parent >= 0)], minlength=n)
        # What hangs on nodes from the band below; such a node is no leaf.
        more_leaves = np.zeros(n, np.int64)
        for node, (n_children, n_leaves, more) in self.below.items():
            children[node] += n_children
            more_leaves[node] = n_leaves - (1 if inner[node] else 0)
            saved[node] += more
        leaves = np.fromiter(
            (string.leaf_pairs(a, b) for a, b in zip(opens.tolist(), closes.tolist())), np.int64, n
        )
        # Whether a spine's own end is a leaf is seen when spines are merged.
        pair = steps[opens + 1] == -1
        leaves = leaves - total((pair & spine).astype(np.int64)) + total(more_leaves)
        saved = total(saved)
        # Spine nodes bring what does not hang on a deeper spine node.
        held = spine & (parent >= 0)
        np.subtract.at(leaves, parent[held], leaves[held].copy())
        np.subtract.at(saved, parent[held], saved[held].copy())
        key = np.array(self.key, dtype=object)
        own = parent >= 0
        within = own & inner & ~spine[parent]
        columns = [
            pa.array(key, pa.string()),
            pa.array(np.where(own, key[parent], None), pa.string()),
            pa.array(spine),
            pa.array(np.array(self.depth, np.int32)),
            pa.array(low),
            pa.array(low[parent], mask=~within),
            pa.array(convs),
            pa.array(children.astype(np.int64)),
            pa.array(leaves),
            pa.array(saved),
            pa.array(size.astype(np.int64)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def node_key(start: str, path: str) -> str:
    """A band's root has the key of the node above at which it hangs."""
    return start if start and not path else hashlib.md5((start + path).encode()).hexdigest()


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the sorted paths of a task, a shard at a time."""
    shard = _Shard()
    for batch in batches:
        for row in batch.to_pylist():
            if len(shard.key) >= SHARD_NODES:
                yield shard.rows()
                shard = _Shard()
            shard.add(row)
    if shard.key:
        yield shard.rows()


def _spine_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spines' own tree, from its deepest nodes up: two paths per shard."""
    rows = [row for batch in batches for row in batch.to_pylist()]
    rows.sort(key=lambda r: -r["depth"])
    children: dict[str, int] = defaultdict(int)
    leaves: dict[str, int] = defaultdict(int)
    saved: dict[str, int] = defaultdict(int)
    low = {r["node"]: r["conv_id"] for r in rows}
    for r in rows:
        node, parent = r["node"], r["parent"]
        r["n_children"] += children[node]
        r["n_leaves"] += leaves[node] + (r["n_children"] == 0)
        r["saved_tokens"] += saved[node] + (r["n_convs"] - 1) * r["size"]
        children[parent] += 1
        leaves[parent] += r["n_leaves"]
        saved[parent] += r["saved_tokens"]
        r["parent_conv_id"] = low.get(parent)
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in NODES.split(", ")])
    for at in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], schema=schema)


def _band_nodes(paths: DataFrame) -> DataFrame:
    """All nodes of the distinct paths of one band, their roots included."""
    keys = ["start", "path"]
    dealt = paths.repartitionByRange(*keys).sortWithinPartitions(*keys)
    found = cut(dealt.mapInArrow(_tries, NODES))
    spines = found.where("spine").groupBy("node").agg(
        F.any_value("parent").alias("parent"),
        F.lit(True).alias("spine"),
        F.any_value("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.any_value("size").alias("size"),
    )
    merged = cut(spines.select(*_NAMES).repartition(1).mapInArrow(_spine_sums, NODES))
    above = merged.select(F.col("node").alias("_parent"), F.col("conv_id").alias("_above"))
    hung = F.col("parent_conv_id").isNull() & (F.col("parent") == F.col("_parent"))
    inner = found.where("NOT spine").join(above, hung, "left").select(
        *[F.coalesce(c, "_above").alias(c) if c == "parent_conv_id" else c for c in _NAMES]
    )
    return inner.unionByName(merged)


def _bands(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id``, ``band``, ``path``, ``sizes`` of every conversation's stretches of turns."""
    entry = F.struct("pos", "digest", "size")
    rows = turns.groupBy("conv_id", F.expr(f"pos div {BAND}").alias("band")).agg(
        F.sort_array(F.collect_list(entry)).alias("turns")
    )
    full = rows.select(
        "conv_id",
        F.col("band").cast("int").alias("band"),
        F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("path"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
    )
    none = convs.where("length = 0").select(
        "conv_id", F.lit(0).alias("band"), F.lit("").alias("path"), F.array().cast("array<bigint>").alias("sizes")
    )
    return full.unionByName(none)


def _key(start: str = "start", path: str = "path") -> Column:
    return F.md5(F.concat(start, path))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and the node at which each conversation ends.

    ``turns`` has ``conv_id``, ``pos`` (from 0 on, without gaps), ``digest`` (32 hexadecimal
    digits that stand for the turn) and ``size``; ``convs`` has ``conv_id`` and ``length``,
    its number of turns, for all conversations, also those without turns. Ids are whole
    numbers, each once in ``convs``; other columns are ignored.

    Per node ``node`` (its key), ``conv_id`` (the smallest member), ``depth``,
    ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves`` and
    ``saved_tokens``. Empty tables have no nodes, not even a root.
    """
    bands = cut(_bands(turns, convs))
    deepest = bands.agg(F.max("band")).first()[0]
    if deepest is None:
        none = turns.sparkSession.createDataFrame([], NODES)
        return none.drop("parent", "spine", "size"), none.select("conv_id", "node")
    # Where each stretch begins, from the top down.
    unknown = F.lit(None).cast("long").alias("root_low")
    begun = [bands.where("band = 0").select("*", F.lit("").alias("start"), unknown)]
    for band in range(1, deepest + 1):
        before = begun[-1].where(F.size("sizes") == BAND)
        begins = before.select(F.col("conv_id").alias("_conv"), _key().alias("start"))
        lows = begins.groupBy(F.col("start").alias("_start")).agg(F.min("_conv").alias("root_low"))
        rows = bands.where(F.col("band") == band).join(begins, F.col("conv_id") == F.col("_conv"))
        rows = rows.join(lows, F.col("start") == F.col("_start"))
        begun.append(cut(rows.select(*begun[0].columns)))
    found, roots = None, None
    for band in range(deepest, -1, -1):
        paths = begun[band].groupBy("start", "path").agg(
            F.any_value("sizes").alias("sizes"),
            F.count("*").alias("n"),
            F.min("conv_id").alias("low"),
            F.min("root_low").alias("root_low"),
        )
        passed = ["n_children", "n_leaves", "saved_tokens"]
        if roots is None:
            paths = paths.select("*", *[F.lit(None).cast("long").alias(c) for c in passed])
        else:
            hanging = roots.select(F.col("node").alias("_node"), *passed)
            paths = paths.join(hanging, _key() == F.col("_node"), "left").drop("_node")
        nodes = cut(_band_nodes(paths))
        roots = nodes.where("depth = 0")
        shown = nodes if band == 0 else nodes.where("depth > 0")
        shown = shown.withColumn("depth", F.col("depth") + band * BAND)
        found = shown if found is None else found.unionByName(shown)
    ends = None
    for band, rows in enumerate(begun):
        here = rows.join(convs.select(F.col("conv_id").alias("_conv"), "length"), F.col("conv_id") == F.col("_conv"))
        last = F.greatest(F.expr(f"(length - 1) div {BAND}"), F.lit(0)) == band
        part = here.where(last).select("conv_id", _key().alias("node"))
        ends = part if ends is None else ends.unionByName(part)
    return found.drop("parent", "spine", "size"), ends


def rebuilt(conversations: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations that share heads, as ``prefix_trie`` takes them.

    Conversation c is the first h turns of conversation c - c % ``group``, where h is the
    CRC-32 of c as text modulo ``heads``, then its own turns after its first h. Turns are
    taken by turn, null first, then by a digest of role and text; a null role or text is
    empty. Rows without an id are left out.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.md5(F.concat_ws(":", F.length(role), role, text)).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )
    placed = ranked(rows, ["conv_id"], ["turn", "digest"])
    own = placed.select("conv_id", (F.col("pos") - 1).alias("at"), "digest", "size")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    counted = cut(
        own.groupBy("conv_id").agg(F.count("*").alias("n")).select(
            "conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")
        )
    )
    bases = counted.select(F.col("conv_id").alias("_base"), F.col("n").alias("_held"))
    convs = cut(
        counted.join(bases, F.col("base") == F.col("_base"), "left").select(
            "conv_id", "base", "h", F.least("h", F.coalesce("_held", F.lit(0).cast("long"))).alias("borrowed"), "n"
        )
    )
    lengths = convs.select(
        "conv_id", (F.col("borrowed") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
    )
    first = own.where(F.col("at") < heads).withColumnRenamed("conv_id", "_from")
    taken = first.join(convs.select("conv_id", "base", "h"), (F.col("_from") == F.col("base")) & (F.col("at") < F.col("h")))
    # The second key, always 0, has both sides shuffled: a long conversation can be split.
    zero = F.pmod(F.xxhash64("conv_id"), F.lit(1))
    shift = convs.select("conv_id", "h", "borrowed", zero.alias("_zero"))
    rest = own.withColumn("_zero", zero).join(shift, ["conv_id", "_zero"]).where(F.col("at") >= F.col("h"))
    turns = taken.select("conv_id", F.col("at").alias("pos"), "digest", "size").unionByName(
        rest.select("conv_id", (F.col("at") - F.col("h") + F.col("borrowed")).alias("pos"), "digest", "size")
    )
    return turns, lengths


def ends_sha256(ends: DataFrame) -> DataFrame:
    """Per node the digest of the ids that end there, ascending, joined by commas."""
    return sha256_of_runs(ends, "node", ["conv_id"], F.col("conv_id").cast("string"), ",", "ends_sha256")
