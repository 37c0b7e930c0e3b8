"""Placement of documents on shards by a permutation-filled lookup table.

The table has a prime number of slots. Every shard has its own order of
preference over all slots, from two hashes of its name; shards take turns, each
claiming the first slot of its order that is still free, until none is left.
Slot counts differ by one at most, and when a shard comes or goes most slots
keep their owner. A document's slot is its hashed key modulo the table's size,
so placing it takes one look into a broadcast table of fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.hashing import digest52, key_text

SLOTS = 2039
MAX_SLOTS = 1_000_003


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Per slot the position of its shard in ``shards``.

    ``slots`` must be a prime, so that every stride reaches every slot, and at
    most ``MAX_SLOTS``, which bounds what is built here and broadcast.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need names, each given once")
    if not _is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime up to {MAX_SLOTS}")
    at = [_number(f"{s}:offset") % slots for s in shards]
    stride = [_number(f"{s}:skip") % max(slots - 1, 1) + 1 for s in shards]
    table = [-1] * slots
    for turn in range(slots):
        shard = turn % len(shards)
        while table[at[shard]] >= 0:
            at[shard] = (at[shard] + stride[shard]) % slots
        table[at[shard]] = shard
    return table


def table_rows(docs: DataFrame, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """The lookup table as rows ``slot`` and ``shard``."""
    names = F.split(F.lit(",".join(str(s) for s in lookup_table(shards, slots))), ",")
    rows = docs.sparkSession.range(1).select(F.posexplode(names).alias("slot", "shard"))
    return rows.select(F.col("slot").cast("long"), F.col("shard").cast("int"))


def place(
    docs: DataFrame, shards: Sequence[str], *, slots: int = SLOTS, key: str = "doc_id"
) -> DataFrame:
    """All columns of ``docs`` plus ``slot`` and ``shard``.

    No row moves: the table of at most ``MAX_SLOTS`` rows is broadcast, so a key
    that many rows share makes no task larger.

    A null key is placed like the text ``null``; rows with equal keys get the
    same shard; an empty table gives an empty one. Columns of ``docs`` named
    ``slot`` or ``shard`` are replaced.
    """
    docs = docs.drop("slot", "shard")
    slot = F.pmod(digest52(key_text(docs[key])), F.lit(slots).cast("long"))
    table = F.broadcast(table_rows(docs, shards, slots))
    return docs.withColumn("slot", slot).join(table, "slot").select(*docs.columns, "slot", "shard")


def write_shards(placed: DataFrame, folder: str) -> None:
    """One folder per shard; adaptive execution splits a large shard over several files."""
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(folder)
