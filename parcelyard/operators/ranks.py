"""Positions within groups of any size, without a window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.sources.checkpoints import settle

# monotonically_increasing_id holds the partition above these bits.
_ROW_BITS = 33


def ranked(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    name: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """Add ``name``, each row's place in its group from 1 on, and ``total``, the group's size.

    Ascending, nulls first; NULL group values form a group. Rows that tie in
    ``order`` get different places, in any order.

    Rows are dealt by ranges of group and order and stored, so a group with most of
    the rows lies on many partitions, and so do equal rows, by a last random key.
    Counts per group and partition then say how many rows stand before a partition's
    first: one small row for each, gathered per group, at most one per partition.
    """
    columns = list(rows.columns)
    keys = [*[F.col(c) for c in group], *order, "_tie"]
    dealt = rows.withColumn("_tie", F.rand(11)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = settle(dealt.select(*columns, F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", _ROW_BITS)
    pieces = dealt.groupBy(*group, part.alias("part")).agg(
        F.min("_at").alias("low"), F.count("*").alias("n")
    )
    held = pieces.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("part", "low", "n"))).alias("held"))
    start = F.struct(
        F.lit(0).cast("long").alias("n"),
        F.array().cast("array<struct<part:bigint,shift:bigint>>").alias("done"),
    )

    def step(state: Column, piece: Column) -> Column:
        shift = F.struct(piece["part"].alias("part"), (state["n"] - piece["low"] + 1).alias("shift"))
        return F.struct(
            (state["n"] + piece["n"]).alias("n"), F.concat(state["done"], F.array(shift)).alias("done")
        )

    summed = F.aggregate("held", start, step)
    names = [f"_group_{i}" for i in range(len(group))]
    shifts = held.select(
        *[F.col(c).alias(n) for c, n in zip(group, names)], summed.alias("summed")
    ).select(
        *names, F.col("summed.n").alias("_total"), F.explode("summed.done").alias("_piece")
    )
    same = part == F.col("_piece.part")
    for column, n in zip(group, names):
        same &= F.col(column).eqNullSafe(F.col(n))
    added = [(F.col("_at") + F.col("_piece.shift")).alias(name)]
    if total is not None:
        added.append(F.col("_total").alias(total))
    return dealt.join(shifts, same).select(*columns, *added)
