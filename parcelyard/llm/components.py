"""Connected components of a graph held in a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.store import cut


def _spread(rows: DataFrame, near: DataFrame) -> DataFrame:
    """Rows joined to the one row of their node.

    Both sides are shuffled for the join (the third key, always 0, is unknown to
    the aggregate's own partitioning), so adaptive execution can split a hub.
    """
    zero = F.pmod(F.xxhash64("u"), F.lit(1))
    return rows.withColumn("_z", zero).join(near.withColumn("_z", zero), ["u", "_z"])


def _mark(links: DataFrame) -> tuple[int, int]:
    """Number and order-free sum of hashes of the links."""
    row = links.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], int(row["s"] or 0)


def components(links: DataFrame, a: str | Column, b: str | Column) -> DataFrame:
    """Per linked node its ``node`` and ``root``, the smallest node reachable.

    Links run both ways; repeats, self-links and links with a null end are
    harmless. Nodes without a link to another node do not appear.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its smallest neighbour, then every node hands all its smaller
    neighbours to the smallest of them. Each step is a minimum per node (summed
    up before the shuffle) and a join; no neighbour list is ever gathered. The
    links are kept in the shared folder after every round, and only their number
    and a checksum come to the driver.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    pairs = links.select(col(a).alias("u"), col(b).alias("v")).where("u <> v")
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _spread(both.where("v > u"), near).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _spread(large, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        pairs = cut(small.where("u <> v").distinct())
        after = _mark(pairs)
        if after == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
