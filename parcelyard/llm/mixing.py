"""Mixing sources to target weights by Poisson replication.

Every document is repeated a Poisson-distributed number of times whose mean is
the target repetition rate of its source, so that the expected share of each
source in the mixture is its weight. The number comes from inverting the
distribution at a uniform number hashed from the seed and the document's id: the
mixture is the same on every run, and adding documents changes no other
document's draw. Copies are then dealt over all partitions and put in the order
of a hash of their own, which is a global shuffle without a sampling pass.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.hashing import digest52, key_text, uniform
from parcelyard.llm.store import cut, packed, unpacked

SEED = "mix-1"
# A Poisson number is the sum of Poisson numbers of smaller means; exp(-mean)
# must stay far from underflow.
PIECE = 16.0
# A row of the sources' table has at most 86 sums, so this many take under 20 MB.
# More sources than that are joined by a shuffle.
MAX_BROADCAST_SOURCES = 20_000


def source_sizes(docs: DataFrame) -> DataFrame:
    """``source`` and ``size``: characters plus one per document, so that none weighs nothing."""
    return docs.groupBy("source").agg(
        F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).cast("double").alias("size")
    )


def tempered_weights(sizes: DataFrame, exponent: float) -> DataFrame:
    """``source`` and ``weight``: size to a power below 1, which lifts small sources."""
    return sizes.select("source", F.pow("size", F.lit(float(exponent))).alias("weight"))


def repetition_rates(sizes: DataFrame, weights: DataFrame, epochs: float = 1.0) -> DataFrame:
    """``source`` and ``rate``: the mean number of copies of each of its documents.

    The mixture is ``epochs`` times as large as the corpus. A source without a
    weight, or with one that is null or not positive, has rate 0; weights of
    sources that have no documents are left out before the shares are taken.
    """
    given = weights.where("weight > 0").groupBy("source").agg(F.sum("weight").alias("weight"))
    both = sizes.alias("s").join(given.alias("g"), F.expr("s.source <=> g.source"), "left")
    both = both.selectExpr("s.source", "size", "coalesce(weight, 0D) AS weight")
    sizes_sum = both.agg(F.sum("size")).scalar()
    weights_sum = both.agg(F.sum("weight")).scalar()
    share = F.when(weights_sum > 0, F.col("weight") / weights_sum).otherwise(0.0)
    rate = share * sizes_sum * F.lit(float(epochs)) / F.col("size")
    return both.select("source", rate.alias("rate"))


def _cumulative(mean: Column) -> Column:
    """P(N <= k) for k = 0, 1, ... until what is missing is below the draw's 2**-52."""
    last = F.ceil(mean + 10 * F.sqrt(mean) + 30).cast("int")
    # The state is the last term and all sums so far.
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * mean / k
        return F.struct(
            term.alias("term"),
            F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + term)).alias("sums"),
        )

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["sums"]


def poisson_table(rates: DataFrame) -> DataFrame:
    """Per source the number of pieces its mean is cut into and a piece's distribution."""
    pieces = F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int")
    cut = rates.select("source", "rate", pieces.alias("pieces"))
    return cut.select(
        "source", "pieces", _cumulative(F.col("rate") / F.col("pieces")).alias("sums")
    )


def _draws(seed: str, key: Column, pieces: Column) -> Column:
    """A document's uniform numbers, one per piece."""
    return F.transform(
        F.sequence(F.lit(1), pieces), lambda piece: uniform(key_text(F.lit(seed), key, piece))
    )


def _copies(draws: Column, sums: Column) -> Column:
    """The Poisson number of a document: how many sums its draws have passed."""
    return F.aggregate(
        draws, F.lit(0), lambda n, u: n + F.size(F.filter(sums, lambda s: s <= u))
    )


def mix(
    docs: DataFrame,
    weights: DataFrame | Mapping[str, float] | None = None,
    *,
    exponent: float = 0.5,
    epochs: float = 1.0,
    seed: str = SEED,
) -> DataFrame:
    """All columns of ``docs`` plus ``copy`` and ``place``, one row per copy.

    ``weights`` holds ``source`` and ``weight``; without it a source's weight is
    its size to the power ``exponent``. ``copy`` counts a document's copies from
    1; ``place`` is the copy's place key in the global order.

    Null, empty and repeated: a null source is a source like any other; a null
    text counts like an empty one; a null id draws like the text ``null``;
    repeated rows draw the same number and each is repeated. An empty table
    gives an empty mixture. Columns of ``docs`` named ``copy`` or ``place`` are
    replaced.
    """
    docs = docs.drop("copy", "place")
    sizes = source_sizes(docs)
    if weights is None:
        weights = tempered_weights(sizes, exponent)
    elif isinstance(weights, Mapping):
        rows = [(k, float(v)) for k, v in weights.items()]
        weights = docs.sparkSession.createDataFrame(rows, "source string, weight double")
    table = poisson_table(repetition_rates(sizes, weights, epochs)).select(
        F.col("source").alias("_source"), F.col("pieces").alias("_pieces"), F.col("sums").alias("_sums")
    )
    table = cut(table)
    if table.count() <= MAX_BROADCAST_SOURCES:
        table = F.broadcast(table)
    rows = packed(docs, "doc_id", "source")
    counted = rows.join(table, rows["source"].eqNullSafe(table["_source"]))
    counted = counted.withColumn("_u", _draws(seed, F.col("doc_id"), F.col("_pieces")))
    counted = counted.withColumn("_n", _copies(F.col("_u"), F.col("_sums"))).where("_n > 0")
    copies = counted.select("row", "doc_id", F.explode(F.sequence(F.lit(1), "_n")).alias("copy"))
    place = digest52(key_text(F.lit(seed), F.lit("place"), F.col("doc_id"), F.col("copy")))
    return shuffled(copies.select(*unpacked(docs.columns), "copy", place.alias("place")))


def shuffled(copies: DataFrame) -> DataFrame:
    """Rows dealt over all partitions by their place key, in its order within each.

    Repeated rows share a place key. A rebalance lets adaptive execution split
    the partition of a row that is repeated very often.
    """
    return copies.hint("rebalance", "place").sortWithinPartitions("place")
