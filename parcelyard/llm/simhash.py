"""Near-duplicate documents by SimHash, found through segment popcounts.

A fingerprint of 64 bits is cut into 32 segments of two bits, and every segment
is replaced by its number of set bits. The sum of the differences of these
counts (Manhattan distance) is never more than the number of differing bits.
Counts are held as thermometer codes (0, 1, 2 as 00, 01, 11), so that the
distance of two embeddings is again a count of differing bits.

Pairs within a distance of 3 are found by a grid over each half of the
embedding: of two points at a distance up to 3, one half differs by 1 at most. A
point asks in its own cell of a half and in the neighbouring cells where one
count is one higher. What it meets there is kept if the whole embedding is
within the distance, and then if the fingerprints are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.components import components
from parcelyard.llm.store import cut, stored, text_key, unpacked

SHINGLE = 3
MAX_BITS = 3
SEED = 42
_LOW = 0x5555555555555555
# The bits of every byte value, the highest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 8).astype(np.int64)


def _fingerprint(text: str | None, size: int) -> int:
    """The SimHash of a text; bit 63 is the highest bit of the hashes."""
    from xxhash import xxh64_intdigest

    # bytes.lower() changes A-Z only, bytes.split() splits at 09-0D and 20 only.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    hashes = np.array(
        [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())],
        dtype=">u8",
    )
    # Big-endian bytes put the highest bit first. How often each byte value occurs
    # at each of the eight places tells how often each bit is set.
    places = hashes.view(np.uint8).reshape(-1, 8)
    total = np.concatenate([np.bincount(places[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (_fingerprint(text.as_py(), size) for text in batch.column(1))
            fp = np.fromiter(found, np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, fp long")


def _thermometer(fp: Column) -> Column:
    """Two-bit segments as thermometer codes of their popcounts."""
    low = F.lit(_LOW).cast("long")
    high = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(low)
    all_ = fp.bitwiseAND(high).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(all_, 1))


def _cells(points: DataFrame) -> DataFrame:
    """Every point once per half, with its cell: that half of its embedding."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.col("code").bitwiseAND(mask).alias("cell")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("code", 32).alias("cell")),
    )
    return points.select("fp", "code", F.explode(halves).alias("h")).select("fp", "code", "h.*")


def _asked(cells: DataFrame) -> DataFrame:
    """The cells a point asks in: its own, and those with one count one higher."""

    def higher(cell: Column, i: int) -> Column:
        low, high = F.lit(1 << (2 * i)).cast("long"), F.lit(2 << (2 * i)).cast("long")
        both = F.lit(3 << (2 * i)).cast("long")
        return (
            F.when(cell.bitwiseAND(low) == 0, cell.bitwiseOR(low))
            .when(cell.bitwiseAND(both) != both, cell.bitwiseOR(high))
        )

    near = [higher(F.col("cell"), i) for i in range(16)]
    all_ = F.filter(F.array(F.col("cell"), *near), lambda c: c.isNotNull())
    return cells.select("fp", "code", "half", F.posexplode(all_).alias("step", "cell"))


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``a``, ``b`` of different fingerprints at most ``max_bits`` bits apart.

    ``prints`` has each fingerprint ``fp`` once. ``max_bits`` may be 0 to 3: the
    grid's halves prove no more.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the grid finds pairs up to 3 bits apart")
    points = prints.select("fp", _thermometer(F.col("fp")).alias("code"))
    cells = _cells(points)
    asked, held = _asked(cells).alias("p"), cells.alias("q")
    bound = F.bit_count(F.expr("p.code ^ q.code")) <= max_bits
    exact = F.bit_count(F.expr("p.fp ^ q.fp")) <= max_bits
    once = F.expr("p.step > 0 OR p.fp < q.fp")
    met = asked.join(held, F.expr("p.half = q.half AND p.cell = q.cell") & bound & exact & once)
    return met.select(F.col("p.fp").alias("a"), F.col("q.fp").alias("b"))


def _rooted(classes: DataFrame, max_bits: int) -> DataFrame:
    """``fp``, ``least`` and the ``root`` that linked fingerprints share."""
    roots = components(links(classes.select("fp"), max_bits), "a", "b")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left")
    return rooted.select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``docs`` its ``doc_id``, ``fingerprint`` and ``component_id``.

    Texts are lower-cased in A-Z, words are parted by ASCII white space, and a
    text of fewer than ``size`` words has one shingle. Fingerprints link at up to
    ``max_bits`` differing bits; a component is named by the smallest ``doc_id``
    reachable. Equal fingerprints are compared once, however many documents have
    them.

    Null and empty texts have fingerprint zero and link like any other. Repeated
    rows and ids are kept; a null id joins its component and names it only where
    no id is known. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, size), "fingerprints")
    rooted = _rooted(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), max_bits)
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    # A fingerprint may stand for a third of all rows: both sides are shuffled
    # for this join, so adaptive execution can split it.
    zero = F.pmod(F.xxhash64("fp"), F.lit(1))
    rows = prints.withColumn("_z", zero).join(named.withColumn("_z", zero), ["fp", "_z"])
    return rows.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest ``doc_id``.

    Null ids come last; of rows with equal ids that with the smallest hash of its
    text stays, and of rows with equal ids and texts any one. Rows with neither an
    id nor a text are no copies of anything: they stay and take no part.
    """
    key = text_key(docs)
    named = F.struct(docs["doc_id"].isNull().alias("lone"), docs["doc_id"].alias("id"), key.alias("h"))
    known = docs["doc_id"].isNotNull() | docs["text"].isNotNull()
    prints = stored(fingerprints(docs.where(known).select(named.alias("doc_id"), "text"), size), "fingerprints")
    each = stored(prints.groupBy("doc_id", "fp").agg(F.count("*").alias("n")), "keys")
    rooted = _rooted(each.groupBy("fp").agg(F.min("doc_id").alias("least")), max_bits)
    stays = rooted.groupBy("root").agg(F.min("least").alias("doc_id")).select("doc_id")
    stays = stays.withColumn("_stays", F.lit(True))
    # Keys whose rows go, and keys of several rows of which one stays.
    marked = each.join(stays, "doc_id", "left").where("_stays IS NULL OR n > 1")
    marked = cut(marked.select(
        F.col("doc_id.id").alias("_id"), F.col("doc_id.h").alias("_h"), F.col("_stays").isNotNull().alias("_stays")
    ))
    # One key may have a third of all rows: the last key, always 0, has both sides
    # shuffled for these joins, so that adaptive execution can split it.
    zero = F.pmod(F.xxhash64(key), F.lit(1))

    def same(side: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(side["_id"]) & (key == side["_h"]) & known & (zero == side["_zero"])

    marked = marked.withColumn("_zero", F.pmod(F.xxhash64("_h"), F.lit(1)))
    single = docs.join(marked, same(marked), "left_anti")
    several = marked.where("_stays")
    if several.isEmpty():
        return single
    rows = docs.join(several, same(several), "left_semi")
    rows = rows.select(F.struct(*[rows[f"`{c}`"] for c in docs.columns]).alias("row"), text_key(rows).alias("h"))
    one = rows.groupBy(F.col("row.doc_id").alias("id"), "h").agg(F.first("row").alias("row"))
    return single.unionByName(one.select(*unpacked(docs.columns)))
