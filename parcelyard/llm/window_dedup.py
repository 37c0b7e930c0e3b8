"""Line deduplication by overlapping windows of three lines.

Lines that hold more than white space are taken three by three, each window one
line further than the one before; a document of one or two such lines is one
window. Of windows that occur more than once in the corpus the first stays, in
order of ``doc_id`` and then of place in the document; the lines of all others
are covered. A line covered by any window goes, whatever other windows cover it.
Lines of white space alone belong to no window and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.store import packed, unpacked

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _filled(lines: Column) -> Column:
    """``at`` (place among all lines) and ``line`` of the lines that hold something."""
    at = F.transform(lines, lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    return F.filter(at, lambda x: F.trim(F.translate(x["line"], "\t\r\f\x0b", "    ")) != "")


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id``, ``row_key``, ``start`` (number of the first filled line), ``places``, ``digest``.

    A digest is the MD5 of the lines joined by line feeds.
    """
    rows = docs.select(
        "doc_id", F.xxhash64("text").alias("row_key"), _filled(_lines(F.col("text"))).alias("filled")
    )
    rows = rows.where(F.size("filled") > 0)
    last = F.greatest(F.size("filled") - size, F.lit(0))
    rows = rows.withColumn("starts", F.sequence(F.lit(0), last))

    def window(start: Column) -> Column:
        part = F.slice(F.col("filled"), start + 1, F.lit(size))
        return F.struct(
            start.alias("start"),
            F.transform(part, lambda x: x["at"]).alias("places"),
            F.unhex(F.md5(F.array_join(F.transform(part, lambda x: x["line"]), "\n"))).alias("digest"),
        )

    return rows.select(
        "doc_id", "row_key", F.explode(F.transform("starts", window)).alias("w")
    ).select("doc_id", "row_key", "w.*")


def covered_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id``, ``row_key`` and ``covered``, the places of the lines that go."""
    found = windows(docs, size)
    here = F.struct("doc_id", "row_key", "start")
    # Only counts and minima per digest are shuffled for the repeats, summed up
    # per task first; the windows then meet them in a join whose hot digests
    # adaptive execution splits (the third key is 0 throughout, see _zero).
    repeated = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(here).alias("first"))
    repeated = repeated.where("n > 1").select("digest", "first")
    later = found.withColumn("_zero", _zero()).join(
        repeated.withColumn("_zero", _zero()), ["digest", "_zero"]
    )
    later = later.where(~F.struct("doc_id", "row_key", "start").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "row_key").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("covered")
    )


def _zero() -> Column:
    """0, unknown to the planner, so that both sides of a join are shuffled for it."""
    return F.pmod(F.xxhash64("digest"), F.lit(1))


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` with the cleaned ``text``, plus ``n_lines`` and ``n_removed``.

    Whole texts are read and no row is dropped; a document all of whose lines
    are covered keeps an empty text or its blank lines. Documents are told apart
    by ``doc_id`` and a hash of the text. Repeated rows count as one document:
    they keep a window or lose it together. A null id comes before all others; a
    null text stays null with no lines; an empty text has one, empty, line. An
    empty table gives an empty one. Columns named ``n_lines`` or ``n_removed``
    are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    covered = covered_lines(docs.select("doc_id", "text"), size).select(
        F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), F.col("covered").alias("_covered")
    )
    keyed = packed(docs, "doc_id", "text")
    keyed = keyed.select("row", "doc_id", F.xxhash64("text").alias("_row"))
    same = keyed["doc_id"].eqNullSafe(covered["_id"]) & (keyed["_row"] == covered["_key"])
    both = keyed.join(covered, same, "left")
    whole = F.col("row.text")
    lines = _lines(whole)
    gone = F.map_from_arrays(F.col("_covered"), F.col("_covered"))
    left = F.filter(lines, lambda line, i: ~F.map_contains_key(gone, i))
    text = F.when(F.col("_covered").isNull(), whole).otherwise(F.array_join(left, "\n"))
    n_lines = F.when(whole.isNull(), F.lit(0)).otherwise(F.size(lines))
    return both.select(
        *[text.alias(c) if c == "text" else kept for c, kept in zip(docs.columns, unpacked(docs.columns))],
        n_lines.alias("n_lines"),
        F.when(F.col("_covered").isNull(), F.lit(0)).otherwise(F.size("_covered")).alias("n_removed"),
    )
