"""Prefix matching as an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.functions.values import leading_unsigned
from parcelyard.operators.keyed import match, on
from parcelyard.schemas import TENANT
from parcelyard.sources.checkpoints import settle

# Prefixes that may be sent to every task: some hundred bytes each.
MAX_SENT_PREFIXES = 100_000


def _pieces(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Each row once per length in use among the prefixes, with its text cut to it."""
    # One small array: at most one entry per length a key can have.
    lengths = prefixes.select(F.collect_set(F.length(prefix))).scalar()
    cut = rows.withColumn("_length", F.explode(lengths)).filter(F.col("_length") <= F.length(text))
    return cut.withColumn(prefix, F.left(text, F.col("_length"))).drop("_length")


def join_on_prefix(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Pairs of a row and a listed prefix its text starts with, a prefix once each.

    Each text is cut at the lengths that occur among the prefixes, and the cuts
    are joined by equality, so no row is compared with prefixes of other texts.

    Estimates do not count the cuts, so a join of both sides might send all cuts to
    every task; of a semi join only the prefixes can be sent.
    """
    return match(_pieces(rows, text, prefixes, prefix), prefixes, prefix, how="left_semi")


def join_with_prefix(
    rows: DataFrame, text: str, prefixes: DataFrame, prefix: str
) -> DataFrame:
    """The same with the other columns of ``prefixes``, where a prefix may come more often.

    Up to ``MAX_SENT_PREFIXES`` are sent to the tasks, more are joined by a shuffle;
    the cuts are never sent.
    """
    listed = settle(prefixes)
    few = listed.count() <= MAX_SENT_PREFIXES
    pieces = _pieces(rows, text, listed, prefix)
    return match(pieces, F.broadcast(listed) if few else listed.hint("merge"), prefix)


def best_on_prefix(
    rows: DataFrame, text: str, best: Column, prefixes: DataFrame, prefix: str
) -> DataFrame:
    """Listed prefixes with an aggregate over the rows whose text starts with them.

    The aggregate is taken per cut before the join, within each task first, so a
    prefix of very many rows is no hot key.
    """
    per_piece = _pieces(rows, text, prefixes, prefix).groupBy(*on(prefix)).agg(best)
    return per_piece.join(prefixes, on(prefix))


def _pattern(type_text: Column) -> Column:
    """The LIKE pattern of a type; a backslash before an ordinary character is dropped."""
    return F.regexp_replace(F.concat(type_text, F.lit("%")), r"(?s)(\\[%_\\])|\\(.)", "$1$2")


def last_tracking_per_prefix(
    packages: DataFrame, types: DataFrame, ignore_case: bool = False
) -> DataFrame:
    """For each ``type``, the tracking number LIKE 'type%' with the largest number.

    The number follows the first '-'; without one the whole text is read.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    literal = r"(?s)^(?:[^%_\\]|\\.)*"
    asked = types.select(*on("type")).distinct()
    asked = asked.withColumn("_like", _pattern(fold(F.col("type"))))
    asked = asked.withColumn(
        "_anchor", F.regexp_replace(F.regexp_extract("_like", literal, 0), r"(?s)\\(.)", "$1")
    ).withColumn("_plain", F.regexp_replace("_like", literal, "") == "%")
    tracking = F.col("tracking_number")
    texts = packages.select(
        TENANT, fold(tracking).alias("_text"), F.struct(_number(tracking), tracking).alias("_rank")
    )
    top = F.max("_rank").alias("_top")
    plain = best_on_prefix(texts, "_text", top, asked.filter("_plain"), "_anchor")
    # Only types with wildcards of their own need every package behind the anchor.
    wild = join_with_prefix(texts, "_text", asked.filter(~F.col("_plain")), "_anchor")
    wild = wild.filter(F.like(F.col("_text"), F.col("_like"))).groupBy(*on("type")).agg(top)
    found = plain.select(*on("type"), "_top").unionByName(wild)
    return found.select(TENANT, "type", F.col("_top.tracking_number").alias("tracking_number"))


def _number(tracking: Column) -> Column:
    """The number after the first '-', of the whole text where there is none."""
    # Fixed rule: the text behind the place of the first '-', 0 without one.
    tail = F.substr(tracking, F.instr(tracking, "-") + 1)
    return leading_unsigned(tail).alias("_number")


def last_tracking(packages: DataFrame, tenant: str, type_text: str) -> DataFrame:
    """The same for one type of one tenant, as a top-1."""
    tracking = F.col("tracking_number")
    return (
        packages.filter(F.col(TENANT) == tenant)
        .filter(F.like(tracking, _pattern(F.lit(type_text))))
        .select(TENANT, "tracking_number")
        .orderBy(_number(tracking).desc(), tracking.desc())
        .limit(1)
    )


def file_prefix_matches(listing: DataFrame, keys: DataFrame, mode: str = "all") -> DataFrame:
    """Stored file names that belong to the given photo names.

    ``all`` gives every name starting with the photo name, ``first`` only the
    smallest of them, ``exact`` the equal one.
    """
    asked = keys.select(*on("photo_name")).filter(F.col("photo_name").isNotNull()).distinct()
    names = listing.select(*on("file_name"))
    if mode == "exact":
        equal = names.withColumn("photo_name", F.col("file_name"))
        return equal.join(asked, on("photo_name"), "left_semi").select(
            *on("photo_name", "file_name")
        )
    if mode == "first":
        least = F.min("file_name").alias("_least")
        found = best_on_prefix(names, "file_name", least, asked, "photo_name")
        return found.select(*on("photo_name"), F.col("_least").alias("file_name"))
    if mode != "all":
        raise ValueError(f"unknown mode {mode!r}")
    pairs = join_on_prefix(names, "file_name", asked, "photo_name")
    return pairs.select(*on("photo_name", "file_name"))
