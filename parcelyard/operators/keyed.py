"""Key joins. Every key is a tenant plus one or more columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.schemas import TENANT

# Rows with a NULL key match nothing, yet they would all hash to one partition.
_NULL_BUCKETS = 512


def on(*cols: str) -> list[str]:
    return [TENANT, *cols]


def distinct_keys(rows: DataFrame, *cols: str) -> DataFrame:
    """Known keys once each; duplicates go before the shuffle."""
    keys = rows.select(*on(*cols))
    return keys.dropna(subset=list(cols)).distinct()


def match(
    rows: DataFrame, listed: DataFrame, *cols: str, how: str = "inner", spread_by: str | None = None
) -> DataFrame:
    """Join rows, many of which may share a key, to an aggregated side.

    Adaptive execution splits a hot key only where both sides of the join are
    shuffled for it. An aggregate already shuffled by the key would be joined in
    place, so the join gets a third key, 0 wherever the key is known. Rows with a
    NULL key, which never match, are spread by their identity ``spread_by``.
    """
    zero = F.pmod(F.xxhash64(*on(*cols)), F.lit(1))
    bucket = zero
    if spread_by is not None:
        lost = F.pmod(F.xxhash64(spread_by), F.lit(_NULL_BUCKETS))
        bucket = F.when(F.col(cols[0]).isNull(), lost).otherwise(zero)
    left = rows.withColumn("_bucket", bucket)
    right = listed.withColumn("_bucket", zero)
    return left.join(right, [*on(*cols), "_bucket"], how).drop("_bucket")


def keep_keys(
    rows: DataFrame, keys: DataFrame | None, *cols: str, one_each: bool = False
) -> DataFrame:
    """Rows whose key is listed; all rows when no list is given.

    ``one_each`` tells that the key is the rows' own, so that none can be hot.
    """
    if keys is None:
        return rows
    listed = distinct_keys(keys, *cols)
    if one_each:
        found = rows.join(listed, on(*cols), "left_semi")
    else:
        found = match(rows, listed, *cols, how="left_semi")
    return found.select(*rows.columns)


def drop_keys(
    rows: DataFrame,
    keys: DataFrame,
    *cols: str,
    one_each: bool = False,
    spread_by: str | None = None,
) -> DataFrame:
    """Rows whose key is not listed."""
    listed = distinct_keys(keys, *cols)
    if one_each:
        rest = rows.join(listed, on(*cols), "left_anti")
    else:
        rest = match(rows, listed, *cols, how="left_anti", spread_by=spread_by)
    return rest.select(*rows.columns)


def mark_keys(rows: DataFrame, keys: DataFrame, *cols: str, name: str) -> DataFrame:
    """Add a boolean column telling whether the row's own key is listed."""
    listed = distinct_keys(keys, *cols).withColumn("_listed", F.lit(True))
    return rows.join(listed, on(*cols), "left").select(
        *rows.columns, F.coalesce("_listed", F.lit(False)).alias(name)
    )
