"""Counts and sums. Children are aggregated on their key before any join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.functions.values import share
from parcelyard.operators.joins import fully_packed_packages
from parcelyard.operators.keyed import keep_keys, on
from parcelyard.schemas import ITEM_BOXED, ITEM_OPEN, TENANT


def _package_totals(packages: DataFrame, items: DataFrame) -> DataFrame:
    owned = packages.select(TENANT, "customer_id", "tracking_number").filter(
        F.col("customer_id").isNotNull()
    )
    packed = fully_packed_packages(items).withColumn("_packed", F.lit(True))
    return (
        owned.join(packed, on("tracking_number"), "left")
        .groupBy(*on("customer_id"))
        .agg(
            F.count_if(F.col("_packed").isNull()).alias("package_count"),
            F.count("*").alias("_all"),
        )
    )


def _newest_first(customers: DataFrame) -> DataFrame:
    return customers.orderBy(F.col("customer_date").desc(), F.col("customer_id"), F.col(TENANT))


def customer_open_package_counts(
    customers: DataFrame, packages: DataFrame, items: DataFrame
) -> DataFrame:
    """Every customer with the number of packages not yet fully packed."""
    totals = _package_totals(packages, items).drop("_all")
    counted = customers.join(totals, on("customer_id"), "left").select(
        *customers.columns, F.coalesce("package_count", F.lit(0)).alias("package_count")
    )
    return _newest_first(counted)


def customers_with_open_packages(
    customers: DataFrame, packages: DataFrame, items: DataFrame
) -> DataFrame:
    """As above, without the customers whose packages are all fully packed."""
    totals = _package_totals(packages, items)
    counted = customers.join(totals, on("customer_id"), "left")
    wanted = counted.filter(F.col("_all").isNull() | (F.col("package_count") > 0)).select(
        *customers.columns, F.coalesce("package_count", F.lit(0)).alias("package_count")
    )
    return _newest_first(wanted)


def customers_by_date(customers: DataFrame) -> DataFrame:
    return _newest_first(customers)


def package_item_progress(
    packages: DataFrame,
    items: DataFrame,
    customers: DataFrame | None = None,
    unclaimed: bool = False,
) -> DataFrame:
    """Packages with their numbers of open (sum0) and boxed (sum1) items.

    ``customers`` limits to the packages of these customers; ``unclaimed`` gives
    the packages without an owner, the answer when no customer is named.
    """
    if unclaimed:
        wanted = packages.filter(F.col("customer_id").isNull())
    else:
        wanted = keep_keys(packages, customers, "customer_id")
    progress = (
        items.filter(F.col("item_status").isin(ITEM_OPEN, ITEM_BOXED))
        .groupBy(*on("tracking_number"))
        .agg(
            F.count_if(F.col("item_status") == ITEM_OPEN).alias("sum0"),
            F.count_if(F.col("item_status") == ITEM_BOXED).alias("sum1"),
        )
    )
    return wanted.join(progress, on("tracking_number"), "left").select(
        *packages.columns,
        F.col("Date_create").alias("received_date"),
        F.coalesce("sum0", F.lit(0)).alias("sum0"),
        F.coalesce("sum1", F.lit(0)).alias("sum1"),
    )


def remaining_box_items(
    items: DataFrame,
    subbox: DataFrame,
    subbox_item: DataFrame,
    boxes: DataFrame | None = None,
) -> DataFrame:
    """Boxed items with the quantity no sub-box of their box has taken yet.

    An over-allocated item stays with a negative rest.
    """
    boxed = keep_keys(items.filter(F.col("box_id").isNotNull()), boxes, "box_id")
    taken = (
        subbox_item.join(subbox.select(*on("subbox_id", "box_id")), on("subbox_id"))
        .groupBy(*on("item_id", "box_id"))
        .agg(F.sum("sub_quantity").alias("_taken"))
    )
    rest = F.col("quantity") - F.coalesce("_taken", F.lit(0.0))
    return (
        boxed.join(taken, on("item_id", "box_id"), "left")
        .select(*items.columns, rest.alias("remaining_quantity"))
        .filter(F.col("remaining_quantity") != 0)
        .withColumn(
            "adjusted_weight",
            share(F.col("weight"), F.col("remaining_quantity"), F.col("quantity")),
        )
    )


def open_item_count(
    packages: DataFrame, items: DataFrame, customers: DataFrame | None = None
) -> DataFrame:
    """Number of open items over the packages of each customer that has one."""
    per_package = (
        items.filter(F.col("item_status") == ITEM_OPEN)
        .groupBy(*on("tracking_number"))
        .agg(F.count("*").alias("_open"))
    )
    owned = packages.select(*on("tracking_number", "customer_id")).filter(
        F.col("customer_id").isNotNull()
    )
    return (
        keep_keys(owned, customers, "customer_id")
        .join(per_package, on("tracking_number"))
        .groupBy(*on("customer_id"))
        .agg(F.sum("_open").alias("open_items"))
    )
