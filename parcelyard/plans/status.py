"""Customer status rules, evaluated for a whole batch of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.functions.values import filled, flag
from parcelyard.operators.joins import customers_with_open_items
from parcelyard.operators.keyed import distinct_keys, drop_keys, mark_keys, match, on
from parcelyard.schemas import ITEM_OPEN, TENANT, UNPAID_STATUS, WAREHOUSE_STATUS


def named_customers(requests: DataFrame) -> DataFrame:
    return distinct_keys(requests.filter(filled(F.col("customer_id"))), "customer_id")


def warehouse_if_new(customers: DataFrame, named: DataFrame) -> DataFrame:
    """A named customer without a status gets 'Warehouse'."""
    status = F.col("status")
    marked = mark_keys(customers, named, "customer_id", name="_named")
    return marked.withColumn(
        "status", F.when(F.col("_named") & status.isNull(), WAREHOUSE_STATUS).otherwise(status)
    ).drop("_named")


def clear_when_done(
    customers: DataFrame,
    packages: DataFrame,
    items: DataFrame,
    requests: DataFrame,
    gone: DataFrame,
    key: str,
) -> DataFrame:
    """Clear the status of named customers left without an open item, unless unpaid.

    ``items`` are the items before the batch and ``gone`` the ``gone_seq`` of the
    request that removes them by ``key``. The count is the one seen by the
    customer's last request: items that leave later still count.
    """
    last = (
        requests.filter(filled(F.col("customer_id")))
        .groupBy(*on("customer_id"))
        .agg(F.max("seq").alias("_last_seq"))
    )
    was_open = items.filter(F.col("item_status") == ITEM_OPEN)
    still = F.col("gone_seq").isNull() | (F.col("gone_seq") > F.col("_last_seq"))
    owned = match(packages.select(*on("tracking_number", "customer_id")), last, "customer_id")
    if key == "tracking_number":
        # Removed packages drop out before the items come in, which then move once.
        kept = owned.join(gone, on(key), "left").filter(still)
        holding = match(was_open.select(*on(key)), kept.select(*on(key, "customer_id")), key)
    else:
        theirs = owned.join(was_open.select(*on(key, "tracking_number")), on("tracking_number"))
        # Items have the key to themselves, so none can be hot.
        holding = theirs.join(gone, on(key), "left").filter(still)
    evidence = _evidence(last, "customer_id", _holding=holding)
    done = flag(~F.col("_holding")) & (F.col("status") != UNPAID_STATUS)
    return customers.join(evidence, on("customer_id"), "left").select(
        *[
            F.when(flag(done), F.lit(None)).otherwise(F.col(c)).alias(c) if c == "status" else F.col(c)
            for c in customers.columns
        ]
    )


def _evidence(
    asked: DataFrame, key: str, carried: Sequence[str] = (), **found: DataFrame
) -> DataFrame:
    """Each key asked for once, with a flag per set telling whether it has the key.

    One aggregate over all sets; the sets hold no other keys. ``carried`` columns
    of ``asked`` are kept.
    """
    flags = list(found)

    def part(rows: DataFrame, name: str) -> DataFrame:
        kept = [c if name == "" else F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in carried]
        return rows.select(*on(key), *kept, *[F.lit(f == name).alias(f) for f in flags])

    rows = part(asked, "")
    for name, keys in found.items():
        rows = rows.unionByName(part(keys, name))
    return rows.groupBy(*on(key)).agg(
        *[F.max(c).alias(c) for c in carried], *[F.bool_or(f).alias(f) for f in flags]
    )


def unpaid_or_by_items(
    customers: DataFrame, packages: DataFrame, items: DataFrame, decisions: DataFrame
) -> DataFrame:
    """Apply one decision per customer: ``unpaid`` true sets 'Unpaid'; false gives
    'Warehouse' to a customer with an open item and no status to the others."""
    by_items = decisions.filter(~F.col("unpaid"))
    holding = customers_with_open_items(packages, items, only=by_items)
    decided = mark_keys(
        decisions.select(*on("customer_id"), "unpaid"), holding, "customer_id", name="_open"
    )
    new = F.when(F.col("unpaid"), UNPAID_STATUS).when(F.col("_open"), WAREHOUSE_STATUS)
    return customers.join(decided, on("customer_id"), "left").select(
        *[
            F.when(F.col("unpaid").isNotNull(), new).otherwise(F.col(c)).alias(c)
            if c == "status"
            else F.col(c)
            for c in customers.columns
        ]
    )


def after_box_removal(
    customers: DataFrame,
    packages: DataFrame,
    items: DataFrame,
    packed_boxes: DataFrame,
    removed: DataFrame,
    requests: DataFrame,
) -> DataFrame:
    """Status and package counter of customers whose boxes were removed.

    ``removed`` lists each box with its ``gone_seq``. A customer keeps the status
    while a packed box remains at the customer's last request; otherwise the open
    items of that moment decide, those handed back by removed boxes included.
    """
    asked = (
        requests.filter(F.col("customer_id").isNotNull())
        .groupBy(*on("customer_id"))
        .agg(F.max("seq").alias("_last_seq"), F.count("*").alias("_times"))
    )
    gone = removed.select(*on("box_id"), "gone_seq")
    packed = (
        match(packed_boxes.select(*on("box_id", "customer_id")), asked, "customer_id")
        .join(gone, on("box_id"), "left")
        .filter(F.col("gone_seq").isNull() | (F.col("gone_seq") > F.col("_last_seq")))
    )
    owned = match(packages.select(*on("tracking_number", "customer_id")), asked, "customer_id")
    theirs = owned.join(
        items.select(*on("item_id", "tracking_number", "box_id"), "item_status"),
        on("tracking_number"),
    )
    holding = match(theirs, gone, "box_id", how="left", spread_by="item_id").filter(
        flag(F.col("item_status") == ITEM_OPEN) | flag(F.col("gone_seq") <= F.col("_last_seq"))
    )
    decided = _evidence(asked, "customer_id", ["_times"], _packed=packed, _open=holding)
    hit = F.col("_times").isNotNull()
    status = (
        F.when(~hit | flag(F.col("_packed")), F.col("status"))
        .when(F.col("_open"), WAREHOUSE_STATUS)
        .alias("status")
    )
    counter = customers.schema["packages"].dataType
    packages_left = (
        F.when(hit, (F.col("packages") - F.col("_times")).cast(counter))
        .otherwise(F.col("packages"))
        .alias("packages")
    )
    new = {"status": status, "packages": packages_left}
    return customers.join(decided, on("customer_id"), "left").select(
        *[new.get(c, F.col(c)) for c in customers.columns]
    )


def add_to_counter(customers: DataFrame, requests: DataFrame) -> DataFrame:
    """Count one more package for each request of a customer; NULL stays NULL."""
    times = requests.groupBy(*on("customer_id")).agg(F.count("*").alias("_times"))
    counter = customers.schema["packages"].dataType
    total = F.col("packages") + F.coalesce("_times", F.lit(0))
    return customers.join(times, on("customer_id"), "left").select(
        *[
            total.cast(counter).alias(c) if c == "packages" else F.col(c)
            for c in customers.columns
        ]
    )


def first_request(requests: DataFrame, key: str) -> DataFrame:
    """Sequence number of the first request that removes each key."""
    return (
        requests.filter(F.col(key).isNotNull())
        .groupBy(TENANT, key)
        .agg(F.min("seq").alias("gone_seq"))
    )
