"""Changes of boxes, sub-boxes and slips."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.functions.text import box_identifier
from parcelyard.functions.values import flag
from parcelyard.operators.changes import (
    first_by_key,
    insert_rows,
    number_rows,
    update_by_key,
)
from parcelyard.operators.keyed import drop_keys, keep_keys, match, on
from parcelyard.plans.status import (
    add_to_counter,
    after_box_removal,
    first_request,
    unpaid_or_by_items,
)
from parcelyard.schemas import ITEM_BOXED, ITEM_OPEN, PACKED, PAID, TENANT

Tables = Mapping[str, DataFrame]

_SIZES = ["weight", "width", "b_long", "height", "img_url"]


def _or_rest(wanted: Column, rest: Column) -> Column:
    """Zero stands for everything that is left."""
    return F.when(wanted == 0, rest).otherwise(wanted)


# Sub-boxes


def subbox_insert(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """New sub-boxes with the items of their ``items`` array.

    An item may be in a sub-box once: a request that lists one twice stores the
    sub-box without contents, as the refused insert of its items leaves it.
    """
    numbered = number_rows(tables["subbox"], changes, "subbox_id")
    ids = F.transform("items", lambda e: e["item_id"])
    once = F.size(F.array_distinct(F.filter(ids, lambda i: i.isNotNull()))) == F.size(
        F.filter(ids, lambda i: i.isNotNull())
    )
    entry = F.col("entry")
    listed = numbered.filter(once).select(TENANT, "subbox_id", F.explode("items").alias("entry"))
    contents = listed.select(
        TENANT,
        "subbox_id",
        entry["item_id"].alias("item_id"),
        _or_rest(entry["selectedQuantity"], entry["remaining_quantity"]).alias("sub_quantity"),
    )
    return {
        "subbox": insert_rows(tables["subbox"], numbered.drop("items")),
        "subbox_item": insert_rows(tables["subbox_item"], contents),
    }


def subbox_edit(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    return {"subbox": update_by_key(tables["subbox"], changes, "subbox_id", _SIZES)}


def subbox_tracking(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """Requests hold three parallel arrays: sub-boxes, tracking numbers, costs.

    Only the sub-box array decides how many entries there are.
    """
    zipped = F.slice(
        F.arrays_zip("subbox_id", "subbox_tracking", "subbox_cost"), 1, F.size("subbox_id")
    )
    rows = changes.filter(F.size("subbox_id") > 0).select(
        TENANT, "seq", F.posexplode(zipped).alias("_pos", "entry")
    )
    # A later entry of the same request wins over an earlier one.
    rows = rows.select(TENANT, F.struct("seq", "_pos").alias("seq"), "entry.*")
    return {
        "subbox": update_by_key(
            tables["subbox"], rows, "subbox_id", ["subbox_tracking", "subbox_cost"]
        )
    }


def subbox_delete(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    return {
        "subbox_item": drop_keys(tables["subbox_item"], changes, "subbox_id"),
        "subbox": drop_keys(tables["subbox"], changes, "subbox_id", one_each=True),
    }


def subbox_item_add(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """Add quantities; an item already in the sub-box gets the sum, NULL wins."""
    base = tables["subbox_item"]
    entry = F.col("entry")
    added = (
        changes.select(TENANT, "subbox_id", F.explode("items").alias("entry"))
        .select(
            TENANT,
            "subbox_id",
            entry["item_id"].alias("item_id"),
            _or_rest(entry["quantity"], entry["remaining_quantity"]).alias("_added"),
        )
        .groupBy(*on("subbox_id", "item_id"))
        .agg(
            F.when(F.count("*") == F.count("_added"), F.sum("_added")).alias("_added"),
        )
    )
    stored = base.withColumn("_stored", F.lit(True))
    joined = stored.join(
        added.withColumn("_asked", F.lit(True)), on("subbox_id", "item_id"), "full"
    )
    quantity = (
        F.when(F.col("_asked").isNull(), F.col("sub_quantity"))
        .when(F.col("_stored").isNull(), F.col("_added"))
        .otherwise(F.col("sub_quantity") + F.col("_added"))
        .cast(base.schema["sub_quantity"].dataType)
    )
    return {
        "subbox_item": joined.withColumn("sub_quantity", quantity).select(*base.columns)
    }


def subbox_item_edit(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """Set quantities from a map of items; a zero removes the item for good.

    Unknown items are passed over, keys that cannot be an item's id included.
    """
    base = tables["subbox_item"]
    entries = changes.select(
        TENANT, "seq", "subbox_id", F.explode("items").alias("item_id", "_quantity")
    )
    known = F.col("item_id").try_cast(base.schema["item_id"].dataType)
    folded = (
        entries.withColumn("item_id", known)
        .filter(F.col("item_id").isNotNull())
        .groupBy(*on("subbox_id", "item_id"))
        .agg(
            F.max_by("_quantity", "seq").alias("_quantity"),
            flag(F.bool_or(F.col("_quantity") == 0)).alias("_zero"),
        )
    )
    quantity = F.when(F.col("_zero").isNull(), F.col("sub_quantity")).otherwise(
        F.col("_quantity").cast(base.schema["sub_quantity"].dataType)
    )
    return {
        "subbox_item": base.join(folded, on("subbox_id", "item_id"), "left")
        .filter(~flag(F.col("_zero")))
        .withColumn("sub_quantity", quantity)
        .select(*base.columns)
    }


# Boxes


def box_insert(
    tables: Tables, submissions: DataFrame, contents: DataFrame
) -> dict[str, DataFrame]:
    """New boxes from submissions and the items each submission packs.

    ``submissions`` holds seq, sender, recipients, note and submitted_at;
    ``contents`` holds seq and item_id. A box id taken by an earlier submission of
    the same sender and second is refused.
    """
    boxes = submissions.select(
        TENANT,
        "seq",
        box_identifier(F.col("sender"), F.col("submitted_at")).alias("box_id"),
        F.col("sender").alias("customer_id"),
        F.col("recipients").alias("address_id"),
        "note",
    )
    fresh = first_by_key(tables["box"], boxes, "box_id")
    packed = contents.join(fresh.select(TENANT, "seq", "box_id"), [TENANT, "seq"]).withColumn(
        "item_status", F.lit(ITEM_BOXED)
    )
    return {
        "box": insert_rows(tables["box"], fresh, "box"),
        "items": update_by_key(tables["items"], packed, "item_id", ["box_id", "item_status"]),
        "customers": add_to_counter(tables["customers"], fresh),
    }


def submission_contents(submissions: DataFrame) -> DataFrame:
    """Item list of submissions that nest items in packages."""
    return submissions.select(TENANT, "seq", F.explode("packages").alias("p")).select(
        TENANT, "seq", F.explode("p.items.item_id").alias("item_id")
    )


def box_edit(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """The fields present pick the kind of edit: price, discount, payment or status."""
    priced = flag(F.col("has_bprice"))
    discounted = ~priced & flag(F.col("has_discount"))
    paying = ~priced & ~discounted & flag(F.col("has_customer_id"))
    requests = changes.select(
        "*",
        priced.alias("_priced"),
        discounted.alias("_discounted"),
        (~discounted).alias("_status"),
        (~discounted & flag(F.col("has_expires_at"))).alias("_expires"),
        paying.alias("_paying"),
    )
    box = update_by_key(
        tables["box"],
        requests,
        "box_id",
        optional={
            "box_status": "_status",
            "bprice": "_priced",
            "document": "_priced",
            "expires_at": "_expires",
            "discount": "_discounted",
        },
    )
    status = F.col("box_status")
    unpaid = F.when(F.col("_priced"), flag(status == PACKED)).otherwise(~flag(status == PAID))
    decisions = (
        requests.filter((F.col("_priced") | F.col("_paying")) & F.col("customer_id").isNotNull())
        .groupBy(*on("customer_id"))
        .agg(F.max_by(unpaid, "seq").alias("unpaid"))
    )
    return {
        "box": box,
        "customers": unpaid_or_by_items(
            tables["customers"], tables["packages"], tables["items"], decisions
        ),
    }


def box_priority(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    return {"box": update_by_key(tables["box"], changes, "box_id", ["priority"])}


def box_delete(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """Unpack and remove boxes with their sub-boxes; slips stay."""
    gone = first_request(changes, "box_id")
    items = tables["items"]
    opened = match(items, gone, "box_id", how="left", spread_by="item_id")
    hit = F.col("gone_seq").isNotNull()
    new = {
        "item_status": F.when(hit, F.lit(ITEM_OPEN)).otherwise(F.col("item_status")),
        "box_id": F.when(~hit, F.col("box_id")),
    }
    subboxes = keep_keys(tables["subbox"].select(*on("subbox_id", "box_id")), gone, "box_id")
    return {
        "items": opened.select(
            *[
                new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col(f.name)
                for f in items.schema.fields
            ]
        ),
        "subbox_item": drop_keys(tables["subbox_item"], subboxes, "subbox_id"),
        "subbox": drop_keys(tables["subbox"], gone, "box_id", spread_by="subbox_id"),
        "box": drop_keys(tables["box"], gone, "box_id", one_each=True),
        "customers": after_box_removal(
            tables["customers"],
            tables["packages"],
            items,
            tables["box"].filter(F.col("box_status") == PACKED),
            gone,
            changes,
        ),
    }


# Slips


def slip_insert(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    base = tables["slip"]
    return {"slip": insert_rows(base, number_rows(base, changes, "slip_id"))}


def slip_delete(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    return {"slip": drop_keys(tables["slip"], changes, "slip_id", one_each=True)}
