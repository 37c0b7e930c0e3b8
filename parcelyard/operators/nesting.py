"""Sub-boxes with their items, and the work boards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.functions.values import greatest_or_null, share
from parcelyard.operators.keyed import keep_keys, match, on
from parcelyard.operators.ranks import ranked
from parcelyard.schemas import BOARDS, TENANT, VOLUMETRIC_DIVISOR


def subbox_volumetric(subbox: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Chargeable weight: the larger of scale weight and volume weight."""
    volume = F.col("width") * F.col("b_long") * F.col("height") / VOLUMETRIC_DIVISOR
    return keep_keys(subbox, boxes, "box_id").withColumn(
        "volumetricWeight", F.round(greatest_or_null(F.col("weight"), volume), 2)
    )


def subbox_item_weights(
    subbox_item: DataFrame, items: DataFrame, subboxes: DataFrame | None = None
) -> DataFrame:
    """Allocated items with their share of the weight.

    ``item_id`` is the stored item's, NULL when the item is gone;
    ``subbox_item_id`` is the allocation's own.
    """
    allocated = keep_keys(subbox_item, subboxes, "subbox_id").withColumnRenamed(
        "item_id", "subbox_item_id"
    )
    stored = items.withColumn("subbox_item_id", F.col("item_id"))
    detail = [c for c in items.columns if c != TENANT]
    extra = [c for c in allocated.columns if c not in (TENANT, "subbox_item_id")]
    return allocated.join(stored, on("subbox_item_id"), "left").select(
        TENANT,
        "subbox_item_id",
        *extra,
        *detail,
        share(F.col("weight"), F.col("sub_quantity"), F.col("quantity")).alias("adjusted_weight"),
    )


def subbox_nested(
    subbox: DataFrame,
    subbox_item: DataFrame,
    items: DataFrame,
    boxes: DataFrame | None = None,
) -> DataFrame:
    """Sub-boxes with their items: one row per allocation, its columns in ``item``.

    A sub-box without items comes once, with a NULL ``item``. This is the shape at
    every size, so no array grows with the data.
    """
    frame = subbox_volumetric(subbox, boxes)
    wanted = keep_keys(subbox_item, None if boxes is None else frame, "subbox_id")
    rows = subbox_item_weights(wanted, items)
    fields = [c for c in rows.columns if c != TENANT]
    item = rows.select(*on("subbox_id"), F.struct(*fields).alias("item"))
    # Allocations are the side that adaptive execution may split.
    full = match(item, frame, "subbox_id").select(*frame.columns, "item")
    bare = match(frame, subbox_item.select(*on("subbox_id")), "subbox_id", how="left_anti")
    none = F.lit(None).cast(full.schema["item"].dataType).alias("item")
    return full.unionByName(bare.select(*frame.columns, none))


def box_board(box: DataFrame) -> DataFrame:
    """Boxes on the two work boards.

    ``pos`` is the place in the list of the tenant and status, from 1 on: by
    priority, none first, then by box.
    """
    board = F.create_map(*[F.lit(v) for pair in BOARDS.items() for v in pair])
    shown = box.filter(F.col("box_status").isin(*BOARDS)).withColumn("board", board[F.col("box_status")])
    return ranked(shown, on("box_status"), ["priority", "box_id"])
