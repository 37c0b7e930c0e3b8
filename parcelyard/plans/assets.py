"""Stored pictures and documents: what to remove, and under which name to store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.functions.text import (
    STORAGE_HOST,
    base_name,
    object_key,
    safe_file_name,
    with_picture_extension,
)
from parcelyard.functions.values import filled
from parcelyard.operators.joins import tenant_of_employee
from parcelyard.operators.keyed import keep_keys, on
from parcelyard.schemas import TENANT

# Folders of stored pictures.
PACKAGE_FOLDER = "public/package"
ITEM_FOLDER = "public/item"
DEFAULT_VERIFY_PREFIX = "uploads"


def _photos(rows: DataFrame, kind: str, identity: str) -> DataFrame:
    # The cheap test first, also below a join. Known keys come out of an array: as a filter
    # the key would be taken from each address a second time, there even of rows not kept.
    stored = rows.filter(F.contains(F.lower("photo_url"), F.lit(STORAGE_HOST)))
    known = F.filter(F.array(object_key(F.col("photo_url"))), lambda key: key.isNotNull())
    return stored.select(
        TENANT,
        F.lit(kind).alias("kind"),
        F.col(identity).cast("string").alias("ref"),
        F.explode(known).alias("object_key"),
    )


def _with_items(parcels: DataFrame, items: DataFrame, gone: DataFrame) -> DataFrame:
    photos = items.select(*on("item_id", "tracking_number"), "photo_url")
    return _photos(parcels, "package", "tracking_number").unionByName(
        _photos(keep_keys(photos, gone, "tracking_number"), "item", "item_id")
    )


def purge_for_packages(packages: DataFrame, items: DataFrame, gone: DataFrame) -> DataFrame:
    """Object keys of the photos of removed packages and of their items.

    A photo is listed even where only the items of a package are still stored.
    """
    photos = packages.select(*on("tracking_number"), "photo_url")
    parcels = keep_keys(photos, gone, "tracking_number", one_each=True)
    return _with_items(parcels, items, gone)


def purge_for_customers(packages: DataFrame, items: DataFrame, gone: DataFrame) -> DataFrame:
    owned = packages.select(*on("tracking_number", "customer_id"), "photo_url")
    parcels = keep_keys(owned, gone.filter(filled(F.col("customer_id"))), "customer_id")
    return _with_items(parcels, items, parcels)


def purge_for_items(items: DataFrame, gone: DataFrame) -> DataFrame:
    found = keep_keys(items.select(*on("item_id"), "photo_url"), gone, "item_id", one_each=True)
    return _photos(found, "item", "item_id")


def asset_keys(
    uploads: DataFrame, employee: DataFrame, verify_prefix: str = DEFAULT_VERIFY_PREFIX
) -> DataFrame:
    """Target key of each upload; uploads of unknown employees drop out.

    ``uploads`` holds upload_id, emp_id, kind ('package', 'item' or 'verify'),
    original_name, file_name (a name chosen for an item, or NULL) and at_ms.
    """
    base = base_name(F.col("original_name"))
    stamped = F.concat(base, F.lit("_"), F.col("at_ms").cast("string"), F.lit(".webp"))
    chosen = with_picture_extension(F.col("file_name"))
    kind = F.col("kind")
    tail = (
        F.when(kind == "package", F.concat_ws("/", F.lit(PACKAGE_FOLDER), stamped))
        .when(
            (kind == "item") & filled(F.col("file_name")),
            F.concat_ws("/", F.lit(ITEM_FOLDER), chosen),
        )
        .when(kind == "item", F.concat_ws("/", F.lit(ITEM_FOLDER), stamped))
        .when(
            kind == "verify",
            F.concat_ws("/", F.lit(verify_prefix), F.concat(base, F.lit(".webp"))),
        )
    )
    return tenant_of_employee(uploads, employee).select(
        TENANT, "upload_id", "kind", F.concat_ws("/", TENANT, tail).alias("object_key")
    )


def document_names(documents: DataFrame, name: str = "file_name") -> DataFrame:
    return documents.withColumn("stored_name", safe_file_name(F.col(name)))
