"""Changes of packages and items."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.functions.values import filled, flag
from parcelyard.operators.changes import (
    first_by_key,
    given_or,
    insert_rows,
    number_rows,
    rename_by_key,
    update_by_key,
)
from parcelyard.operators.keyed import drop_keys
from parcelyard.plans.assets import purge_for_items, purge_for_packages
from parcelyard.plans.status import (
    clear_when_done,
    first_request,
    named_customers,
    warehouse_if_new,
)
from parcelyard.schemas import ASSETS, TENANT, UNCLAIMED_OWNER

Tables = Mapping[str, DataFrame]


def _owner(*unclaimed: str) -> Column:
    owner = F.col("customer_id")
    return F.when(owner.isin(*unclaimed), F.lit(None)).otherwise(owner)


def package_insert(
    tables: Tables, changes: DataFrame, at: Column | None = None
) -> dict[str, DataFrame]:
    """``Date_create`` is the request's, else ``at``, by default the time of the run."""
    base = tables["packages"]
    rows = changes.withColumns(
        {
            "customer_id": _owner(UNCLAIMED_OWNER),
            "packages_cost": F.when(flag(F.col("has_packages_cost")), F.col("packages_cost")),
            "Date_create": given_or(changes, "Date_create", at),
        }
    )
    fresh = first_by_key(base, rows, "tracking_number")
    return {"packages": insert_rows(base, fresh, "packages")}


def package_edit(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """``old_id`` finds the package; its items keep the old tracking number."""
    rows = changes.withColumn("customer_id", _owner(UNCLAIMED_OWNER, ""))
    return {
        "packages": rename_by_key(
            tables["packages"], rows, "tracking_number", ["customer_id", "photo_url"]
        )
    }


def package_delete(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """Remove packages with all their items, then clear finished customers.

    ``assets`` of the result lists the stored photos that go with them.
    """
    requests = changes.filter(filled(F.col("tracking_number")))
    gone = first_request(requests, "tracking_number")
    items, packages = tables["items"], tables["packages"]
    return {
        ASSETS: purge_for_packages(packages, items, gone),
        "items": drop_keys(items, gone, "tracking_number", spread_by="item_id"),
        "packages": drop_keys(packages, gone, "tracking_number", one_each=True),
        "customers": clear_when_done(
            tables["customers"], packages, items, requests, gone, "tracking_number"
        ),
    }


def items_insert(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """Store the named entries of each request's ``items`` array.

    An entry needs a name and a main category; a request without such an entry is
    refused. Entries may bring their own ``item_id``, otherwise ids are numbered.
    """
    base = tables["items"]
    asked = changes.filter(filled(F.col("customer_id")) & filled(F.col("tracking_number")))
    usable = F.filter(
        F.col("items"), lambda e: filled(e["name"]) & filled(e["mainCategory"])
    )
    requests = asked.withColumn("items", usable).filter(F.size("items") > 0)
    entry = F.col("entry")
    given = "item_id" in changes.schema["items"].dataType.elementType.fieldNames()
    if not given:
        requests = number_rows(base, requests, "item_id", width=F.size("items"))
    rows = requests.select("*", F.posexplode("items").alias("_pos", "entry")).select(
        TENANT,
        (entry["item_id"] if given else F.col("item_id") + F.col("_pos")).alias("item_id"),
        "tracking_number",
        entry["name"].alias("item_name"),
        entry["mainCategory"].alias("item_type"),
        F.coalesce(entry["subCategory"], F.lit("")).alias("item_subtype"),
        F.coalesce(entry["quantity"], F.lit(0)).alias("quantity"),
        F.coalesce(entry["weight"], F.lit(0)).alias("weight"),
        entry["photo_url"].alias("photo_url"),
        "emp_id",
    )
    return {
        "items": insert_rows(base, rows, "items"),
        "customers": warehouse_if_new(tables["customers"], named_customers(requests)),
    }


def item_edit(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    requests = changes.filter(filled(F.col("item_name")) & filled(F.col("item_type")))
    return {
        "items": update_by_key(
            tables["items"],
            requests,
            "item_id",
            ["item_name", "item_type", "item_subtype", "quantity", "weight", "photo_url"],
        )
    }


def item_delete(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """Remove items, then clear finished customers named by the requests.

    ``assets`` of the result lists the items' stored photos.
    """
    requests = changes.filter(F.col("item_id").isNotNull())
    gone = first_request(requests, "item_id")
    items = tables["items"]
    return {
        ASSETS: purge_for_items(items, gone),
        "items": drop_keys(items, gone, "item_id", one_each=True),
        "customers": clear_when_done(
            tables["customers"], tables["packages"], items, requests, gone, "item_id"
        ),
    }
