"""Changes of customers and their addresses."""

from __future__ import annotations

from collections.abc import Callable, Mapping

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
from parcelyard.operators.keyed import distinct_keys, drop_keys, keep_keys, on
from parcelyard.plans.assets import purge_for_customers
from parcelyard.schemas import ASSETS, DEFAULT_COUNTRY

Tables = Mapping[str, DataFrame]

_PROFILE = ["contact", "type", "level", "note"]
_POSTAL = ["address", "city", "state", "country", "zipcode", "phone"]


def customer_insert(
    tables: Tables, changes: DataFrame, at: Column | None = None
) -> dict[str, DataFrame]:
    """``customer_date`` is the request's, else ``at``, by default the time of the run."""
    base = tables["customers"]
    rows = changes.select(
        *on("customer_id"), *_PROFILE, "seq", given_or(changes, "customer_date", at)
    )
    fresh = first_by_key(base, rows, "customer_id")
    return {"customers": insert_rows(base, fresh, "customers")}


def customer_edit(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """``old_id`` finds the customer; the new id is not passed on to other tables."""
    return {
        "customers": rename_by_key(tables["customers"], changes, "customer_id", _PROFILE)
    }


def customer_warehouse(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    return {
        "customers": update_by_key(tables["customers"], changes, "customer_id", ["warehouse"])
    }


def customer_address(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """A missing country means the home country; the document only changes when
    both its type and its address are given."""
    requests = changes.filter(filled(F.col("emp_id"))).select(
        "*",
        (flag(F.col("has_doc_type")) & flag(F.col("has_doc_url"))).alias("_has_doc"),
    )
    requests = requests.withColumn(
        "country",
        F.when(flag(F.col("has_country")), F.col("country")).otherwise(DEFAULT_COUNTRY),
    )
    return {
        "customers": update_by_key(
            tables["customers"],
            requests,
            "customer_id",
            ["customer_name", *_POSTAL],
            {"doc_type": "_has_doc", "doc_url": "_has_doc"},
        )
    }


def customer_delete(
    tables: Tables,
    changes: DataFrame,
    settle: Callable[[DataFrame], DataFrame] = lambda keys: keys,
) -> dict[str, DataFrame]:
    """Remove customers with everything that hangs on them, slips included.

    ``assets`` of the result lists the stored photos that go with them.

    The key sets feed several of the nine tables. ``settle`` may store them once,
    see ``parcelyard.sources.checkpoints``; by default each table plans its own.
    """
    gone = settle(distinct_keys(changes.filter(filled(F.col("customer_id"))), "customer_id"))
    own_boxes = keep_keys(tables["box"].select(*on("box_id", "customer_id")), gone, "customer_id")
    boxes = settle(distinct_keys(own_boxes, "box_id"))
    own_subboxes = keep_keys(tables["subbox"].select(*on("subbox_id", "box_id")), boxes, "box_id")
    subboxes = settle(distinct_keys(own_subboxes, "subbox_id"))
    own_parcels = keep_keys(
        tables["packages"].select(*on("tracking_number", "customer_id")), gone, "customer_id"
    )
    parcels = settle(distinct_keys(own_parcels, "tracking_number"))
    return {
        ASSETS: purge_for_customers(tables["packages"], tables["items"], gone),
        "subbox_item": drop_keys(tables["subbox_item"], subboxes, "subbox_id"),
        "subbox": drop_keys(tables["subbox"], boxes, "box_id", spread_by="subbox_id"),
        "slip": drop_keys(tables["slip"], boxes, "box_id", spread_by="slip_id"),
        "items": drop_keys(tables["items"], parcels, "tracking_number", spread_by="item_id"),
        "packages": drop_keys(
            tables["packages"], gone, "customer_id", spread_by="tracking_number"
        ),
        "box": drop_keys(tables["box"], gone, "customer_id", spread_by="box_id"),
        "appointment": drop_keys(
            tables["appointment"], gone, "customer_id", spread_by="appoint_id"
        ),
        "addresses": drop_keys(
            tables["addresses"], gone, "customer_id", spread_by="address_id"
        ),
        "customers": drop_keys(tables["customers"], gone, "customer_id", one_each=True),
    }


def address_insert(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    base = tables["addresses"]
    return {"addresses": insert_rows(base, number_rows(base, changes, "address_id"))}


def address_edit(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    """The e-mail address is not part of an edit."""
    return {
        "addresses": update_by_key(
            tables["addresses"], changes, "address_id", ["recipient_name", *_POSTAL]
        )
    }


def address_delete(tables: Tables, changes: DataFrame) -> dict[str, DataFrame]:
    return {"addresses": drop_keys(tables["addresses"], changes, "address_id", one_each=True)}
