"""All kinds of change that a tenant's log may hold, with what their requests touch.

The staff directory belongs to no tenant; its changes are not part of a tenant's log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.functions.text import box_identifier
from parcelyard.plans import boxes, customers, office, packages
from parcelyard.plans.schedule import SHARE, Kind, Touch

_POSTAL = "address string, city string, state string, country string, zipcode string, phone string"
_SIZES = "weight double, width double, b_long double, height double, img_url string"
_PICKUP = (
    "note string, address_pickup string, phone_pickup string, name_pickup string, position string, vehicle string"
)


def _renames(key: str):
    return lambda rows: F.col("old_id") != F.col(key)


def _new_name(key: str):
    """The key a row gets, where it gets another."""
    return lambda rows: F.when(F.col("old_id") != F.col(key), F.col(key))


def _old_name(key: str):
    return lambda rows: F.when(F.col("old_id") != F.col(key), F.col("old_id"))


def _moved(table: str, key: str, part: str) -> list[Touch]:
    """An edit that may rename: the row's part, and both names where it does."""
    moved = _renames(key)
    return [
        Touch(table, "old_id", part),
        Touch(table, _old_name(key), moves=moved),
        Touch(table, _new_name(key), moves=moved),
    ]


def _box_id(rows: DataFrame) -> Column:
    return box_identifier(F.col("sender"), F.col("submitted_at"))


def _packed_items(rows: DataFrame) -> Column:
    return F.flatten(F.transform("packages", lambda p: F.transform(p["items"], lambda i: i["item_id"])))


# What the status rules read: who owns which package, and which items are open.
_EVIDENCE = [Touch("packages", part="owner", mode=SHARE), Touch("items", part="status", mode=SHARE)]
_STATUS = Touch("customers", "customer_id", "status")

KINDS: dict[str, Kind] = {
    "customer_insert": Kind(
        customers.customer_insert,
        "customer_id string, contact string, type string, level string, note string, customer_date timestamp_ntz",
        [Touch("customers", "customer_id")],
    ),
    "customer_edit": Kind(
        customers.customer_edit,
        "old_id string, customer_id string, contact string, type string, level string, note string",
        _moved("customers", "customer_id", "profile"),
    ),
    "customer_warehouse": Kind(
        customers.customer_warehouse,
        "customer_id string, warehouse string",
        [Touch("customers", "customer_id", "warehouse")],
    ),
    "customer_address": Kind(
        customers.customer_address,
        f"customer_id string, emp_id string, customer_name string, {_POSTAL}, has_country boolean, "
        "doc_type string, has_doc_type boolean, doc_url string, has_doc_url boolean",
        [Touch("customers", "customer_id", "postal")],
    ),
    "customer_delete": Kind(
        customers.customer_delete,
        "customer_id string",
        [
            Touch("customers", "customer_id"),
            *[
                Touch(table)
                for table in (
                    "subbox_item", "subbox", "slip", "items", "packages", "box", "appointment", "addresses"
                )
            ],
        ],
    ),
    "address_insert": Kind(
        customers.address_insert,
        f"customer_id string, recipient_name string, {_POSTAL}, email string",
        [Touch("addresses")],
    ),
    "address_edit": Kind(
        customers.address_edit,
        f"address_id bigint, recipient_name string, {_POSTAL}",
        [Touch("addresses", "address_id", "fields")],
    ),
    "address_delete": Kind(customers.address_delete, "address_id bigint", [Touch("addresses", "address_id")]),
    "package_insert": Kind(
        packages.package_insert,
        "tracking_number string, customer_id string, packages_cost double, has_packages_cost boolean, "
        "photo_url string, emp_id string, Date_create timestamp_ntz",
        [Touch("packages", "tracking_number")],
    ),
    "package_edit": Kind(
        packages.package_edit,
        "old_id string, tracking_number string, customer_id string, photo_url string",
        _moved("packages", "tracking_number", "owner"),
    ),
    "package_delete": Kind(
        packages.package_delete,
        "tracking_number string, customer_id string",
        [Touch("packages", "tracking_number"), Touch("items"), _STATUS, *_EVIDENCE],
    ),
    "items_insert": Kind(
        packages.items_insert,
        "customer_id string, tracking_number string, emp_id string, items array<struct<name:string,"
        "mainCategory:string,subCategory:string,quantity:double,weight:double,photo_url:string>>",
        [Touch("items"), _STATUS],
    ),
    "item_edit": Kind(
        packages.item_edit,
        "item_id bigint, item_name string, item_type string, item_subtype string, quantity double, "
        "weight double, photo_url string",
        [Touch("items", "item_id", "detail")],
    ),
    "item_delete": Kind(
        packages.item_delete,
        "item_id bigint, customer_id string",
        [Touch("items", "item_id"), _STATUS, *_EVIDENCE],
    ),
    "subbox_insert": Kind(
        boxes.subbox_insert,
        f"box_id string, {_SIZES}, emp_id string, "
        "items array<struct<item_id:bigint,selectedQuantity:double,remaining_quantity:double>>",
        [Touch("subbox"), Touch("subbox_item")],
    ),
    "subbox_edit": Kind(
        boxes.subbox_edit, f"subbox_id bigint, {_SIZES}", [Touch("subbox", "subbox_id", "sizes")]
    ),
    "subbox_tracking": Kind(
        boxes.subbox_tracking,
        "subbox_id array<bigint>, subbox_tracking array<string>, subbox_cost array<double>",
        [Touch("subbox", "subbox_id", "tracking")],
    ),
    # Contents are told apart by their sub-box.
    "subbox_delete": Kind(
        boxes.subbox_delete,
        "subbox_id bigint",
        [Touch("subbox", "subbox_id"), Touch("subbox_item", "subbox_id")],
    ),
    "subbox_item_add": Kind(
        boxes.subbox_item_add,
        "subbox_id bigint, items array<struct<item_id:bigint,quantity:double,remaining_quantity:double>>",
        [Touch("subbox_item", "subbox_id")],
    ),
    "subbox_item_edit": Kind(
        boxes.subbox_item_edit,
        "subbox_id bigint, items map<string,double>",
        [Touch("subbox_item", "subbox_id")],
    ),
    "box_insert": Kind(
        lambda tables, sent: boxes.box_insert(tables, sent, boxes.submission_contents(sent)),
        "sender string, recipients bigint, note string, submitted_at timestamp, "
        "packages array<struct<items:array<struct<item_id:bigint>>>>",
        [
            Touch("box", _box_id),
            Touch("items", _packed_items, "status"),
            Touch("customers", "sender", "counter"),
        ],
    ),
    "box_edit": Kind(
        boxes.box_edit,
        "box_id string, box_status string, bprice double, has_bprice boolean, discount double, "
        "has_discount boolean, customer_id string, has_customer_id boolean, document string, "
        "expires_at timestamp_ntz, has_expires_at boolean",
        [Touch("box", "box_id", "terms"), _STATUS, *_EVIDENCE],
    ),
    "box_priority": Kind(
        boxes.box_priority, "box_id string, priority int", [Touch("box", "box_id", "priority")]
    ),
    "box_delete": Kind(
        boxes.box_delete,
        "box_id string, customer_id string",
        [
            Touch("box", "box_id"),
            Touch("box", part="terms", mode=SHARE),
            Touch("items", part="status"),
            Touch("packages", part="owner", mode=SHARE),
            Touch("subbox"),
            Touch("subbox_item"),
            _STATUS,
            Touch("customers", "customer_id", "counter"),
        ],
    ),
    "slip_insert": Kind(
        boxes.slip_insert,
        "box_id string, slip_img string, price double, details string, emp_id string",
        [Touch("slip")],
    ),
    "slip_delete": Kind(boxes.slip_delete, "slip_id bigint", [Touch("slip", "slip_id")]),
    "appointment_insert": Kind(
        office.appointment_insert,
        f"title string, pickupdate string, pickupTime string, {_PICKUP}",
        [Touch("appointment")],
    ),
    "appointment_edit": Kind(
        office.appointment_edit,
        f"appoint_id bigint, status string, has_status boolean, {_PICKUP}",
        [Touch("appointment", "appoint_id", "details")],
    ),
    "log_append": Kind(office.log_append, "Detail string, type string, emp_id string", []),
}
