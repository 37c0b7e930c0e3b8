"""Table layouts and the assumptions made about the missing table definitions."""

from __future__ import annotations

from pyspark.sql import types as T

TENANT = "tenant_id"

# Beside the changed tables a delete job returns the stored photos to remove.
ASSETS = "assets"

_DDL = {
    "customers": (
        "tenant_id string, customer_id string, customer_name string, contact string, "
        "type string, level string, note string, status string, warehouse string, "
        "packages int, customer_date timestamp_ntz, address string, city string, "
        "state string, country string, zipcode string, phone string, "
        "doc_type string, doc_url string"
    ),
    "addresses": (
        "tenant_id string, address_id bigint, customer_id string, recipient_name string, "
        "phone string, address string, city string, state string, country string, "
        "zipcode string, email string"
    ),
    "packages": (
        "tenant_id string, tracking_number string, customer_id string, "
        "packages_cost decimal(12,2), photo_url string, emp_id string, "
        "Date_create timestamp_ntz"
    ),
    "items": (
        "tenant_id string, item_id bigint, tracking_number string, item_name string, "
        "item_type string, item_subtype string, quantity double, weight double, "
        "packer_id string, photo_url string, emp_id string, item_status int, box_id string"
    ),
    "box": (
        "tenant_id string, box_id string, customer_id string, address_id bigint, "
        "note string, box_status string, priority int, bprice decimal(12,2), "
        "discount decimal(12,2), document string, expires_at timestamp_ntz"
    ),
    "subbox": (
        "tenant_id string, subbox_id bigint, box_id string, weight double, width double, "
        "b_long double, height double, img_url string, emp_id string, "
        "subbox_tracking string, subbox_cost decimal(12,2)"
    ),
    "subbox_item": (
        "tenant_id string, subbox_id bigint, item_id bigint, sub_quantity double"
    ),
    "slip": (
        "tenant_id string, slip_id bigint, box_id string, slip_img string, "
        "price decimal(12,2), details string, emp_id string"
    ),
    "appointment": (
        "tenant_id string, appoint_id bigint, title string, start_date timestamp_ntz, "
        "end_date timestamp_ntz, note string, customer_id string, address_pickup string, "
        "phone_pickup string, name_pickup string, position string, vehicle string, "
        "status string"
    ),
    "employee": (
        "emp_id string, username string, emp_name string, company_name string, "
        "emp_database string, role string, eimg string, emp_date date"
    ),
    "logedit": "tenant_id string, Detail string, type string, emp_id string",
}

_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "decimal(12,2)": T.DecimalType(12, 2),
}


def _struct(columns: str) -> T.StructType:
    pairs = [column.split() for column in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Built without a session, so that the module can be imported before one exists.
SCHEMAS: dict[str, T.StructType] = {name: _struct(ddl) for name, ddl in _DDL.items()}

# Columns that must never leave a reader.
SECRET_COLUMNS = ("password", "emp_datapass")

# Fixed values of the data model.
WAREHOUSE_STATUS = "Warehouse"
UNPAID_STATUS = "Unpaid"
PACKED = "Packed"
PAID = "Paid"
BOARDS = {
    "Ordered": 1,
    "Process": 1,
    "Packed": 1,
    "Paid": 2,
    "Documented": 2,
}
PENDING = "Pending"
OWNER_ROLE = "owner"
UNCLAIMED_OWNER = "MISSINGITEMS"
DEFAULT_COUNTRY = "Thailand"
ITEM_OPEN = 0
ITEM_BOXED = 1
VOLUMETRIC_DIVISOR = 5000
PICKUP_MINUTES = 30

# The table definitions are not published, so these column defaults are assumptions.
INSERT_DEFAULTS: dict[str, dict[str, object]] = {
    "customers": {"packages": 0},
    "items": {"item_status": ITEM_OPEN},
    "box": {"box_status": "Ordered"},
    "appointment": {"status": PENDING},
}
